"""Near-duplicate texts, by odd sketches over MinHash (problem 5).

1. Each text becomes its set of word shingles (``WIDTH`` successive words;
   words are the longest runs of letters and digits after lower-casing and
   removing accents). Texts with the same set are one class with one
   representative, found by an aggregation; copies are never compared.
2. ``BANDS * DEPTH`` MinHash values of a set are folded into an *odd sketch*: a
   bitmap of ``BITS`` bits, each the parity of how many (position, value) pairs
   hash to it. The number of ones in the XOR of two sketches estimates the size
   of the symmetric difference, and so the similarity, most precisely where it is high.
3. Representatives that agree in all ``DEPTH`` values of one of ``BANDS`` bands
   become candidates. An aggregation over the band keys gives the pair of a key
   that two rows share; only keys of three rows or more are joined with their
   rows. Rows of keys over ``BLOCK`` rows bring size and sketch along, so that what is
   too far apart ends where the pair is made. Such keys are first split by size class,
   as sets at the threshold differ in size by no more than one class, which loses nothing;
   what is still large is split into blocks, and blocks compared with
   blocks, so no task holds a whole group. Candidates whose sketches put the
   similarity under the threshold less ``SLACK``, five standard deviations of the
   estimate, end there, as do those whose sizes alone keep them under the threshold.
4. What remains is compared exactly, on the shingle sets.

A pair at similarity s is a candidate with probability 1-(1-s^DEPTH)^BANDS:
0.99994 at 0.6, above 0.99999999 at 0.7 with the values below.

Null texts and texts under ``LEAST_WORDS`` words are in no class and no pair.
Repeated rows are copies like any other. Very long texts are hashed in pieces
of bounded memory, over their whole length.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.llm.common import materialize, spread, table

WIDTH = 3
THRESHOLD = 0.6
LEAST_WORDS = 20
BANDS = 40
DEPTH = 3
BITS = 512
SLACK = 0.32
BLOCK = 512
BROADCAST_ROWS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_U = np.uint64


def words_of(text: str) -> list[str]:
    """Lower case, accents removed, cut into runs of letters and digits; letters without an accent stay, ß among them."""
    text = text.lower()
    return _WORD.findall(text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text)))


def shingles(words: list[str], width: int, seen: dict[str, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word sequences of a text."""
    if len(words) < width:
        return np.empty(0, _U)
    h = np.empty(len(words), _U)
    for i, w in enumerate(words):
        v = seen.get(w)
        if v is None:
            v = xxhash.xxh3_64_intdigest(w)
            if len(seen) < 500_000:
                seen[w] = v
        h[i] = v
    n = len(words) - width + 1
    out = np.zeros(n, _U)
    for k in range(width):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


@lru_cache(4)
def _family(k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, k, dtype=np.uint64) * _U(2) + _U(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def minhash(sets: np.ndarray, k: int) -> np.ndarray:
    a, b = _family(k)
    low = np.full(k, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(sets), 4096):
        h = sets[None, i : i + 4096] * a[:, None] + b[:, None]
        h ^= h >> _U(32)
        low = np.minimum(low, h.min(1))
    return low


def odd_sketch(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity bitmap of (position, value) pairs, as 64-bit words."""
    at = _mix(mins * _U(0x9E3779B97F4A7C15) + np.arange(len(mins), dtype=_U) * _U(0xD1B54A32D192ED03)) % _U(bits)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(mins: np.ndarray, bands: int, depth: int) -> np.ndarray:
    m = mins.reshape(bands, depth)
    key = np.arange(bands, dtype=_U) * _U(0xA0761D6478BD642F)
    for j in range(depth):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + m[:, j])
    return key.view(np.int64)


def most_ones(threshold: float, k: int = BANDS * DEPTH, bits: int = BITS) -> int:
    """The most ones in an XOR of sketches of sets at ``threshold`` or more, as expected."""
    difference = 2 * k * (1 - threshold)
    return int(np.ceil(bits / 2 * (1 - np.exp(-2 * difference / bits))))


def features(docs: DataFrame, key: str, column: str, width: int = WIDTH, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, n, class, sketch, bands, shingles) of the texts long enough to be compared."""

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            out = {k: [] for k in ("id", "n", "class", "sketch", "bands", "shingles")}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text) if text else ()
                if len(words) < max(least_words, width):
                    continue
                s = shingles(words, width, seen)
                mins = minhash(s, BANDS * DEPTH)
                for c, v in zip(out, (i, len(s), xxhash.xxh3_128_digest(s.tobytes()), odd_sketch(mins), band_keys(mins, BANDS, DEPTH), s.view(np.int64))):
                    out[c].append(v)
            if out["id"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("n", pa.int32()), ("class", pa.binary()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))]))

    rows = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(column).alias("text")).filter("text IS NOT NULL AND text <> ''"))
    return rows.mapInArrow(run, "id long, n int, class binary, sketch array<long>, bands array<long>, shingles array<long>")


def _blocks(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds block (salt) and blocks (their number, 1 for ordinary keys) to the rows of each key.

    The number of rows of a key is an aggregate; only keys over BLOCK rows come
    back to the rows, and they are few: one in BLOCK at most.
    """
    hot = rows.groupBy(by).agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).select(by, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    return rows.join(hot, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64(order), F.col("blocks")).cast("int"))


def pairs_within(rows: DataFrame, by: str, order: str, carry: list[str]) -> DataFrame:
    """Pairs (a_*, b_*) of the rows of each key with a's ``order`` below b's.

    Keys over BLOCK rows are compared block by block: the left row meets every
    block through one copy of the right rows for each, so the work of a hot key
    is spread over blocks x blocks groups.
    """
    rows = _blocks(rows, by, order)
    left = rows.select(by, F.col("block").alias("_l"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_r"), F.col(order).alias("a_" + order), *[F.col(c).alias("a_" + c) for c in carry])
    right = rows.select(by, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_l"), F.col("block").alias("_r"), F.col(order).alias("b_" + order), *[F.col(c).alias("b_" + c) for c in carry])
    return left.join(right, [by, "_l", "_r"]).filter(F.col("a_" + order) < F.col("b_" + order)).drop("_l", "_r")


def _ones(a: str, b: str, words: int):
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, words)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def small(df: DataFrame) -> DataFrame:
    """Marks a materialized table for broadcast if it has few rows; otherwise it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _may_be_near(threshold: float):
    """Whether sizes and sketches of a pair (a_n, a_sketch, b_n, b_sketch) leave it a chance."""
    sizes = F.least("a_n", "b_n") / F.greatest("a_n", "b_n") >= threshold
    return sizes & (_ones("a_sketch", "b_sketch", BITS // 64) <= most_ones(threshold - SLACK))


def candidates(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a_id, b_id): pairs that share a band key and whose sizes and sketches come near enough; each pair once.

    ``reps``: id, n, sketch and bands.
    """
    banded = reps.select("id", F.explode("bands").alias("band"))
    shared = materialize(banded.groupBy("band").agg(F.count("*").alias("size"), F.min("id").alias("a_id"), F.max("id").alias("b_id")).filter("size > 1"), "p5-bands")
    few = small(materialize(shared.filter(F.col("size").between(3, BLOCK)).select("band"), "p5-crowded"))
    rows = materialize(banded.join(few, "band"), "p5-rows")
    within = rows.toDF("band", "a_id").join(rows.toDF("band", "b_id"), "band").filter("a_id < b_id").select("a_id", "b_id")
    pairs = shared.filter("size = 2").select("a_id", "b_id").unionAll(within).distinct()
    ends = reps.select("id", "n", "sketch")
    near = pairs.join(ends.toDF("a_id", "a_n", "a_sketch"), "a_id").join(ends.toDF("b_id", "b_n", "b_sketch"), "b_id").filter(_may_be_near(threshold)).select("a_id", "b_id")
    hot = shared.filter(F.col("size") > BLOCK).select("band")  # one key in BLOCK rows at most
    if hot.limit(1).isEmpty():
        return near
    # a hot key's rows meet in their own size class and the next one, each pair in one of them
    step = F.floor(F.log("n") / F.lit(float(-np.log(threshold)))).cast("int")
    slots = F.inline(F.array(F.struct(step.alias("slot"), F.lit(True).alias("own")), F.struct((step + 1).alias("slot"), F.lit(False).alias("own"))))
    placed = reps.select("id", "n", "sketch", F.explode("bands").alias("band")).join(small(hot), "band").select("id", "n", "sketch", "band", slots)
    placed = materialize(placed.select(F.xxhash64("band", "slot").alias("key"), "id", "n", "sketch", "own"), "p5-hot")
    more = pairs_within(placed, "key", "id", ["n", "sketch", "own"]).filter((F.col("a_own") | F.col("b_own")) & _may_be_near(threshold))
    return near.unionAll(more.select("a_id", "b_id")).distinct()


def links(found: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, links): id with its class representative rep; and pairs rep_a < rep_b of representatives with their similarity.

    ``found`` is a materialized result of ``features``.
    """
    first = found.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = materialize(found.select("id", "class").join(first, "class").select("id", "rep", "copies"), "p5-members")
    copies = small(materialize(members.filter("id <> rep").select("id"), "p5-copies"))
    reps = found.select("id", "n", "sketch", "bands").join(copies, "id", "left_anti")
    near = materialize(candidates(reps, threshold), "p5-near")
    wanted = small(materialize(near.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct(), "p5-wanted"))
    sets = found.select("id", "n", "shingles").join(wanted, "id", "left_semi")
    exact = (
        near.join(sets.toDF("a_id", "na", "sa"), "a_id")
        .join(sets.toDF("b_id", "nb", "sb"), "b_id")
        .withColumn("both", F.size(F.array_intersect("sa", "sb")))
        .withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
        .filter(F.col("similarity") >= threshold)
    )
    return members, exact.select(F.col("a_id").alias("rep_a"), F.col("b_id").alias("rep_b"), "similarity")


def all_pairs(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id_a, id_b) of all pairs of rows, copies included, where every pair is asked for."""
    same = pairs_within(members.filter("copies > 1").select("id", "rep"), "rep", "id", []).select(F.col("a_id").alias("x"), F.col("b_id").alias("y"))
    single = linked.select("rep_a", "rep_b")
    a = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = single.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    return same.unionAll(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, group, links): every row with the smallest id reachable over links, and how many different texts it is linked to."""
    from textrill.llm.components import components

    root = components(linked.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    degree = linked.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = members.join(root.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return named.select("id", F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def _links(spark, sf_dir):
    docs = table(spark, sf_dir, "index_documents")
    found = materialize(features(docs, "id", "content_norm"), "p5-features")
    return links(found)


def p5_found(spark, sf_dir):
    """(id_a, id_b) of all pairs of rows of index_documents at similarity 0.6 or more."""
    return all_pairs(*_links(spark, sf_dir))


def p5_groups(spark, sf_dir):
    """Every comparable row with its group and its number of links."""
    members, linked = _links(spark, sf_dir)
    return groups(members, materialize(linked, "p5-links"))
