"""Reading level of each document (problem 8).

A Rasch-style model for counts (Rasch's Poisson model with a slope): in a
document of level t, item i occurs with rate

    n_d * exp(easiness_i + slope_i * t),

so items of positive slope are hard ones, which demanding documents hold more
of. Items are the words of a language and the length classes of its sentences.
Given the items, a document's level depends only on the mean slope of its items:
it is where the model's expected slope equals that mean.

Estimation alternates. Graded passages start it at their known levels. Then
(a) every document of the corpus gets its level from the current items, and (b)
every item is re-estimated from its counts over all documents by level, graded
passages included with a fixed weight. A Rasch scale is free in shift and unit; both
are fixed after each round so that graded passages lie on their levels, without which
the alternation would drift. It ends when the levels of graded passages move by less
than ``TOLERANCE`` on average.

Both steps are distributed: documents are cut into items once, counts by level are
added up in each task, and each item is estimated where its counts are. Only two
numbers for each item bucket reach the driver, ``ITEMS`` buckets a language at most,
whatever the size of the corpus. Cut points between levels are those of the graded passages.

Null, empty and word-less texts have level null. Texts are read whole.
"""

from __future__ import annotations

import logging
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.llm.common import materialize, spread, table

log = logging.getLogger(__name__)
ITEMS = 1 << 16
BINS = 17
GRID = np.linspace(-4, 4, BINS)
TOLERANCE = 0.02
MOST_ROUNDS = 20
REF_SHARE = 0.5
RIDGE = 1.0
LEAST_WORDS = 30
DEMANDING = 4
# graded passages are gathered on the driver; more are refused, not cut
MAX_GRADED = 100_000

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[^\W_]+")
# pieces that are no words of a sentence: paths, codes, numbers
_NOISE = re.compile(r"(?<!\S)[^\s\d/_@\\]*+[\d/_@\\]\S*+")
_ENDS = re.compile(r"(?<=[.!?…])[\"”»)]?\s+|\n+")


def items_of(text: str, seen: dict[str, int]) -> list[int]:
    """The items of a text: its words, and one length class for each sentence of three words or more."""
    out: list[int] = []
    for sentence in _ENDS.split(_NOISE.sub(" . ", text).lower()):
        words = _WORD.findall(sentence) if sentence else ()
        if len(words) < 3:
            continue
        for w in (*words, f"#{min(len(words) // 4, 14)}"):
            b = seen.get(w)
            if b is None:
                b = zlib.crc32(w.encode("utf-8", "surrogatepass")) & (ITEMS - 1)
                if len(seen) < 300_000:
                    seen[w] = b
            out.append(b)
    return out


def estimate(counts: np.ndarray, totals: np.ndarray, levels: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Easiness and slope of items from counts (item, level) and totals by level, by damped Newton steps."""
    easy, slope = np.log((counts.sum(1) + 0.5) / totals.sum()), np.zeros(len(counts))
    for _ in range(steps):
        mu = np.exp(np.clip(easy[:, None] + slope[:, None] * levels, -40, 5)) * totals
        g0, g1 = (counts - mu).sum(1), ((counts - mu) * levels).sum(1) - ridge * slope
        h00, h01, h11 = mu.sum(1) + 1e-6, (mu * levels).sum(1), (mu * levels * levels).sum(1) + ridge
        det = h00 * h11 - h01**2
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        norm = np.maximum(1, np.hypot(d0, d1))
        easy, slope = easy + d0 / norm, slope + d1 / norm
    return easy, slope


class Model:
    """Item parameters of each language, the curve from mean slope to level, and cut points."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.slope = np.zeros((len(langs), ITEMS), np.float32)
        self.known = np.zeros((len(langs), ITEMS), bool)
        self.share = np.zeros((len(langs), ITEMS), np.float32)
        self.fine = np.linspace(-5, 5, 401)
        self.curve = np.zeros((len(langs), 401))
        self.cuts = np.array([-1.5, -0.5, 0.5, 1.5])
        # the latent scale is free in shift and unit; graded passages fix both
        self.shift, self.unit = 0.0, 1.0

    def set_items(self, k: int, at: np.ndarray, easy: np.ndarray, slope: np.ndarray) -> None:
        self.slope[k] = 0
        self.known[k] = False
        self.slope[k, at], self.known[k, at] = slope, True
        weight = np.exp(easy[:, None] + slope[:, None] * self.fine)
        self.curve[k] = np.maximum.accumulate((weight * slope[:, None]).sum(0) / weight.sum(0))

    def set_language(self, k: int, counts: np.ndarray) -> None:
        n = counts.sum(1)
        self.share[k] = np.log((n + 0.05) / (n.sum() + 0.05 * ITEMS))

    def language(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The language of each document: under which its items are likeliest."""
        sums = np.stack([_sums(self.share[k][flat], offsets) for k in range(len(self.langs))])
        return sums.argmax(0)

    def levels(self, flat: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The latent level of each document; nan without known items."""
        per = np.repeat(lang, np.diff(offsets))
        known = self.known[per, flat]
        n = _sums(known.astype(np.float64), offsets)
        mean = np.divide(_sums(self.slope[per, flat] * known, offsets), n, out=np.full(len(n), np.nan), where=n > 0)
        out = np.full(len(n), np.nan)
        for k in range(len(self.langs)):
            mine = (lang == k) & (n > 0)
            out[mine] = np.interp(mean[mine], self.curve[k], self.fine)
        return (out - self.shift) / self.unit

    def grade(self, latent: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, latent, side="right") + 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs that the offsets bound; empty runs give 0."""
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[offsets[1:]] - c[offsets[:-1]]


def cut_into_items(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(id, words, items): each text as item buckets, in one pass over the texts."""

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(_RUN.findall(t)) if t else 0 for t in texts], pa.int32()), pa.array([items_of(t, seen) if t else [] for t in texts], pa.list_(pa.int32()))], ["id", "words", "items"]
            )

    rows = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(column).alias("text")))
    return rows.mapInArrow(run, "id long, words int, items array<int>")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values and run offsets of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def corpus_counts(cut: DataFrame, model: Model) -> DataFrame:
    """(item, bin, n): counts of all documents at their current levels; item is language * ITEMS + bucket. Materialized."""
    shared = cut.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        counts = np.zeros(len(m.langs) * ITEMS * BINS, np.int64)
        for batch in batches:
            flat, offsets = _flat(batch.column(0))
            lang = m.language(flat, offsets)
            latent = m.levels(flat, offsets, lang)
            good = ~np.isnan(latent)
            cell = np.where(good, np.clip(np.rint((np.nan_to_num(latent) - GRID[0]) / (GRID[1] - GRID[0])), 0, BINS - 1), 0).astype(np.int64)
            n = np.diff(offsets)
            keep = np.repeat(good, n)
            at = (np.repeat(lang, n).astype(np.int64) * ITEMS + flat) * BINS + np.repeat(cell, n)
            np.add.at(counts, at[keep], 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"item": pa.array(at // BINS, pa.int32()), "bin": pa.array(at % BINS, pa.int32()), "n": pa.array(counts[at].astype(np.float64), pa.float64())})

    # at most languages * ITEMS * BINS rows, from any number of documents
    return materialize(cut.select("items").mapInArrow(run, "item int, bin int, n double").groupBy("item", "bin").agg(F.sum("n").alias("n")), "p8-counts")


def item_step(cells: DataFrame, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket, easiness and slope of the items of each language, estimated where their counts are."""
    langs = len(anchor)
    totals = np.zeros((langs, BINS))
    for r in cells.groupBy(F.floor(F.col("item") / ITEMS).alias("k"), "bin").agg(F.sum("n").alias("n")).collect():  # a row a language and bin
        totals[r["k"], r["bin"]] = r["n"]
    weight = np.maximum(REF_SHARE * totals.sum(1) / np.maximum(anchor.sum((1, 2)), 1), 1.0)
    totals += anchor.sum(1) * weight[:, None]
    k, item, at = np.nonzero(anchor)
    graded = pd.DataFrame({"item": (k * ITEMS + item).astype(np.int32), "bin": at.astype(np.int32), "n": anchor[k, item, at] * weight[k]})
    every = cells.unionByName(cells.sparkSession.createDataFrame(graded, "item int, bin int, n double"))
    by_item = every.groupBy("item").agg(*[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0.0)).alias(f"b{b}") for b in range(BINS)])

    def run(batches):
        for batch in batches:
            items = batch.column(0).to_numpy()
            counts = np.stack([batch.column(1 + b).to_numpy() for b in range(BINS)], 1)
            easy, slope = np.zeros(len(items)), np.zeros(len(items))
            for lang in np.unique(items // ITEMS):
                mine = items // ITEMS == lang
                easy[mine], slope[mine] = estimate(counts[mine], totals[lang] + 1e-9, GRID)
            yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.int32()), "easy": pa.array(easy), "slope": pa.array(slope)})

    found = by_item.mapInArrow(run, "item int, easy double, slope double").toPandas()  # at most languages * ITEMS rows
    language = found["item"].to_numpy() // ITEMS
    return [(mine["item"].to_numpy() % ITEMS, mine["easy"].to_numpy(), mine["slope"].to_numpy()) for mine in (found[language == i] for i in range(langs))]


def fit(cut: DataFrame, graded: list[tuple[str, str, int]], most_rounds: int = MOST_ROUNDS) -> Model:
    """The model from graded passages (language, text, level) and all documents of ``cut``."""
    langs = sorted({lang for lang, _, _ in graded})
    model = Model(langs)
    seen: dict[str, int] = {}
    rows = [(langs.index(lang), items_of(text, seen), level) for lang, text, level in graded if text]
    anchor = np.zeros((len(langs), ITEMS, BINS))
    for k, items, level in rows:
        np.add.at(anchor[k, :, int(np.rint((level - 3 - GRID[0]) / (GRID[1] - GRID[0])))], items, 1)
    for k in range(len(langs)):
        model.set_language(k, anchor[k])
        at = np.flatnonzero(anchor[k].sum(1) > 0)
        model.set_items(k, at, *estimate(anchor[k, at], anchor[k].sum(0) + 1e-9, GRID))
    flat = np.concatenate([np.array(i, np.int64) for _, i, _ in rows])
    offsets = np.concatenate([[0], np.cumsum([len(i) for _, i, _ in rows])])
    spoken, level = np.array([k for k, _, _ in rows]), np.array([v for _, _, v in rows])

    def settle() -> np.ndarray:
        """Fixes the scale and the cut points by the graded passages; returns their levels."""
        model.shift, model.unit = 0.0, 1.0
        raw = model.levels(flat, offsets, spoken)
        good = ~np.isnan(raw)
        model.unit, model.shift = map(float, np.polyfit(level[good] - 3, raw[good], 1))
        latent = model.levels(flat, offsets, spoken)
        means = [np.nanmean(latent[level == v]) for v in range(1, 6)]
        spreads = [np.nanstd(latent[level == v]) + 0.1 for v in range(1, 6)]
        # between neighbours, as many spreads from the one mean as from the other
        model.cuts = np.array([(means[i] * spreads[i + 1] + means[i + 1] * spreads[i]) / (spreads[i] + spreads[i + 1]) for i in range(4)])
        return latent

    before = settle()
    for _ in range(most_rounds):
        for k, (at, easy, slope) in enumerate(item_step(corpus_counts(cut, model), anchor)):
            model.set_items(k, at, easy, slope)
        now = settle()
        moved = float(np.nanmean(np.abs(now - before)))
        if moved < TOLERANCE:
            return model
        before = now
    log.warning("reading levels still move by %.3f after %d rounds", moved if most_rounds else 0.0, most_rounds)
    return model


def graded_levels(cut: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, lang, words, latent, level) of every document; level null where it has no known word."""
    shared = cut.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            flat, offsets = _flat(batch.column(2))
            lang = m.language(flat, offsets)
            latent = m.levels(flat, offsets, lang)
            none = np.isnan(latent)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([None if x else m.langs[k] for k, x in zip(lang, none)], pa.string()),
                    batch.column(1),
                    pa.array(latent, mask=none),
                    pa.array(m.grade(np.nan_to_num(latent)), pa.int32(), mask=none),
                ],
                ["id", "lang", "words", "latent", "level"],
            )

    return cut.select("id", "words", "items").mapInArrow(run, "id long, lang string, words int, latent double, level int").withColumnRenamed("id", key)


def _levels(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    refs = table(spark, sf_dir, "reading_refs")
    cut = materialize(cut_into_items(docs, "doc_id", "text"), "p8-items")
    graded = [(r["lang"], r["text"], r["level"]) for r in refs.select("lang", "text", "level").limit(MAX_GRADED + 1).collect()]
    if len(graded) > MAX_GRADED:
        raise ValueError(f"reading_refs holds more than {MAX_GRADED} passages, which one machine is not meant to fit")
    return graded_levels(cut, "doc_id", fit(cut, graded))


def p8_levels(spark, sf_dir):
    """Every document with its language, number of words and reading level."""
    return _levels(spark, sf_dir)


def p8_profile(spark, sf_dir):
    """Documents and words by language and level."""
    return _levels(spark, sf_dir).groupBy("lang", "level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


def p8_found(spark, sf_dir):
    """(doc_id) of texts of at least 30 words at level 4 or 5."""
    return _levels(spark, sf_dir).filter((F.col("words") >= LEAST_WORDS) & (F.col("level") >= DEMANDING)).select("doc_id")
