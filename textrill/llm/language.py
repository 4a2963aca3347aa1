"""The language of each text and of each passage of a mixed one (problem 1).

A sparse multinomial logistic regression on TF-IDF character n-grams, trained
by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty and
calibrated with one temperature on held-out sentences.

* Features: character n-grams of length 1 to 4 inside words (word ends marked),
  hashed into ``BUCKETS``. IDF comes from all rows of the corpus. TF-IDF vectors
  are scaled to a fixed sum, so a sentence's logits are sums over its words: the
  share of a word is computed once and remembered.
* Training: at most ``MAX_TRAIN`` passages with a reliable label (those with the
  smallest hash of their key), cut into sentences, each also in lower case
  without accents, as some backends store text. Everything else uses all rows.
* Passages: sentences of at least ``MIN_WORDS`` words get a language of their
  own, and so do those of ``SHORT_WORDS`` that end like a sentence where the
  model is ``SURE_SHORT``; others (headings, codes, quoted titles) join the
  passage before. Neighbours of one language form a passage. Its confidence is
  the mean over its sentences, ``surest`` that of its surest sentence.

Null, empty and word-less texts have language null and confidence 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrill.llm.common import fold, spread, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SCALE = 40.0
MAX_TRAIN = 5_000
MIN_WORDS = 5
SHORT_WORDS = 3
SURE = 0.9
SURE_SHORT = 0.99
MEMORY = 300_000

# Names and codes of the languages in use.
NAMES = {
    "ca": ("ca", "cat", "catalan", "català", "catala", "valencià", "valencian"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "en": ("en", "eng", "english"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
}

_WORDS = re.compile(r"[^\W\d_]+")
# a sentence ends at . ! ? before a blank, or at a line break
_ENDS = re.compile(r"(?<=[^\W\d_][.!?])[\"”»)]?\s+|(?<=\d[.!?])\s+(?=[^\W\d_])|(?<=[.!?][\"”»)])\s+|\n+")
_CLOSED = re.compile(r"[.!?][\"”»)]?\s*\Z")
# pieces that are no words of a sentence: quoted titles, addresses, codes; looked for at token starts only
_QUOTED = re.compile(r"«[^«»\n]{1,60}»")
_CODE = re.compile(r"(?<!\S)[^\s\d@(\[]*+(?:[(\[](?!at[)\]]|arroba\))[^\s\d@(\[]*+)*+[\d@(\[]\S*+")


def label_code(value: Column) -> Column:
    """ISO 639-1 code of a language label, or null where it names none of the languages in use."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"^([a-z]{2,3})[-_][a-z0-9]+$", "$1")
    names = F.create_map(*[F.lit(x) for code, all_ in NAMES.items() for n in all_ for x in (n, code)])
    return F.try_element_at(names, plain)


def grams(word: str) -> np.ndarray:
    """Buckets of the character n-grams of one lower-case word."""
    w = f"_{word}_"
    if len(w) > 256:  # long runs of letters repeat their n-grams: hash each once
        counts = Counter("".join(x) for n in ORDERS for x in zip(*(w[j:] for j in range(n))))
        del counts["_"]
        at = [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in counts]
        return np.repeat(np.array(at, np.int32), list(counts.values()))
    return np.array([zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for n in ORDERS for i in range(len(w) - n + 1) if w[i : i + n] != "_"], np.int32)


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences of a text."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def _spoken(sentence: str) -> list[str]:
    """The words of a sentence in lower case, without those of quoted titles, addresses and codes."""
    if "«" in sentence:
        sentence = _QUOTED.sub(" ", sentence)
    return _WORDS.findall(_CODE.sub(" ", sentence).lower())


def document_frequency(docs: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, over all rows. The result has BUCKETS numbers."""

    def count(batches):
        df, seen, n = np.zeros(BUCKETS, np.int64), {}, 0
        flags = np.zeros(BUCKETS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = set(_WORDS.findall(text.lower())) if text else ()
                if not words:
                    continue
                n += 1
                mine = []
                for w in words:
                    g = seen.get(w)
                    if g is None:
                        g = grams(w)
                        if len(seen) < 300_000:
                            seen[w] = g
                    mine.append(g)
                flags[np.concatenate(mine)] = True
                once = np.flatnonzero(flags)
                df[once] += 1
                flags[once] = False
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"at": pa.array([*at, -1], pa.int32()), "n": pa.array([*df[at], n], pa.int64())})

    cells = spread(docs.select(column)).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    at, n = cells["at"].to_numpy(), cells["n"].to_numpy()
    df = np.zeros(BUCKETS, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


class Model:
    """Weights, IDF and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float = 1.0):
        self.langs, self.weights, self.idf, self.temperature = langs, weights, idf, temperature
        self.table = (weights * idf[:, None]).astype(np.float64)
        self.seen: dict[str, int] = {}
        self.shares = np.zeros((1024, len(langs) + 1))

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "idf": self.idf, "temperature": self.temperature}

    def __setstate__(self, state):
        self.__init__(**state)

    def row(self, w: str) -> int:
        """Where ``shares`` holds a word's share of the logits, and last its part of the sum they are scaled by."""
        k = self.seen.get(w)
        if k is None:
            k = self.seen[w] = len(self.seen)
            if k == len(self.shares):
                self.shares = np.concatenate([self.shares, np.zeros_like(self.shares)])
            g = grams(w)
            self.shares[k, :-1], self.shares[k, -1] = self.table[g].sum(0), self.idf[g].sum()
        return k

    def logits(self, words: list[str]) -> np.ndarray:
        if len(self.seen) + len(words) > MEMORY:
            self.seen.clear()  # before, not while the rows of one sentence are gathered
        rows = [self.row(w) for w in words]
        total = self.shares[rows].sum(0)
        return SCALE * total[:-1] / max(total[-1], 1e-9)

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = self.logits(words) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def vector(words: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scaled TF-IDF vector of a sentence, as buckets and values."""
    at, n = np.unique(np.concatenate([grams(w) for w in words]), return_counts=True)
    v = n * idf[at]
    return at, SCALE * v / max(v.sum(), 1e-9)


def train(samples: list[tuple[str, str]], held_out: list[tuple[str, str]], idf: np.ndarray, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 7) -> Model:
    """FTRL-proximal with elastic net, then the temperature that fits ``held_out`` best."""
    langs = sorted({lang for lang, _ in samples})
    data = [(langs.index(lang), *vector(words, idf)) for lang, text in samples if (words := _WORDS.findall(text.lower()))]
    z, n = np.zeros((BUCKETS, len(langs))), np.zeros((BUCKETS, len(langs)))

    def current(at):
        rate = (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / rate, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            y, at, v = data[i]
            w = current(at)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    model = Model(langs, current(np.arange(BUCKETS)), idf)
    logits = [(langs.index(lang), model.logits(words)) for lang, text in held_out if lang in langs and (words := _WORDS.findall(text.lower()))]
    if logits:
        y, x = np.array([a for a, _ in logits]), np.array([b for _, b in logits])

        def loss(t):
            s = x / t
            s = s - s.max(1, keepdims=True)
            return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean()

        model.temperature = float(min(np.geomspace(0.05, 20, 120), key=loss))
    return model


def fit(docs: DataFrame, column: str, labelled: DataFrame) -> Model:
    """A model for ``docs``; ``labelled`` has columns key, lang, text with reliable labels.

    A fifth of the passages, by hash of the key, is held out for the temperature.
    """
    df, n = document_frequency(docs, column)
    idf = np.log((n + 1) / (df + 1)) + 1
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("key")).orderBy("h").limit(MAX_TRAIN).collect()
    samples, held_out = [], []
    for r in rows:
        for a, b in sentences(r["text"]):
            s = r["text"][a:b]
            if len(_WORDS.findall(s)) >= MIN_WORDS:
                for form in (s, fold(s)):
                    (held_out if r["h"] % 5 == 0 else samples).append((r["lang"], form))
    return train(samples, held_out, idf)


def passages(model: Model, text: str | None) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, confidence, whole sentences) of the passages of a text."""
    return [p[:5] for p in surest_passages(model, text)]


def surest_passages(model: Model, text: str | None) -> list[tuple[int, int, str, float, int, float]]:
    """The passages, each with the confidence of its surest sentence (0 where it has no whole one)."""
    if not text:
        return []
    out: list[list] = []
    start = None
    for a, b in sentences(text):
        words = _spoken(text[a:b])
        p = model.probabilities(words) if len(words) >= MIN_WORDS or (len(words) >= SHORT_WORDS and _CLOSED.search(text, a, b)) else None
        if p is None or (len(words) < MIN_WORDS and p.max() < SURE_SHORT):
            if out:
                out[-1][1] = b
            elif start is None:
                start = a
            continue
        k = int(p.argmax())
        if out and out[-1][2] == k:
            out[-1][1] = b
            out[-1][3].append((float(p[k]), b - a))
        else:
            out.append([a if start is None else start, b, k, [(float(p[k]), b - a)]])
        start = None
    if not out:
        words = _WORDS.findall(text.lower())
        if not words:
            return []
        p = model.probabilities(words)
        return [(0, len(text), model.langs[int(p.argmax())], float(p.max()), 0, 0.0)]
    return [(a, b, model.langs[k], sum(p * n for p, n in q) / sum(n for _, n in q), len(q), max(p for p, _ in q)) for a, b, k, q in out]


def segments(docs: DataFrame, key: str, column: str, model: Model) -> DataFrame:
    """(key, segment, start, end, lang, confidence, sentences, surest): the passages of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            rows = [(k, i, *p) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, p in enumerate(surest_passages(m, t))]
            names = ["id", "segment", "start", "end", "lang", "confidence", "sentences", "surest"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.float64()]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    rows = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(column).alias("text")))
    return rows.mapInArrow(run, "id long, segment int, start int, end int, lang string, confidence double, sentences int, surest double").withColumnRenamed("id", key)


def _model(spark, sf_dir) -> tuple[DataFrame, Model]:
    docs = table(spark, sf_dir, "index_documents")
    refs = table(spark, sf_dir, "reading_refs").select(F.col("ref_id").alias("key"), "lang", "text")
    return docs, fit(docs, "content_norm", refs)


def p1_segments(spark, sf_dir):
    """The passages of every row with language and confidence."""
    docs, model = _model(spark, sf_dir)
    return segments(docs, "id", "content_norm", model).drop("surest")


def p1_rows(spark, sf_dir):
    """Every row with its main language, the confidence and the number of languages in it; null where it has no words."""
    docs, model = _model(spark, sf_dir)
    by = segments(docs, "id", "content_norm", model).groupBy("id", "lang").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.sum((F.col("end") - F.col("start")) * F.col("confidence")).alias("w"))
    best = by.groupBy("id").agg(F.max(F.struct("n", "lang", (F.col("w") / F.col("n")).alias("confidence"))).alias("b"), F.count("*").cast("int").alias("languages"))
    return docs.select("id").join(best, "id", "left").select("id", F.col("b.lang").alias("lang"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.lit(0)).alias("languages"))


def p1_found(spark, sf_dir):
    """(id, lang) of languages with a whole sentence in the row that no label of the row names."""
    docs, model = _model(spark, sf_dir)
    spoken = segments(docs, "id", "content_norm", model).filter(F.col("surest") >= SURE).select("id", "lang").distinct()
    tags = table(spark, sf_dir, "index_tags").filter("kind = 'meta' AND lower(value) LIKE 'lang:%'")
    named = tags.select(F.col("doc_id").alias("id"), label_code(F.substring("value", 6, 1000)).alias("lang")).filter("lang IS NOT NULL")
    return spoken.join(named, ["id", "lang"], "left_anti")
