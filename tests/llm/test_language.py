"""Language identification on held-out passages and on small odd inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrill.llm import language as L

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def model(spark):
    refs = spark.read.parquet(f"{DATA}/reading_refs.parquet")
    train = refs.filter("ref_id % 4 <> 0").select(F.col("ref_id").alias("key"), "lang", "text")
    return L.fit(refs, "text", train), [(r["lang"], r["text"]) for r in refs.filter("ref_id % 4 = 0").collect()]


def test_held_out_sentences(model):
    m, held_out = model
    right = sure = total = 0
    for lang, text in held_out:
        for a, b in L.sentences(text):
            for form in (text[a:b], L.fold(text[a:b])):
                words = L._WORDS.findall(L._QUOTED.sub(" ", form).lower())
                if len(words) < L.MIN_WORDS:
                    continue
                p = m.probabilities(words)
                total += 1
                right += m.langs[int(p.argmax())] == lang
                sure += p.max() >= L.SURE
    assert total > 500
    assert right / total > 0.99
    assert sure / total > 0.95


def test_weights_are_sparse(model):
    assert (model[0].weights == 0).mean() > 0.5


def test_mixed_passages(model):
    m = model[0]
    by = {lang: text for lang, text in model[1]}
    cut = lambda t: " ".join(t[a:b] for a, b in L.sentences(t)[:3])
    text = cut(by["ca"]) + " " + cut(by["de"]) + "\n" + cut(by["en"])
    got = L.passages(m, text)
    assert [p[2] for p in got] == ["ca", "de", "en"]
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_labels(spark):
    cases = {"ca": "ca", "CA_ad": "ca", "ca-ES": "ca", "Català": "ca", "cat": "ca", "Spanish": "es", " fr ": "fr", "DEUTSCH": "de", "und": None, "": None, "?": None, None: None, "en-GB": "en"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "k string, v string")
    assert all(r["v"] == r["got"] for r in df.select("v", L.label_code(F.col("k")).alias("got")).collect())


def test_odd_rows(spark, model):
    m = model[0]
    rows = [(1, None, 0), (2, "", 0), (3, "123 456 !!", 0), (4, "x", 0), (5, "The class reads the book every day at school. " * 20_000, 0), (5, "The class reads the book every day at school.", 0)]
    df = spark.createDataFrame(rows, "id long, t string, segment int")
    got = L.segments(df, "id", "t", m).collect()
    assert {r["id"] for r in got} == {4, 5}
    assert {r["lang"] for r in got if r["id"] == 5} == {"en"}
    assert all(0 <= r["confidence"] <= 1 for r in got)
    assert L.segments(df.limit(0), "id", "t", m).count() == 0


def test_labels_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "id long, t string")
    _, n = L.document_frequency(df, "t")
    assert n == 1


class Fixed:
    """A model that reads the language and its probability from the words."""

    langs = ["ca", "en"]

    def probabilities(self, words):
        k, p = (1 if "english" in words else 0), (0.6 if "perhaps" in words else 0.995)
        return L.np.array([p, 1 - p] if k == 0 else [1 - p, p])


def test_one_sure_sentence_tells_a_language():
    text = "This is surely an english sentence. This is perhaps a much longer english sentence with many more words in it, perhaps."
    (found,) = L.surest_passages(Fixed(), text)
    assert found[3] < L.SURE <= found[5]
    assert L.passages(Fixed(), text) == [found[:5]]


def test_short_sentences_count_where_the_model_is_sure():
    before = "Una frase que té prou paraules. "
    assert [p[2] for p in L.surest_passages(Fixed(), before + "An english one.")] == ["ca", "en"]
    assert [p[2] for p in L.surest_passages(Fixed(), before + "See english 12 of ann@b.org today.")] == ["ca", "en"]
    for other in ("Perhaps english here.", "english heading here", "English words."):
        assert [p[2] for p in L.surest_passages(Fixed(), before + other)] == ["ca"]


@pytest.mark.parametrize("text", ["x" * 1_000_000, "aB3+/" * 200_000, "é" * 500_000, "»" * 500_000, "(" * 500_000, "ab (at) c " * 100_000])
def test_long_texts_take_one_scan(text):
    import time

    model = L.Model(["a", "b"], np.zeros((L.BUCKETS, 2)), np.ones(L.BUCKETS))
    started = time.time()
    L.passages(model, text)
    assert time.time() - started < 10


def test_codes_are_no_words():
    assert L._spoken("La «Casa 3» és a_b@c.d o x(at)y, sala 12b, (atenció) [at] fi") == ["la", "és", "o", "sala", "atenció", "fi"]
    word = "ab" * 300
    assert sorted(L.grams(word)) == sorted(L.grams.__wrapped__(word)) if hasattr(L.grams, "__wrapped__") else len(L.grams(word)) == sum(len(word) + 2 - n + 1 for n in L.ORDERS) - 2
