"""Reading levels on held-out graded passages, item estimates on made data."""

import os

import numpy as np
import pytest

from textrill.llm import reading as R

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_estimates_recover_slopes():
    rng = np.random.default_rng(1)
    levels = np.array([-2.0, -1, 0, 1, 2])
    easy, slope = np.log(rng.uniform(0.002, 0.02, 40)), rng.normal(0, 0.6, 40)
    totals = np.full(5, 50_000.0)
    counts = rng.poisson(np.exp(easy[:, None] + slope[:, None] * levels) * totals)
    e, s = R.estimate(counts, totals, levels)
    assert np.abs(s - slope).max() < 0.12 and np.abs(e - easy).max() < 0.2


@pytest.fixture(scope="module")
def fitted(spark):
    refs = [(r["ref_id"], r["lang"], r["text"], r["level"]) for r in spark.read.parquet(f"{DATA}/reading_refs.parquet").collect()]
    held = [r for r in refs if r[0] % 4 == 0]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cut = R.materialize(R.cut_into_items(docs, "doc_id", "text"), "cut")
    return R.fit(cut, [r[1:] for r in refs if r[0] % 4]), held


def test_held_out(spark, fitted):
    model, held = fitted
    df = spark.createDataFrame([(r[0], r[2]) for r in held], "id long, t string")
    got = {r["id"]: r for r in R.graded_levels(R.cut_into_items(df, "id", "t"), "id", model).collect()}
    assert all(got[r[0]]["lang"] == r[1] for r in held)
    demanding = [(got[r[0]]["level"] >= 4) == (r[3] >= 4) for r in held]
    exact = [got[r[0]]["level"] == r[3] for r in held]
    near = [abs(got[r[0]]["level"] - r[3]) <= 1 for r in held]
    assert np.mean(demanding) > 0.97
    assert np.mean(exact) > 0.85
    assert np.mean(near) > 0.98


def test_odd_rows(spark, fitted):
    model, held = fitted
    long = held[0][2] * 2000
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "12 34 /a/b", 7), (4, long, 7), (4, held[0][2], 7), (5, "zzqj wwqk vvxx", 7)], "id long, t string, level int")
    got = [(r["id"], r["level"]) for r in R.graded_levels(R.cut_into_items(df, "id", "t"), "id", model).collect()]
    assert len(got) == 6
    assert {v for i, v in got if i in (1, 2, 3)} == {None}
    assert len({v for i, v in got if i == 4}) == 1
    assert R.graded_levels(R.cut_into_items(df.limit(0), "id", "t"), "id", model).count() == 0


def test_too_many_graded_passages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_GRADED", 5)
    with pytest.raises(ValueError, match="more than 5"):
        R.p8_levels(spark, "/root/testdata/sf0.001")


def test_rounds_converge_to_one_scale(spark, fitted):
    """More rounds than the tolerance asks for change next to nothing, and graded passages stay on their levels."""
    refs = [(r["lang"], r["text"], r["level"]) for r in spark.read.parquet(f"{DATA}/reading_refs.parquet").collect() if r["ref_id"] % 4]
    cut = R.materialize(R.cut_into_items(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text"), "cut")
    old, R.TOLERANCE = R.TOLERANCE, 0.0
    try:
        more = R.fit(cut, refs, most_rounds=6)
    finally:
        R.TOLERANCE = old
    model, held = fitted
    assert np.abs(more.cuts - model.cuts).max() < 0.1
    df = spark.createDataFrame([(r[0], r[2]) for r in held], "id long, t string")
    items = R.materialize(R.cut_into_items(df, "id", "t"), "held")
    a, b = ({r["id"]: r["latent"] for r in R.graded_levels(items, "id", m).collect()} for m in (model, more))
    assert np.mean([abs(a[k] - b[k]) for k in a]) < 0.1


@pytest.mark.parametrize("text", ["x" * 2_000_000, "aB3+/" * 400_000, "é" * 1_000_000, "ab " * 500_000])
def test_long_texts_take_one_scan(text):
    import time

    started = time.time()
    R.items_of(text, {})
    assert time.time() - started < 10
