import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textrill.llm import mixing as M


def test_water_filling():
    got = M.water_fill({"a": 100, "b": 10, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 4, "b": 2, "c": 2}, 100)
    assert got == {"a": 80.0, "b": 20.0, "c": 0.0}
    assert M.water_fill({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == {"a": 20.0}
    assert M.water_fill({}, {"a": 1.0}, {"a": 2}, 100) == {"a": 0.0}
    assert M.water_fill({"a": 10}, {"a": 1.0}, {"a": 0}, 5) == {"a": 0.0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.floats(0.01, 1), st.integers(0, 4)), min_size=1, max_size=8), st.integers(1, 3000))
def test_water_filling_is_feasible_and_fair(cases, total):
    names = [str(i) for i in range(len(cases))]
    whole = sum(c[1] for c in cases)
    sizes, shares, caps = ({n: c[k] / (whole if k == 1 else 1) for n, c in zip(names, cases)} for k in range(3))
    got = M.water_fill(sizes, shares, caps, total)
    most = {n: sizes[n] * caps[n] for n in names}
    assert all(got[n] <= most[n] + 1e-6 for n in names)
    assert abs(sum(got.values()) - min(total, sum(most.values()))) < 1e-6 * max(1, total)
    free = [got[n] / shares[n] for n in names if got[n] < most[n] - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))
    # a source at its cap would have had more
    assert all(got[n] / shares[n] <= min(free) + 1e-6 * max(1, min(free)) for n in names if free and got[n] >= most[n] - 1e-6)


def test_over_a_table(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", 10 + i % 7) for i in range(3000)] + [(9000, None, 50), (9001, "hot", 0), (9002, "other", 10)]
    counts = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, tokens int, part int, slice string")
    targets = spark.createDataFrame([("hot", 0.3, 2), ("s0", 0.3, 2), ("s1", 0.2, 4), ("s2", 0.1, 1), ("none", 0.1, 1), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    planned = M.plan(counts, targets, 20_000)
    got = M.mix(counts, "doc_id", planned).collect()
    assert len(got) == len(rows) and len({r["doc_id"] for r in got}) == len(rows)
    caps = {p["source"]: p["max_repeats"] for p in planned}
    assert all(r["repeats"] <= caps.get(r["source"], 0) for r in got)
    for p in planned:
        taken = sum(r["tokens"] * r["repeats"] for r in got if r["source"] == p["source"])
        assert abs(taken - p["wanted"]) <= 17
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix(counts, "doc_id", planned).collect()))
    other_seed = M.mix(counts, "doc_id", planned, seed=3).collect()
    assert sorted(map(repr, got)) != sorted(map(repr, other_seed))


def test_empty(spark):
    counts = spark.createDataFrame([], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    planned = M.plan(counts, targets)
    assert planned[0]["whole"] == 0 and planned[0]["part"] == 0
    assert M.mix(counts, "doc_id", planned).count() == 0


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_SOURCES", 1)
    counts = spark.createDataFrame([(1, "a", 1)], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        M.plan(counts, targets)
