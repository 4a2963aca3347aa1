import random

from textrill.operators.quantile import at_ranks


def test_like_sorting(spark):
    rng = random.Random(2)
    rows = [("a", rng.random()) for _ in range(2000)] + [("b", float(rng.randint(0, 3))) for _ in range(500)] + [("c", 7.0), ("d", None), (None, 1.0)]
    got = {r["k"]: (r["p0"], r["p50"], r["p95"], r["p100"]) for r in at_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    want = {}
    for k in ("a", "b", "c"):
        v = sorted(x for g, x in rows if g == k)
        want[k] = tuple(v[min(int(q * len(v)), len(v) - 1)] for q in (0.0, 0.5, 0.95, 1.0))
    assert {k: v for k, v in got.items() if k} == want
