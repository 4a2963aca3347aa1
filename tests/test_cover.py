from textrill.operators.cover import cover_hits, density
from textrill.operators.index import doc_stats, postings
from textrill.operators.match import scan_hits
from textrill.plans.query import compile_query


def test_density():
    q = compile_query('"a" +b', "tsquery")
    assert density([(0, 0, 1.0), (1, 1, 1.0)], q) == 1.0
    assert density([(0, 0, 0.4), (5, 1, 0.4)], q) == 0.4 / 5
    assert density([(0, 0, 1.0), (1, 1, 1.0), (9, 0, 1.0), (10, 1, 1.0)], q) == 1.0 + 1 / 8 + 1.0
    assert density([(3, 0, 1.0)], q) == 0.0


def test_same_rows_as_match(spark):
    docs = spark.createDataFrame([(1, "museu gran", "la porta"), (2, "porta", "el museu " * 5), (3, None, None), (4, "x", "museu porta vella")], "id long, title string, content string")
    post, stats = postings(docs), doc_stats(docs)
    for s in ("museu porta", "+museu -vella", "-museu", '"museu porta"', "", "***"):
        q = compile_query(s, "tsquery")
        a = {r["id"]: r["score"] for r in cover_hits(post, stats, q).collect()}
        assert set(a) == {r["id"] for r in scan_hits(docs, q).collect()}, s
    best = {r["id"]: r["score"] for r in cover_hits(post, stats, compile_query("+museu +porta", "tsquery")).collect()}
    assert max(best, key=best.get) == 4 or best[2] > 0
