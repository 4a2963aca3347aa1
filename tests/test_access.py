import pytest
from pyspark.sql import functions as F

from textrill.errors import AccessIsEmpty
from textrill.operators import access as A


def test_tokens():
    assert A.viewer_tokens(owner="biel", groups=["professorat"]) == ["o:biel", "g:professorat"]
    assert A.viewer_tokens(viewer="ann", users=["ann", ""], groups=[None, 3, "g"], circles=["c"]) == ["o:ann", "u:ann", "g:g", "c:c"]
    assert A.viewer_tokens(users=["__all"]) == ["u:__all"]
    with pytest.raises(AccessIsEmpty):
        A.viewer_tokens(owner="", groups=[""])


def test_token_column(spark):
    rows = [("biel", "", ["u", None, ""], ["g", "g"], None), (None, "ann", None, None, ["c"]), ("", None, None, None, None)]
    df = spark.createDataFrame(rows, "owner string, viewer string, users array<string>, groups array<string>, circles array<string>")
    got = [r[0] for r in df.select(A.token_column(F.col("owner"), F.col("viewer"), users=F.col("users"), groups=F.col("groups"), circles=F.col("circles"))).collect()]
    assert got == [["o:biel", "u:u", "g:g"], ["o:ann", "u:ann", "c:c"], []]


def test_visible(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    access = spark.createDataFrame([(1, "g:a"), (1, "g:a"), (1, "u:x"), (3, "g:b")], "doc_id long, token string")
    assert [r["id"] for r in A.visible(docs, access, ["g:a", "u:x"]).collect()] == [1]
    assert A.visible(docs, access, ["g:none"]).count() == 0


def test_rebuild(spark):
    df = spark.createDataFrame([(["o:me", "u:a", "g:b", "c:d", "z:e", "u:f"],)], "t array<string>")
    r = df.select(A.rebuild(F.col("t")).alias("r")).first()["r"]
    assert (r["users"], r["groups"], r["circles"]) == (["a", "f"], ["b"], ["d"])


def test_visible_totals_by_bitmaps_and_by_rows(spark, monkeypatch):
    rows = [(i, "g:all") for i in range(0, 200_000, 7)] + [(i, "g:some") for i in (7, 8, 9, 70_001)] + [(7, "g:all"), (10**12, "u:x")]
    access = spark.createDataFrame(rows, "doc_id long, token string")
    viewers = spark.createDataFrame([("a", "g:all"), ("a", "g:some"), ("b", "g:some"), ("c", "u:x"), ("c", "g:none"), ("d", "g:none")], "viewer string, token string")
    want = {"a": len({d for d, t in rows if t != "u:x"}), "b": 4, "c": 1}
    for dense in (A.DENSE, 1, 10**9):
        monkeypatch.setattr(A, "DENSE", dense)
        assert {r["viewer"]: r["total"] for r in A.visible_totals(viewers, access).collect()} == want
    assert A.visible_totals(viewers, access.limit(0)).count() == 0
