from textrill.operators import ops


def test_last_wins_with_ties_and_nulls(spark):
    rows = [("p", "a", 1, "index", None), ("p", "a", 3, "delete", "x"), ("p", "b", 2, "index", "y"), ("p", "b", 2, "index", "y"), ("q", "a", None, "index", None)]
    log = spark.createDataFrame(rows, "provider_id string, document_id string, seq long, op string, title string")
    got = sorted((r["provider_id"], r["document_id"], r["title"]) for r in ops.snapshot(log, ["seq"]).collect())
    assert got == [("p", "b", "y"), ("q", "a", None)] or got[0] == ("p", "b", "y")
    assert ops.snapshot(log.limit(0), ["seq"]).count() == 0


def test_replace_and_delete(spark):
    docs = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 3)], "provider_id string, document_id string, id long")
    new = spark.createDataFrame([("p", "a", 9)], "provider_id string, document_id string, id long")
    assert sorted(r["id"] for r in ops.replaced(docs, new).collect()) == [2, 3, 9]
    assert sorted(r["id"] for r in ops.delete_document(docs, "p", "a").collect()) == [2, 3]
    assert sorted(r["id"] for r in ops.reset(docs, "p").collect()) == [3]
    assert ops.reset(docs, "all").count() == 0


def test_engine_ceiling(spark):
    text = " ".join(f"w{i:08d}" for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, c string")
    rows = {r["id"]: (r["c"], r["ceiling"]) for r in ops.engine_ceiling(df, "c", 5000).collect()}
    assert len(rows[1][0]) == len(text) // 4 and rows[1][1]
    assert rows[2] == ("short", False)
    assert rows[3] == (None, False)


def test_history(spark):
    log = spark.createDataFrame([("p", "a", 1, "index", "h"), ("p", "a", 2, "index", "h"), ("p", "a", 3, "delete", None)], "provider_id string, document_id string, seq long, op string, hash string")
    assert [(r["nth"], r["repeat"]) for r in ops.history(log, ["seq"]).orderBy("seq").collect()] == [(1, False), (2, True), (3, False)]
