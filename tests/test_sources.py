import gzip
import json

from textrill.extract import samples
from textrill.operators.search import excerpt_label
from textrill.sources import documents as D
from textrill.streaming.changes import only


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("hola")
    (tmp_path / "in" / "deep" / "b.docx").write_bytes(samples.docx("word"))
    (tmp_path / "in" / "c.zip").write_bytes(b"PK")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["cause"]) for r in D.read_files(spark, str(tmp_path / "in"), 1000).collect()}
    assert got == {"a.txt": ("hola", None), "b.docx": ("word\n", None), "c.zip": (None, "unsupported")}


def test_corpus(spark, tmp_path):
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": 7, "title": "t", "body": "b", "more": 1}) + "\n")
    assert [tuple(r) for r in D.read_corpus(spark, str(tmp_path / "c.jsonl.gz")).collect()] == [("7", "t", "b")]


def test_marker_and_transport(spark):
    rows = [("a.txt", "aG9sYQ==", True, None, None, None), ("b.txt", "!!", True, None, None, None), ("c.txt", "given", False, True, "budget cut", "m"), ("d.txt", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, content string, content_encoded boolean, extracted boolean, cause string, message string")
    got = {r["title"]: (r["text"], r["extracted"], r["cause"], r["severity"]) for r in D.with_content(df, 100).collect()}
    assert got["a.txt"] == ("hola", True, None, 0)
    assert got["b.txt"][1:] == (False, None, 3)
    assert got["c.txt"] == ("given", True, "budget cut", 1)
    assert got["d.txt"][0] is None


def test_streams(spark, tmp_path):
    from textrill.schemas import CHANGES

    spark.createDataFrame([], CHANGES).write.parquet(str(tmp_path / "feed"))
    assert D.stream_changes(spark, str(tmp_path / "feed")).isStreaming
    assert D.stream_files(spark, str(tmp_path)).isStreaming
    events = spark.createDataFrame([("files", None), ("files", "x"), ("other", None)], "provider_id string, content string")
    assert only(events).count() == 1
    assert D.read_table(spark, str(tmp_path / "feed")).columns == CHANGES.names


def test_label():
    assert excerpt_label(' +a "b c" -d ') == 'a  b c   d'


def test_state_over_many_micro_batches(spark, tmp_path):
    from textrill.streaming import changes as S

    schema = S.COLUMNS
    for e in range(35):
        rows = spark.createDataFrame([("p", f"d{e % 5}", e, "delete" if e == 33 else "index", f"t{e}", e, None), ("p", f"only{e}", e, "index", "x", e, None)], schema)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    assert list(S._epochs(14)) == list(range(0, 15)) and list(S._epochs(15)) == [15] and list(S._epochs(17)) == [15, 16, 17] and list(S._epochs(31)) == [31]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    S.latest(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["document_id"]: (r["change_id"], r["op"]) for r in S.state_after(spark, str(tmp_path / "state"), 34).collect()}
    assert len(got) == 40
    assert [got[f"d{i}"] for i in range(5)] == [(30, "index"), (31, "index"), (32, "index"), (33, "delete"), (34, "index")]
