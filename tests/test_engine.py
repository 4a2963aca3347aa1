"""End to end: index, search, replace, delete, read your writes."""

import base64

import pytest

from textrill.config import Config
from textrill.engine import SearchEngine
from textrill.errors import AccessIsEmpty, StoreConflict, UnknownDocument
from textrill.extract import samples
from textrill.plans.query import Request
from textrill.streaming.changes import start

SCHEMA = "op string, provider_id string, document_id string, title string, content string, content_encoded boolean, owner string, users array<string>, groups array<string>, circles array<string>, tags array<string>, link string, source string, hash string, modified long"


def doc(key, content, op="index", title=None, owner="biel", groups=("professorat",), tags=("files_local",), modified=1757984400, encoded=False):
    if isinstance(content, bytes):
        content, encoded = base64.b64encode(content).decode(), True
    return (op, "test", key, title or f"Arxiu/Full {key}.txt", content, encoded, owner, [], list(groups), [], list(tags), f"/{key}", "files", "abc", modified)


@pytest.fixture
def engine(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/store", seconds=None)
    e.store.create()
    return e


def put(spark, engine, *rows):
    return {r["document_id"]: r.asDict() for r in engine.index(spark.createDataFrame(rows, SCHEMA)).collect()}


def find(engine, search, viewer="carla", groups=("professorat",), **more):
    page, total = engine.search(Request(search, **more), viewer=viewer, groups=groups)
    return [r["document_id"] for r in page.collect()], total.first()["total"]


def test_life_of_documents(spark, engine):
    assert engine.health()["state"] == "ready"
    out = put(spark, engine, doc("s1", "el forn de pa obre l'època de calçots"), doc("s2", samples.docx("una sortida nocturna pel bosc"), title="b.docx"), doc("s3", b"\xff\xfe", title="x.epub"), doc("s4", "!!", encoded=True), doc("s5", "no owner", owner="", groups=()))
    assert {k: v["status"] for k, v in out.items()} == {"s1": "done", "s2": "done", "s3": "done", "s4": "done", "s5": "failed"}
    assert (out["s3"]["cause"], out["s4"]["severity"], out["s4"]["cause"], out["s5"]["severity"]) == ("unsupported", 3, None, 3)
    assert find(engine, "epoca") == (["s1"], 1)
    assert find(engine, '"sortida nocturna"') == (["s2"], 1)
    assert find(engine, "forn", groups=("alumnat",), viewer="dani") == ([], 0)
    assert find(engine, "full", viewer="biel", groups=())[1] == 2
    assert find(engine, "")[1] == 4
    assert find(engine, "forn", meta_tags=("other",)) == ([], 0)
    assert find(engine, "forn", since="2000000000") == ([], 0)
    # a replace changes what is found, and the old text is gone
    put(spark, engine, doc("s1", "caminada fins a l'ermita"))
    assert find(engine, "epoca") == ([], 0)
    assert find(engine, "ermita") == (["s1"], 1)
    row = engine.get_document("test", "s1").first()
    assert (row["owner"], row["groups"], row["content"]) == ("biel", ["professorat"], "caminada fins a l'ermita")
    with pytest.raises(UnknownDocument):
        engine.get_document("test", "nothing")
    with pytest.raises(AccessIsEmpty):
        engine.search(Request("x"), viewer="")
    assert engine.health()["causes"] == {"unsupported": 1}
    put(spark, engine, doc("s1", None, op="delete"))
    assert find(engine, "ermita") == ([], 0)
    keys = spark.createDataFrame([("test", "s2"), ("test", "never")], "provider_id string, document_id string")
    assert {r["document_id"]: r["deleted"] for r in engine.delete_list(keys).collect()} == {"s2": True, "never": False}
    engine.reset("other")
    assert find(engine, "")[1] == 2
    engine.reset()
    assert find(engine, "") == ([], 0)


def test_budget_is_a_cause(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/store", Config(content_bytes=20))
    e.store.create()
    out = put(spark, e, doc("long", "el faristol gran del cor"))
    assert (out["long"]["cause"], out["long"]["extracted"]) == ("budget cut", True)
    assert find(e, "faristol")[0] == ["long"]


def test_health_of_nothing(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/nowhere")
    assert e.health()["state"] == "missing"


def test_stream_reads_its_writes(spark, tmp_path, engine):
    feed = f"{tmp_path}/feed"
    live = set()
    for n in range(5):  # rounds: write one, replace the oldest every third, delete the oldest every fifth
        rows = [doc(f"d{n}", f"torn comu{n} paraula")]
        live.add(f"d{n}")
        if n % 3 == 2:
            rows.append(doc(min(live), f"substituit{n} paraula"))
        if n % 5 == 4:
            gone = min(live)
            live.discard(gone)
            rows = [r for r in rows if r[2] != gone] + [doc(gone, None, op="delete")]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(SCHEMA).parquet(feed)
        start(engine, stream, f"{tmp_path}/checkpoint").awaitTermination()
        ids, total = find(engine, "paraula")
        assert (set(ids), total) == (live, len(live))


def test_a_crash_before_the_new_pointer_changes_nothing(spark, engine):
    put(spark, engine, doc("a", "primer full"))
    point = engine.store._point
    engine.store._point = lambda pointer: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        put(spark, engine, doc("a", "segon full"))
    engine.store._point = point
    assert find(engine, "primer") == (["a"], 1) and find(engine, "segon") == ([], 0)
    engine.store.create()
    assert find(engine, "primer") == (["a"], 1)


def test_ids_are_never_used_again_and_do_not_depend_on_the_number_of_rows(spark, engine):
    put(spark, engine, doc("a", "x"), doc("b", "y"))
    ids = lambda: {r["document_id"]: r["id"] for r in engine.store.read("documents").select("id", "document_id").collect()}
    assert ids() == {"a": 1, "b": 2}
    engine.delete("test", "b")
    put(spark, engine, doc("c", "z"))
    assert ids() == {"a": 1, "c": 3}
    rows = [doc(f"k{i:03d}", "w") for i in range(300)]
    out = engine.index(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert out.count() == 300
    got = ids()
    assert [got[f"k{i:03d}"] for i in range(300)] == list(range(4, 304))


def test_two_writers(spark, engine):
    other = SearchEngine(spark, engine.store.folder, seconds=None)
    pointer = engine.store._pointer()
    put(spark, other, doc("a", "x"))
    with pytest.raises(StoreConflict):
        engine.store._point({**pointer, "number": pointer["number"] + 1})
    assert find(engine, "x") == (["a"], 1)


def test_many_writes_are_joined(spark, tmp_path, monkeypatch):
    from textrill.sources import store

    monkeypatch.setattr(store, "MOST_SEGMENTS", 2)
    e = SearchEngine(spark, f"file://{tmp_path}/store", seconds=None)
    e.ensure()
    for i in range(5):
        put(spark, e, doc(f"d{i}", f"full {i}"), doc("d0", f"canvi {i}"))
    assert len(e.store._pointer()["segments"]) <= 2
    assert find(e, "")[1] == 5 and find(e, "canvi")[0] == ["d0"] and find(e, "full")[1] == 5


def test_ceiling_and_tsquery_rank(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/store", Config(profile="tsquery", ceiling_bytes=400), seconds=None)
    e.ensure()
    out = put(spark, e, doc("big", " ".join(f"mot{i}" for i in range(100))), doc("small", "porta vella", title="museu.txt"), doc("other", "el museu gran"))
    assert {k: v["cause"] for k, v in out.items()} == {"big": "engine ceiling", "small": None, "other": None}
    page, _ = e.search(Request("museu"), viewer="carla", groups=("professorat",))
    assert [(r["document_id"], r["score"]) for r in page.collect()] == [("small", 1.0), ("other", 0.4)]
