"""Batches answered in blocks: the same as one request at a time, and no row a pair of request and document."""

import pytest

import __spark_entry__ as entry
from textrill.operators import access as A
from textrill.operators import blocks, search
from textrill.plans.query import Request

DOCS = [
    ("museu", "la porta vermella", 10),
    ("escola", "consell escolar al museu", 20),
    (None, None, 30),
    ("municipi", "munta el consell escolar, el consell escolar", None),
    ("", "pis i museu", 50),
    ("consell", "escolar la la la", 60),
    ("museu", "la porta vermella", 70),
]
SEARCHES = ["museu", '"consell escolar" mun', "", "+museu -pis", "-museu", "*** museu", '"la la"', '"la la" la la', "+la +porta mu", "+museu +*** consell", "consell esc", '"consell esc" "porta', "+zzz la", '"el consell"', "+museu +museu la -pis -zzz"]
ASKS = [
    ("ann", ["g1"], 1, 10, [], [], None, None),
    ("bob", [], 1, 2, [], [], None, None),
    ("ann", ["g1", None, ""], 2, 2, ["t", None], [], None, None),
    ("ann", None, 1, 0, None, None, "15", "x"),
    ("ann", ["g1"], 1, 10, [], ["title"], None, None),
    ("ann", ["g1"], 200000, 10, [], [], None, None),
    ("ann", ["g1"], 1, 3, [None], ["content", "title"], " 1e1", "60.9"),
    (None, None, 1, 10, [], [], None, None),
]
ACCESS = [(i, "g:g1") for i in range(1, 8)] + [(1, "g:g1"), (2, "u:ann"), (5, "u:bob"), (7, "o:bob"), (99, "g:g1")]
TAGS = [(1, "meta", "t"), (1, "meta", "t"), (2, "tag", "t"), (5, "meta", "t"), (6, "meta", "t"), (7, "meta", None), (99, "meta", "t")]
REQUESTS = "request_id long, viewer string, groups array<string>, circles array<string>, search string, page int, size int, meta_tags array<string>, limit_fields array<string>, since string, until string"


def _tables(spark, docs, access, tags):
    return (
        spark.createDataFrame([(i, *d, "p") for i, d in enumerate(docs, 1)], "id long, title string, content string, modified long, provider_id string"),
        spark.createDataFrame(access, "doc_id long, token string"),
        spark.createDataFrame(tags, "doc_id long, kind string, value string"),
    )


singles: dict[str, list] = {}  # by what is asked; the same for each way


@pytest.mark.parametrize("slice_, least, ordered", [(blocks.SLICE, 512, 4), (40, 1, 1), (7, 1, 1000)])
def test_like_single_requests(spark, monkeypatch, slice_, least, ordered):
    monkeypatch.setattr(blocks, "SLICE", slice_)
    monkeypatch.setattr(blocks, "LEAST_DOCUMENTS", least)  # one block, or as many as cores
    monkeypatch.setattr(blocks, "ORDERED", ordered)
    docs, access, tags = _tables(spark, DOCS, ACCESS, TAGS)
    asked = [(n, v, g, [], s, *rest) for n, (s, (v, g, *rest)) in enumerate(((s, a) for s in SEARCHES for a in ASKS), 1)]
    requests = spark.createDataFrame(asked, REQUESTS)
    pages = {}
    for r in blocks.pages(requests, docs, access, tags).orderBy("request_id", "rank").collect():
        pages.setdefault(r["request_id"], []).append((r["rank"], r["id"], r["score"]))
    totals = {r["request_id"]: r["total"] for r in blocks.totals(requests, docs, access, tags).collect()}
    assert set(totals) == {r[0] for r in asked}
    for r in asked:
        request = Request(r[4], r[5], r[6], meta_tags=tuple(r[7] or ()), limit_fields=tuple(r[8] or ()), since=r[9], until=r[10])
        if request.limit_fields == ("title",) or request.beyond or not r[1]:
            assert totals[r[0]] == 0 and r[0] not in pages
            continue
        key = (request.search, r[1], str(r[2]), request.tags, r[9], r[10])
        if str(key) not in singles:
            one = search.base(docs, access, tags, request, A.viewer_tokens(viewer=r[1], groups=r[2] or ()))
            singles[str(key)] = sorted((-x["score"], x["id"]) for x in one.collect())
        want = singles[str(key)]
        assert totals[r[0]] == len(want), r
        assert pages.get(r[0], []) == [(i, d, -s) for i, (s, d) in enumerate(want, 1)][request.offset : request.offset + request.limit], r


def _most_rows(spark, before: set) -> tuple[int, set]:
    """The most rows that a stage since then handed on, and the stages so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    rows = {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size())}
    return max((n for s, n in rows.items() if s not in before), default=0), set(rows)


@pytest.mark.parametrize("name", ["batch_pages", "batch_totals"])
def test_pairs_are_no_rows(spark, tmp_path, name):
    """400 requests that each find all of 400 documents hand on far fewer rows than the 160,000 pairs."""
    n = 400
    docs, access, tags = _tables(spark, [("museu", f"museu nova{i}", i) for i in range(n)], [(i, "g:g1") for i in range(1, n + 1)], [(1, "meta", "t")])
    docs = docs.withColumnRenamed("title", "title_norm").withColumnRenamed("content", "content_norm")
    requests = spark.createDataFrame([(i, f"v{i % 50}", ["g1"], [], "museu" if i % 2 else f"museu w{i}", 1, 5, [], [], None, None) for i in range(1, n + 1)], REQUESTS)
    for table, rows in (("index_documents", docs), ("index_access", access), ("index_tags", tags), ("search_requests", requests)):
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
    _, before = _most_rows(spark, set())
    got = entry.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == (5 * n if name == "batch_pages" else n)
    if name == "batch_totals":
        assert {r["total"] for r in got} == {n}
    assert _most_rows(spark, before)[0] <= 20 * n
