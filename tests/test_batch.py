"""Many requests at once against one at a time."""

import pytest

from textrill.operators import access as A
from textrill.operators import batch, index, search
from textrill.plans.query import Request

DOCS = [(i, t, c, m) for i, (t, c, m) in enumerate([("museu", "la porta vermella", 10), ("escola", "consell escolar al museu", 20), (None, None, 30), ("municipi", "munta el consell escolar", 40), ("", "pis i museu", 50)], 1)]
REQUESTS = [
    (1, "ann", ["g1"], [], "museu", 1, 10, [], [], None, None),
    (2, "ann", ["g1"], [], '"consell escolar" mun', 1, 10, [], [], None, None),
    (3, "bob", [], [], "museu", 1, 10, [], [], None, None),
    (4, "ann", ["g1"], [], "", 1, 2, [], [], None, None),
    (5, "ann", ["g1"], [], "+museu -pis", 1, 10, ["t"], [], None, None),
    (6, "ann", ["g1"], [], "museu", 1, 10, [], ["title"], None, None),
    (7, "ann", None, None, "museu", 2, 1, None, None, "15", "x"),
    (8, "ann", ["g1"], [], "museu", 200000, 10, [], [], None, None),
    (9, "ann", ["g1", None, ""], [], "-museu", 1, 10, [], [], None, None),
    (10, "ann", ["g1"], [], "*** museu", 1, 0, [None], [], None, "45"),
]
ACCESS = [(1, "g:g1"), (1, "g:g1"), (2, "u:ann"), (3, "g:g1"), (4, "g:g1"), (5, "o:ann"), (5, "u:bob"), (99, "g:g1")]
TAGS = [(1, "meta", "t"), (1, "meta", "t"), (2, "tag", "t"), (5, "meta", "t")]


@pytest.mark.parametrize("broadcast", [batch.BROADCAST_REQUESTS, 0])
def test_like_single_requests(spark, monkeypatch, broadcast):
    monkeypatch.setattr(batch, "BROADCAST_REQUESTS", broadcast)
    docs = spark.createDataFrame([(*d, "p") for d in DOCS], "id long, title string, content string, modified long, provider_id string")
    access = spark.createDataFrame(ACCESS, "doc_id long, token string")
    tags = spark.createDataFrame(TAGS, "doc_id long, kind string, value string")
    requests = spark.createDataFrame(REQUESTS, "request_id long, viewer string, groups array<string>, circles array<string>, search string, page int, size int, meta_tags array<string>, limit_fields array<string>, since string, until string")
    post, stats = index.postings(docs), index.doc_stats(docs)
    found = batch.search(requests, docs, access, tags, post, stats).cache()
    pages = {}
    for r in batch.pages(found, requests).orderBy("request_id", "rank").collect():
        pages.setdefault(r["request_id"], []).append((r["id"], r["score"]))
    totals = {r["request_id"]: r["total"] for r in batch.totals(found, requests).collect()}
    assert set(totals) == {r[0] for r in REQUESTS}
    for r in REQUESTS:
        request = Request(r[4], r[5], r[6], meta_tags=tuple(r[7] or ()), limit_fields=tuple(r[8] or ()), since=r[9], until=r[10])
        if request.limit_fields:
            assert totals[r[0]] == 0
            continue
        one = search.base(docs, access, tags, request, A.viewer_tokens(viewer=r[1], groups=r[2] or (), circles=r[3] or ()))
        assert totals[r[0]] == one.count(), r
        assert pages.get(r[0], []) == [(x["id"], x["score"]) for x in search.page(one, request).collect()], r
