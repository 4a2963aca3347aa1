"""Matching against SQLite's own full-text engine, and postings against scanning."""

import random
import sqlite3

import pytest

from textrill.functions.text import fold_text
from textrill.operators import index
from textrill.operators.match import index_hits, scan_hits
from textrill.plans.query import compile_query

WORDS = "museu escola biblioteca porta vermella guia consell escolar sortida mun municipi munta pis casa a l'estel niño".split()
QUERIES = [
    "museu", '"museu"', '"consell escolar"', "mun", "+museu porta", '+museu "consell escolar" -pis mun', "-museu", "-museu -porta", '"a a"', "l'est", '+*** museu', "*** museu", "nino", "+guia +casa", "xyz", '"casa a"', "+museu -xyz",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 5))), " ".join(rng.choices(WORDS, k=rng.randint(0, 40)))) for i in range(1, 121)]
    rows += [(121, None, None), (122, "", "museu"), (123, "museu", None), (124, "a a a a", "a a"), (125, "museu", None)]
    return rows, spark.createDataFrame(rows, "id long, title string, content string").cache()


def sqlite_hits(rows, search):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, content, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f(rowid, title, content) VALUES (?,?,?)", [(i, fold_text(t or ""), fold_text(c or "")) for i, t, c in rows])
    return {i: round(s, 6) for i, s in db.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (fold_text(compile_query(search).text),))}


@pytest.mark.parametrize("search", QUERIES)
def test_like_sqlite(corpus, search):
    rows, docs = corpus
    got = {r["id"]: round(r["score"], 6) for r in scan_hits(docs, compile_query(search)).collect()}
    want = sqlite_hits(rows, search)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.parametrize("profile", ["fts5", "tsquery", "boolean"])
def test_postings_like_scan(corpus, profile):
    _, docs = corpus
    post, stats = index.postings(docs).cache(), index.doc_stats(docs).cache()
    for search in QUERIES:
        query = compile_query(search, profile)
        a = {(r["id"], round(r["score"], 6)) for r in scan_hits(docs, query).collect()}
        b = {(r["id"], round(r["score"], 6)) for r in index_hits(post, stats, query).collect()}
        assert a == b, search


def test_profiles_differ(corpus):
    _, docs = corpus
    ids = lambda s, p: {r["id"] for r in scan_hits(docs, compile_query(s, p)).collect()}
    assert ids("+museu zzz", "fts5") == set() == ids("+museu zzz", "tsquery")
    assert ids("+museu zzz", "boolean") == ids("+museu", "fts5")
    assert ids("-museu", "tsquery") == {r["id"] for r in docs.select("id").collect()} - ids("+museu", "fts5")
    assert ids("-museu", "boolean") == set()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id long, title string, content string")
    assert scan_hits(docs, compile_query("a")).count() == 0
    assert index.postings(docs).count() == 0
    assert index.corpus_stats(index.doc_stats(docs)).first()["n_docs"] == 0
