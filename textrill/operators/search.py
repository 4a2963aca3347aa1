"""Search: page, exact total and excerpts over one shared base of visible, matching documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.functions.text import excerpt
from textrill.operators.access import visible
from textrill.operators.match import scan_hits
from textrill.plans.query import Compiled, Request, compile_query, numeric_option

DIGITS = 6


def narrowed(docs: DataFrame, access: DataFrame, tags: DataFrame, request: Request, tokens: list[str]) -> DataFrame:
    """The documents of the provider and dates that the viewer may see and that have one of the tags."""
    if request.provider is not None:
        docs = docs.filter(F.col("provider_id") == request.provider)
    since, until = numeric_option(request.since), numeric_option(request.until)
    if since is not None:
        docs = docs.filter(F.col("modified") >= since)
    if until is not None:
        docs = docs.filter(F.col("modified") <= until)
    if request.beyond:
        return docs.filter(F.lit(False))
    docs = visible(docs, access, tokens)
    if request.tags:
        with_tag = tags.filter((F.col("kind") == "meta") & F.col("value").isin(request.tags)).select(F.col("doc_id").alias("id"))
        docs = docs.join(with_tag, "id", "left_semi")
    return docs


def base(docs: DataFrame, access: DataFrame, tags: DataFrame, request: Request, tokens: list[str], query: Compiled | None = None, hits: DataFrame | None = None, profile: str = "fts5", title: str = "title", content: str = "content") -> DataFrame:
    """(id, score) of what the request finds. ``hits`` may come from stored postings; else the texts are read."""
    request = request.checked()
    query = query or compile_query(request.search, profile)
    wanted = narrowed(docs, access, tags, request, tokens).select("id")
    if query.browse:
        return wanted.withColumn("score", F.lit(0.0))
    if hits is None:
        hits = scan_hits(docs, query, title, content)
    return hits.join(wanted, "id", "left_semi").select("id", F.round("score", DIGITS).alias("score"))


def page(found: DataFrame, request: Request) -> DataFrame:
    """The page's rows: best first, then by id."""
    return found.orderBy(F.desc("score"), F.asc("id")).offset(request.offset).limit(request.limit)


def total(found: DataFrame) -> DataFrame:
    """One row: how many documents the request finds in all."""
    return found.agg(F.count("id").alias("total"))


def shaped(rows: DataFrame, docs: DataFrame, request: Request, content: str = "content", extra: tuple[str, ...] = ("document_id", "title", "link")) -> DataFrame:
    """The page with titles and excerpts; texts are read for the page's rows only."""
    columns = [F.col(c) for c in extra] + [excerpt(F.col(content), request.search).alias("excerpt")]
    # a page has at most request.limit rows
    return docs.select("id", *extra, content).join(F.broadcast(rows) if request.limit <= 10_000 else rows, "id").select("id", "score", *columns)


def excerpts(docs: DataFrame, search: str, content: str = "content", id: str = "id") -> DataFrame:
    """(id, excerpt) of every document."""
    return docs.select(F.col(id).alias("id"), excerpt(F.col(content), search).alias("excerpt"))


def excerpt_label(search: str) -> str:
    """The words an excerpt is labelled with."""
    return search.translate(str.maketrans('+-"', "   ")).strip()
