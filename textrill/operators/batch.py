"""Many search requests at once, as joins.

Requests are cut into units by the pure parser, one row a unit. Units meet the
postings by equality of words: a word, the words of a phrase at successive
positions, or, for a begun word, the dictionary's terms by their first letters.

A search string is matched once, however many requests ask it: units to documents,
then searches to documents, one row each, spread by (search, document) so that a
common word is no hot key. What decides about access, dates and tags is joined to
these rows once. Only then do they meet the requests that ask the search: the
requests are broadcast up to ``BROADCAST_REQUESTS``, so no row moves, and are joined
in ``SALTS`` parts of each search beyond. A browse is a search that every document
matches. No request loops on the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrill.errors import UnsupportedCapability
from textrill.operators.access import token_column
from textrill.operators.match import B, IDF_FLOOR, K1
from textrill.operators.search import DIGITS
from textrill.plans.query import MUST, MUST_NOT, SHOULD, Request, compile_query, numeric_option
from textrill.runtime import materialize, spread

SALTS = 64
BROADCAST_REQUESTS = 200_000
UNITS = "request_id long, unit int, words array<string>, prefix boolean, occur string, browse boolean, `limit` long, `offset` long, beyond boolean, refused boolean, since_n long, until_n long"


def units_of(requests: DataFrame) -> DataFrame:
    """One row a unit; a browse, or a query without any word, has one row of unit -1."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                q = Request(r["search"] or "", r["page"] or 1, r["size"] or 0, meta_tags=tuple(r["meta_tags"] or ()), limit_fields=tuple(r["limit_fields"] or ()))
                try:
                    q.checked()
                    refused = False
                except UnsupportedCapability:
                    refused = True
                compiled = compile_query(q.search)
                common = (q.limit, q.offset, q.beyond, refused, numeric_option(r["since"]), numeric_option(r["until"]))
                if not compiled.units:
                    out.append((r["request_id"], -1, [], False, SHOULD, compiled.browse, *common))
                out += [(r["request_id"], i, list(u.words), u.prefix, u.occur, False, *common) for i, u in enumerate(compiled.units)]
            names = ["request_id", "unit", "words", "prefix", "occur", "browse", "limit", "offset", "beyond", "refused", "since_n", "until_n"]
            types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    columns = ["request_id", "search", "page", "size", "meta_tags", "limit_fields", "since", "until"]
    return requests.select(*columns).mapInArrow(run, UNITS)


def unit_hits(units: DataFrame, post: DataFrame) -> DataFrame:
    """(uid, doc_id, tf, len) of distinct units (uid, words, prefix), over the postings; units without words hit nothing."""
    placed = units.filter("size(words) > 0").select("uid", "prefix", F.size("words").alias("k"), F.posexplode("words").alias("at", "word"))
    exact = placed.filter("NOT (prefix AND at = k - 1)")
    # begun words: the dictionary's terms under each of their beginnings, as far as one is asked for
    begun = placed.filter("prefix AND at = k - 1")
    asked = begun.select(F.col("word").alias("head")).distinct()
    # only beginnings as long as one that is asked for; a row a length on the driver
    lengths = sorted(r[0] for r in asked.select(F.length("head")).distinct().collect())
    heads = post.select("term").distinct().select("term", F.explode(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("term")), lambda n: F.substring("term", F.lit(1), n))).alias("head"))
    expanded = begun.join(heads.join(asked, "head", "left_semi"), F.col("word") == F.col("head")).select("uid", "k", "at", "term")
    wanted = materialize(exact.select("uid", "k", "at", F.col("word").alias("term")).unionAll(expanded), "batch-wanted")
    met = spread(post).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_REQUESTS else wanted, "term")
    single = met.filter("k = 1").groupBy("uid", "doc_id").agg(F.sum("tf").alias("tf"), F.max("len").alias("len"))
    # fields that hold all words of a phrase; few are left to look at places
    parts = F.collect_list(F.struct("at", F.transform("positions", lambda p: p - F.col("at")).alias("starts"))).alias("parts")
    held = met.filter("k > 1").groupBy("uid", "k", "doc_id", "field").agg(F.max("len").alias("len"), parts).filter(F.size(F.array_distinct("parts.at")) == F.col("k"))
    # a phrase starts where each of its k words stands k places on; a place holds one word, so each counts once
    starts = held.select("uid", "k", "doc_id", "field", "len", F.explode(F.flatten("parts.starts")).alias("start")).groupBy("uid", "k", "doc_id", "field", "start").agg(F.count("*").alias("n"), F.max("len").alias("len")).filter("n = k")
    return single.unionAll(starts.groupBy("uid", "doc_id").agg(F.count("*").alias("tf"), F.max("len").alias("len")))


def facts_of(docs: DataFrame, access: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, modified, tokens, metas): what decides whether a request may and wants to see a document, one row each."""
    tokens = access.groupBy("doc_id").agg(F.collect_set("token").alias("tokens"))  # a document's own tokens, not a token's documents
    metas = tags.filter("kind = 'meta'").groupBy("doc_id").agg(F.collect_set("value").alias("metas"))
    return docs.select(F.col("id").alias("doc_id"), "modified").join(tokens, "doc_id").join(metas, "doc_id", "left")


def _admitted() -> str:
    return "arrays_overlap(tokens, viewer_tokens) AND (since_n IS NULL OR modified >= since_n) AND (until_n IS NULL OR modified <= until_n) AND (size(wanted) <= 0 OR coalesce(arrays_overlap(metas, wanted), false))"


def matches(searches: DataFrame, hits: DataFrame, n_docs: int, avg_len: float) -> DataFrame:
    """(sid, doc_id, score) of every distinct search with words, whoever asks it.

    ``searches``: sid, uid, occur, musts, shoulds; ``hits``: uid, doc_id, tf, len.
    """
    n = hits.groupBy("uid").agg(F.count("*").alias("n"))
    raw = F.log((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weighed = searches.join(n, "uid").withColumn("idf", F.when(raw > 0, raw).otherwise(IDF_FLOOR))
    weighed = F.broadcast(weighed) if searches.count() <= BROADCAST_REQUESTS else weighed
    gain = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg_len)))

    def of(occur: str):
        # a search's units are distinct rows, and each meets a document once
        return F.sum((F.col("occur") == occur).cast("int"))

    met = hits.join(weighed, "uid")
    per = met.groupBy("sid", "doc_id").agg(
        F.sum(F.when(F.col("occur") != MUST_NOT, gain).otherwise(0.0)).alias("score"), of(MUST).alias("must_hits"), of(SHOULD).alias("should_hits"), of(MUST_NOT).alias("not_hits"), F.max("musts").alias("musts"), F.max("shoulds").alias("shoulds")
    )
    return per.filter("must_hits = musts AND not_hits = 0 AND (shoulds = 0 OR should_hits > 0) AND musts + shoulds > 0").select("sid", "doc_id", F.round("score", DIGITS).alias("score"))


BROWSE = -1


def search(requests: DataFrame, docs: DataFrame, access: DataFrame, tags: DataFrame, post: DataFrame, stats: DataFrame) -> DataFrame:
    """(request_id, id, score) of everything each request finds, access and tags applied; refused requests find nothing.

    Equal units and equal searches go by the number of the first request that has them (``uid``, ``sid``).
    """
    key = F.concat(F.concat_ws(" ", "words"), F.when(F.col("prefix"), "*").otherwise(""))
    units = materialize(units_of(requests).withColumn("unit_key", key), "batch-units")
    known = units.filter("unit >= 0 AND NOT beyond AND NOT refused")
    distinct = materialize(known.groupBy("unit_key").agg(F.min(F.col("request_id") * 64 + F.col("unit")).alias("uid"), F.first("words").alias("words"), F.first("prefix").alias("prefix")), "batch-distinct")
    said = F.concat_ws("|", "occur", "unit_key")
    asked = units.filter("NOT beyond AND NOT refused").groupBy("request_id").agg(
        F.max("browse").alias("browse"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("unit", said.alias("said")))), lambda x: x["said"])).alias("search_key"), F.max("since_n").alias("since_n"), F.max("until_n").alias("until_n")
    )
    first = asked.filter("NOT browse").groupBy("search_key").agg(F.min("request_id").alias("sid"))
    asked = materialize(asked.join(first, "search_key", "left").select("request_id", F.when(F.col("browse"), BROWSE).otherwise(F.col("sid")).alias("sid"), "since_n", "until_n"), "batch-asked")
    own = known.join(asked.filter("sid = request_id").select("request_id", "sid"), "request_id").join(distinct.select("unit_key", "uid"), "unit_key").select("sid", "uid", "occur")
    shape = own.groupBy("sid").agg(F.sum((F.col("occur") == MUST).cast("int")).alias("musts"), F.sum((F.col("occur") == SHOULD).cast("int")).alias("shoulds"))
    searches = materialize(own.join(shape, "sid"), "batch-searches")
    hits = materialize(unit_hits(distinct.select("uid", "words", "prefix"), post), "batch-hits")
    n_docs, avg_len = stats.agg(F.count("*"), F.avg("len")).first()
    found = matches(searches, hits, n_docs, avg_len or 1.0)
    facts = materialize(facts_of(docs, access, tags), "batch-facts")
    rows = found.join(facts, "doc_id")
    if not asked.filter(F.col("sid") == BROWSE).limit(1).isEmpty():
        rows = rows.unionByName(facts.select(F.lit(BROWSE).cast("long").alias("sid"), F.lit(0.0).alias("score"), *facts.columns))
    empty = F.array().cast("array<string>")
    asks = requests.select(
        "request_id",
        token_column(viewer=F.col("viewer"), groups=F.col("groups"), circles=F.col("circles")).alias("viewer_tokens"),
        F.filter(F.coalesce("meta_tags", empty), lambda x: x.isNotNull()).alias("wanted"),
    ).join(asked, "request_id")
    if requests.count() <= BROADCAST_REQUESTS:
        met = rows.join(F.broadcast(asks), "sid")
    else:
        salted = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["sid", "salt"])
    return met.filter(_admitted()).select("request_id", F.col("doc_id").alias("id"), "score")


def pages(found: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, rank, id, score): each request's page.

    A request may find most of all documents, so its best rows are first picked within
    ``SALTS`` parts, and only what can be on the page or before it is ordered together.
    """
    limits = requests.select("request_id", F.greatest(F.lit(1), F.coalesce("size", F.lit(0))).alias("l"), F.coalesce("page", F.lit(1)).alias("p")).withColumn("o", F.greatest(F.lit(0), (F.col("p") - 1) * F.col("l")))
    best = [F.desc("score"), F.asc("id")]
    rows = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(limits, "request_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "part").orderBy(*best))).filter("rank <= o + l")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(*best))
    return rows.withColumn("rank", rank).filter("rank > o AND rank <= o + l").select("request_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def totals(found: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, total) of every request, 0 where it finds nothing."""
    return requests.select("request_id").join(found.groupBy("request_id").agg(F.count("*").alias("total")), "request_id", "left").fillna(0, ["total"])
