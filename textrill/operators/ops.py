"""Writes and upkeep: replace, delete, reset, document lookup, staleness, causes, health.

Plain Parquet has no merge, so the store is an operation log: the last operation
of a document decides. Ties are settled by the log's own order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrill.errors import UnknownDocument
from textrill.operators.access import rebuild, token_column
from textrill.operators.index import stale

KEY = ["provider_id", "document_id"]


def mapped(changes: DataFrame) -> DataFrame:
    """Input documents as rows to store: tokens, tags and empty-to-null owner and hash; documents without a token are refused (flag)."""
    tokens = token_column(owner=F.col("owner"), users=F.col("users"), groups=F.col("groups"), circles=F.col("circles"))
    tags = F.transform(F.array_distinct(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))), lambda x: F.struct(F.lit("meta").alias("kind"), x.alias("value")))
    return changes.withColumn("tokens", tokens).withColumn("tag_rows", tags).withColumn("owner", F.nullif("owner", F.lit(""))).withColumn("hash", F.nullif("hash", F.lit(""))).withColumn("modified", F.coalesce("modified", F.lit(0))).withColumn("refused", (F.col("op") == "index") & (F.size("tokens") == 0))


def last_wins(log: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """The last row of each key. An aggregation that keeps one row a key on the map side, so a key with very many versions is no skew."""
    others = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others])


def snapshot(log: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """What is stored after the log: the last operation of each document, deletes left out."""
    return last_wins(log, order, key).filter("op = 'index'")


def replaced(stored: DataFrame, incoming: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Stored rows with the incoming ones in place of those of the same key."""
    return stored.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def without_stale_versions(docs: DataFrame, order: list[str]) -> DataFrame:
    """One row a document where a replace left the old row behind."""
    return last_wins(docs, order)


def delete_document(docs: DataFrame, provider: str, document: str) -> DataFrame:
    return docs.filter(~((F.col("provider_id") == provider) & (F.col("document_id") == document)))


def delete_provider(docs: DataFrame, provider: str) -> DataFrame:
    return docs.filter(F.col("provider_id") != provider)


def delete_all(docs: DataFrame) -> DataFrame:
    return docs.filter(F.lit(False))


def reset(docs: DataFrame, provider: str) -> DataFrame:
    """'all' empties the store, another name only that provider."""
    return delete_all(docs) if provider == "all" else delete_provider(docs, provider)


def delete_list(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows left, (key, deleted)): deletes a list of documents, with the outcome of each."""
    wanted = keys.select(*KEY).distinct()
    outcome = wanted.join(docs.select(*KEY).distinct().withColumn("deleted", F.lit(True)), KEY, "left").fillna(False, ["deleted"])
    return docs.join(wanted, KEY, "left_anti"), outcome


def orphans(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Access or tag rows whose document is gone."""
    return rows.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def get_document(docs: DataFrame, access: DataFrame, provider: str, document: str) -> DataFrame:
    """The stored row with users, groups and circles given back; unknown raises UnknownDocument."""
    row = docs.filter((F.col("provider_id") == provider) & (F.col("document_id") == document))
    newest = row.orderBy(F.desc("id")).limit(1)
    if newest.isEmpty():
        raise UnknownDocument(f"{provider}/{document}")
    return with_access(newest, access)


def with_access(docs: DataFrame, access: DataFrame) -> DataFrame:
    """Documents with the users, groups and circles their tokens name, each sorted."""
    mine = access.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    tokens = mine.groupBy("doc_id").agg(F.sort_array(F.collect_set("token")).alias("tokens")).select(F.col("doc_id").alias("id"), rebuild(F.col("tokens")).alias("m"))
    empty = F.array().cast("array<string>")
    return docs.join(tokens, "id", "left").select(*docs.columns, *[F.coalesce(f"m.{k}", empty).alias(k) for k in ("users", "groups", "circles")])


def causes(docs: DataFrame) -> DataFrame:
    """(extraction_cause, n) of the rows with a gap in their text."""
    return docs.filter("extraction_cause IS NOT NULL").groupBy("extraction_cause").agg(F.count("*").alias("n"))


def engine_ceiling(docs: DataFrame, column: str, most_bytes: int, halvings: int = 4) -> DataFrame:
    """``docs`` with the text halved, at a character, until the bytes of its distinct words fit, four times at most.

    Adds ``ceiling``: whether the text was cut. Null stays null. One step is one column, so
    the text is not cut again for every reference to it.
    """
    from textrill.functions.text import tokens

    out = docs.withColumn("_full", F.octet_length(column))
    for _ in range(halvings):
        size = F.aggregate(F.array_distinct(tokens(column)), F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
        # a word costs its bytes and 8 more, so a text of under a fifth of the limit cannot pass it
        out = out.withColumn("_size", F.when(F.octet_length(column) * 5 > most_bytes, size)).withColumn("_half", F.floor(F.octet_length(column) / 2).cast("int"))
        raw = F.encode(column, "UTF-8")
        cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.col("_half") - k).cast("string")) for k in range(4)])
        out = out.withColumn(column, F.when(F.col("_size") > most_bytes, cut).otherwise(F.col(column)))
    return out.withColumn("ceiling", F.coalesce(F.octet_length(column) < F.col("_full"), F.lit(False))).drop("_size", "_half", "_full")


def health(docs: DataFrame, index_ready: bool, profile_known: bool = True, usable: bool = True) -> DataFrame:
    """One row: state engine, unusable, missing, stale or ready, the first that applies; counts ride along."""
    spark = docs.sparkSession
    if not profile_known:
        state = "engine"
    elif not usable:
        state = "unusable"
    elif not index_ready:
        state = "missing"
    else:
        state = "stale" if not stale(docs).limit(1).isEmpty() else "ready"
    counts = causes(docs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("extraction_cause", "n")))).alias("causes"))
    return counts.select(F.lit(state).alias("state"), "causes") if spark else counts


def versions(docs: DataFrame) -> DataFrame:
    """(provider_id, document_id, rows, newest): documents stored more than once."""
    return docs.groupBy(*KEY).agg(F.count("*").alias("rows"), F.max("id").alias("newest")).filter("rows > 1")


def history(log: DataFrame, order: list[str]) -> DataFrame:
    """The log with each document's operation number and whether it is a repeat of the one before."""
    w = Window.partitionBy(*KEY).orderBy(*order)
    return log.withColumn("nth", F.row_number().over(w)).withColumn("repeat", F.coalesce((F.lag("hash").over(w) == F.col("hash")) & (F.lag("op").over(w) == F.col("op")), F.lit(False)))
