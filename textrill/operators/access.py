"""Access tokens: who may find a document, as flat strings o: u: g: c: and an identity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrill.errors import AccessIsEmpty

#: From so many documents on a token's documents are kept as bitmaps.
DENSE = 2_048
KINDS = {"users": "u:", "groups": "g:", "circles": "c:"}


def viewer_tokens(owner: str = "", viewer: str = "", users: Iterable = (), groups: Iterable = (), circles: Iterable = ()) -> list[str]:
    """The tokens of a person or document; links give none. An empty set is refused."""
    out = [f"o:{owner}"] if owner else []
    if viewer:
        out += [f"o:{viewer}", f"u:{viewer}"]
    for sign, members in (("u:", users), ("g:", groups), ("c:", circles)):
        out += [sign + m for m in members or () if isinstance(m, str) and m]
    out = list(dict.fromkeys(out))
    if not out:
        raise AccessIsEmpty("no access token")
    return out


def token_column(owner: Column | None = None, viewer: Column | None = None, **members: Column) -> Column:
    """The same as an array column; empty where there is no token."""

    def one(sign: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(sign), c))).otherwise(F.array().cast("array<string>"))

    parts = []
    if owner is not None:
        parts.append(one("o:", owner))
    if viewer is not None:
        parts += [one("o:", viewer), one("u:", viewer)]
    for kind, sign in KINDS.items():
        if kind in members:
            known = F.filter(F.coalesce(members[kind], F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
            parts.append(F.transform(known, _signed(sign)))
    return F.array_distinct(F.concat(*parts))


def _signed(sign: str):
    return lambda x: F.concat(F.lit(sign), x)


def visible(docs: DataFrame, access: DataFrame, tokens: list[str]) -> DataFrame:
    """The documents that one of the tokens opens, each once."""
    return docs.join(access.filter(F.col("token").isin(tokens)).select(F.col("doc_id").alias("id")), "id", "left_semi")


def rebuild(tokens: Column) -> Column:
    """Users, groups and circles of a token array; the owner comes from its own column."""

    def of(sign: str) -> Column:
        return F.transform(F.filter(tokens, lambda x: x.startswith(sign)), lambda x: F.substring(x, 3, 1_000_000))

    return F.struct(of("u:").alias("users"), of("g:").alias("groups"), of("c:").alias("circles"))


def visible_totals(viewers: DataFrame, access: DataFrame) -> DataFrame:
    """(viewer, total): how many documents each viewer may see, exactly, from (viewer, token) and (doc_id, token).

    Documents of a token become bitmaps of 32,768 ids each, so a token that opens a great part of all
    documents is a few rows to each viewer instead of a row a document; tokens of few documents
    stay rows, as a bitmap of few bits would be larger than they are.
    """
    size = access.groupBy("token").agg(F.countDistinct("doc_id").alias("n"))
    dense = size.filter(F.col("n") >= DENSE).select("token")
    placed = access.select("token", F.bitmap_bucket_number(F.col("doc_id")).alias("bucket"), F.bitmap_bit_position(F.col("doc_id")).alias("bit"))
    maps = placed.join(dense, "token", "left_semi").groupBy("token", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    many = viewers.join(maps, "token").groupBy("viewer", "bucket").agg(F.bitmap_or_agg("map").alias("map"))
    few = viewers.join(placed.join(dense, "token", "left_anti"), "token").groupBy("viewer", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    seen = many.unionByName(few).groupBy("viewer", "bucket").agg(F.bitmap_or_agg("map").alias("map"))
    return seen.groupBy("viewer").agg(F.sum(F.bitmap_count("map")).alias("total"))
