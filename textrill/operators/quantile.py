"""Exact values at given ranks of each group, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 64


def at_ranks(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, *shares): for each share q the value at index floor(q n), n - 1 at most, of the group's sorted values.

    Approximate split points cut each group into slices; counts of the slices tell which one holds a
    rank, and only that slice is looked into, as counts of its distinct values. Null values are left
    out; a group of nulls only has no row.
    """
    rows = rows.select(key, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    splits = rows.groupBy(key).agg(F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 1000).alias("_s"), F.count("*").alias("_n"))
    placed = rows.join(splits, key).withColumn("_b", F.size(F.filter("_s", lambda s: s < F.col("_v"))))
    counted = placed.groupBy(key, "_b", "_v").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    slices = counted.groupBy(key, "_b").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n"))  # SPLITS rows a group
    ends = slices.withColumn("_end", F.sum("_c").over(Window.partitionBy(key).orderBy("_b"))).withColumn("_before", F.col("_end") - F.col("_c"))
    wanted = ends.select(key, "_b", "_before", "_end", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1).alias("rank")) for k, q in shares.items()])).alias("_w"))
    wanted = wanted.filter("_w.rank >= _before AND _w.rank < _end").select(key, "_b", "_before", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"))
    upto = F.sum("_c").over(Window.partitionBy(key, "_b").orderBy("_v"))
    inner = counted.join(wanted.select(key, "_b").distinct(), [key, "_b"], "left_semi").withColumn("_upto", upto)
    found = inner.join(wanted, [key, "_b"]).filter("_before + _upto > _rank AND _before + _upto - _c <= _rank")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in shares])
