"""Connected components of a graph that fits no single machine.

Alternating large-star and small-star steps (Kiveris et al., 2014). The graph
stays a table of edges; every round is written to the shared folder, so the
lineage stays short and a lost executor costs one round at most. No links are
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.llm.common import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link each node's neighbours to the smallest of them (and the node itself)."""
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of the edges (a, b): the root is the smallest node reachable. Null ends are left out."""
    now = materialize(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = print_of(now)
    for _ in range(MAX_ROUNDS):
        now = materialize(_star(_star(now, True), False), "edges")
        then, mark = mark, print_of(now)
        if then == mark:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
