"""Mixing sources to target shares (problem 7).

Capped water-filling: of a wanted total, each source gets its share; a source
that would have to be repeated more than ``max_repeats`` times is clamped there,
and what it cannot give is spread over the others in proportion to their shares,
until all are feasible. A source's amount divided by its tokens is its epochs:
each of its documents is taken floor(epochs) times, and a seeded sample of them
once more, so that the sample's tokens come to the remaining fraction.

Only one row a source is ever on the driver. The fraction is sampled by a seeded
hash: documents are added up in ``SLICES`` slices of hash order, whole slices are
taken up to the boundary, and only the boundary slice is ordered document by
document. A source holding most of all rows is thereby spread over its slices.

Sources without a target, null sources among them, are not used (0 repeats). Targets without text, or with a
cap of 0, get share 0, and if the caps together cannot give the total, every
source is used to its cap. Empty texts count no tokens and come with whole epochs only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrill.llm.common import materialize, table
from textrill.llm.tokens import token_counts

SLICES = 4096
SEED = 17
MAX_SOURCES = 100_000


def water_fill(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source: proportional to the shares, none above its cap, together ``total`` where the caps allow."""
    amount = {s: 0.0 for s in shares}
    most = {s: float(sizes.get(s, 0)) * max(caps.get(s) or 0, 0) for s in shares}
    free = {s for s in shares if most[s] > 0 and (shares[s] or 0) > 0}
    left = float(total)
    while free and left > 0:
        weight = math.fsum(shares[s] for s in free)
        over = {s for s in free if left * shares[s] / weight >= most[s]}
        if not over:
            for s in free:
                amount[s] = left * shares[s] / weight
            break
        for s in over:
            amount[s] = most[s]
        left -= math.fsum(most[s] for s in over)
        free -= over
    return amount


def plan(counts: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """One entry for each target: tokens there are, wanted, epochs (whole and fraction). Sizes are aggregated first."""
    rows = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources")
    wanted = [r["source"] for r in rows]
    per_source = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    named = counts.sparkSession.createDataFrame([(s,) for s in wanted], "source string")
    sizes = {r["source"]: int(r["tokens"] or 0) for r in per_source.join(F.broadcast(named), "source", "left_semi").collect()}  # a row a target
    if total is None:
        total = float(counts.agg(F.sum("tokens")).first()[0] or 0)
    shares = {r["source"]: float(r["target_share"] or 0) for r in rows}
    amount = water_fill(sizes, shares, {r["source"]: r["max_repeats"] for r in rows}, total)
    out = []
    for r in rows:
        s, n = r["source"], sizes.get(r["source"], 0)
        epochs = amount[s] / n if n else 0.0
        whole = int(epochs + 1e-9)
        out.append({"source": s, "target_share": shares[s], "max_repeats": int(r["max_repeats"] or 0), "available": n, "wanted": amount[s], "whole": whole, "part": int(round(max(0.0, epochs - whole) * n))})
    return out


def mix(counts: DataFrame, key: str, planned: list[dict], seed: int = SEED) -> DataFrame:
    """(key, source, tokens, repeats) for every row of ``counts`` (key, source, tokens), a materialized table."""
    spark = counts.sparkSession
    counts = counts.select(key, "source", "tokens")  # other columns, whatever their names, play no part
    entries = [(p["source"], p["whole"], p["part"]) for p in planned]
    per = F.broadcast(spark.createDataFrame(entries, "source string, whole int, part long"))  # a row a target
    placed = counts.join(per, "source", "left").withColumn("h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("slice", F.pmod(F.shiftrightunsigned("h", 40), F.lit(SLICES)).cast("int"))
    # how many tokens of the source lie in slices before this one: SLICES rows a source
    sums = placed.filter("part > 0").groupBy("source", "slice", "part").agg(F.sum("tokens").alias("in_slice"))
    upto = F.sum("in_slice").over(Window.partitionBy("source").orderBy("slice"))
    edges = sums.withColumn("end", upto).withColumn("before", F.col("end") - F.col("in_slice"))
    # the boundary slice of each source, with the tokens still to take from it
    edge = edges.filter("before < part AND end >= part").select("source", F.col("slice").alias("edge"), (F.col("part") - F.col("before")).alias("room"))
    placed = placed.join(F.broadcast(edge), "source", "left")  # at most a row a target
    ordered = Window.partitionBy("source", "slice").orderBy("h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = placed.filter("slice = edge AND part > 0").withColumn("running", F.sum("tokens").over(ordered))
    # half a document over or under, whichever is nearer
    edge_rows = at_edge.withColumn("extra", F.when((F.col("tokens") > 0) & (F.col("running") - F.col("tokens") / 2 <= F.col("room")), 1).otherwise(0))
    other = placed.filter("NOT coalesce(slice = edge AND part > 0, false)").withColumn("extra", F.when((F.col("part") > 0) & (F.col("tokens") > 0) & (F.col("edge").isNull() | (F.col("slice") < F.col("edge"))), 1).otherwise(0))
    columns = [key, "source", "tokens", (F.coalesce("whole", F.lit(0)) + F.col("extra")).cast("int").alias("repeats")]
    return edge_rows.select(*columns).unionAll(other.select(*columns))


def _mixed(spark, sf_dir) -> tuple[DataFrame, list[dict]]:
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]), "p7-counts")
    planned = plan(counts, table(spark, sf_dir, "mix_targets"))
    return mix(counts, "doc_id", planned), planned


def p7_mixture(spark, sf_dir):
    """Every document with how many times the mixture uses it."""
    return _mixed(spark, sf_dir)[0]


def p7_report(spark, sf_dir):
    """For each target: tokens there are, wanted and taken, and the share reached."""
    mixed, planned = _mixed(spark, sf_dir)
    rows = [(p["source"], p["target_share"], p["max_repeats"], p["available"], p["wanted"]) for p in planned]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available long, wanted double")
    taken = mixed.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("taken"), F.max("repeats").alias("most_repeats"))
    all_taken = F.sum("taken").over(Window.partitionBy(F.lit(1)))
    joined = targets.join(taken, "source", "left").fillna(0, ["taken", "most_repeats"])  # a row a target from here on
    return joined.withColumn("share", F.coalesce(F.col("taken") / F.nullif(all_taken, F.lit(0)), F.lit(0.0)))
