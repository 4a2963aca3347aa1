"""Cover-density rank (Clarke, Cormack and Tudhope, 2000), for the tsquery profile.

A cover is a shortest stretch of a document that satisfies the query. Each adds
the harmonic mean of its words' weights (title 1.0, content 0.4), divided by one
more than the words in it that are no part of the query. Only matching documents
are ranked, over the places of the query's words, which come from the postings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.operators.match import accepts, index_hits, unit_counts
from textrill.plans.query import MUST, MUST_NOT, SHOULD, Compiled

TITLE_WEIGHT, CONTENT_WEIGHT = 1.0, 0.4


def satisfied(present: set[int], query: Compiled) -> bool:
    should = [i for i, u in enumerate(query.units) if u.occur == SHOULD]
    must = [i for i, u in enumerate(query.units) if u.occur == MUST]
    return all(i in present for i in must) and (not should or any(i in present for i in should)) and bool(present)


def density(hits: list[tuple[int, int, float]], query: Compiled) -> float:
    """The rank of one document from its hits (place, unit, weight)."""
    hits = sorted(hits)
    total, start = 0.0, 0
    counts: dict[int, int] = {}
    for end, (_, unit, _) in enumerate(hits):
        counts[unit] = counts.get(unit, 0) + 1
        if not satisfied(set(counts), query):
            continue
        while True:  # the shortest stretch that ends here
            first = hits[start][1]
            without = set(counts) - ({first} if counts[first] == 1 else set())
            if not satisfied(without, query):
                break
            counts[first] -= 1
            if not counts[first]:
                del counts[first]
            start += 1
        inside = hits[start : end + 1]
        noise = max(0, inside[-1][0] - inside[0][0] + 1 - len({p for p, *_ in inside}))
        total += len(inside) / sum(1 / w for *_, w in inside) / (1 + noise)
        first = hits[start][1]
        counts[first] -= 1
        if not counts[first]:
            del counts[first]
        start += 1
    return total


def cover_hits(post: DataFrame, stats: DataFrame, query: Compiled) -> DataFrame:
    """(id, score) of the matching documents by cover density, from stored postings; queries of exclusions only score 0."""
    if query.browse or not any(u.words for u in query.units):
        return stats.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score")).filter(F.lit(query.browse))
    ranked = [(i, u) for i, u in enumerate(query.units) if u.occur != MUST_NOT and u.words]
    if not ranked:
        return index_hits(post, stats, query)
    rows = unit_counts(post, query, places=True)
    matched = rows.filter(accepts(query, {i: F.col(f"tf_{i}") for i in range(len(query.units))}))
    placed = matched.select("id", "title_len", F.array(*[F.col(f"places_{i}") for i, _ in ranked]).alias("places"))

    def rank(batches):
        for batch in batches:
            scores = []
            for n, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hits = [(p + j, i, TITLE_WEIGHT if p + j < n else CONTENT_WEIGHT) for (i, u), at in zip(ranked, places) for p in at for j in range(len(u.words))]
                scores.append(density(hits, query))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return placed.mapInArrow(rank, "id long, score double")
