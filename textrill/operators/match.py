"""Matching and ranking of one compiled query.

Two ways with the same result:

* ``scan_hits`` reads the texts: a query is a handful of substring counts over
  padded text, all inside one generated stage, with no shuffle. The document
  frequencies of the units come from one aggregation to a single row.
* ``index_hits`` reads stored postings of the query's terms only.

BM25 is the published formula with k1 1.2 and b 0.75; idf is ln((N-n+.5)/(n+.5)),
or 1e-6 where that is not above 0. Words are counted over title and content
together, phrases within a field. Statistics are those of the whole corpus,
whoever searches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrill.functions.text import occurrences, padded, padded_words, tokens
from textrill.operators.index import TITLE
from textrill.operators.profiles import IDF_FLOOR, K1, B, bm25, profile_of  # noqa: F401 - also used from here
from textrill.plans.query import MUST_NOT, Compiled, Unit
from textrill.runtime import spread

def unit_tf(unit: Unit, fields: list[Column], words: list[Column]) -> Column:
    """How often a unit occurs in the padded ``fields``; ``words`` are the fields' token arrays for overlapping phrases."""
    if not unit.words:
        return F.lit(0)
    needle = " " + "  ".join(unit.words) + ("" if unit.prefix else " ")
    if len(unit.words) > 1 and _overlaps(unit.words):
        return reduce(lambda a, b: a + b, [_phrase_count(w, unit) for w in words])
    return reduce(lambda a, b: a + b, [occurrences(f, needle) for f in fields])


def _overlaps(words: tuple[str, ...]) -> bool:
    """Whether a phrase can begin again inside itself."""
    return any(words[i].startswith(words[0]) or words[0].startswith(words[i]) for i in range(1, len(words)))


def _phrase_count(words: Column, unit: Unit) -> Column:
    k = len(unit.words)

    def at(i: Column) -> Column:
        same = [F.get(words, i + j) == w for j, w in enumerate(unit.words[:-1])]
        last = F.get(words, i + (k - 1))
        return reduce(lambda a, b: a & b, [*same, last.startswith(unit.words[-1]) if unit.prefix else last == unit.words[-1]])

    places = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, at))


def accepts(query: Compiled, tf: dict[int, Column]) -> Column:
    """The match predicate over the units' counts, by the profile's rules."""
    return profile_of(query.profile).accepts(query, tf)


def _unit_filter(query: Compiled) -> Compiled:
    """The query without units whose words the profile does not index."""
    keeps = profile_of(query.profile).keeps
    return Compiled(query.profile, tuple(u for u in query.units if keeps(u)), query.text, query.browse)


def counted(docs: DataFrame, query: Compiled, title: str, content: str, id: str = "id") -> DataFrame:
    """(id, len, tf_0, tf_1, ...): one row a document, no shuffle."""
    needs_words = any(len(u.words) > 1 and _overlaps(u.words) for u in query.units)
    # The padded texts are computed once a row; all else is counted in them. As the output of a
    # generator they stay so: a filter on counts is not pushed below it, where it would fold the
    # text again for every count.
    made = [padded("_t").alias("f0"), padded("_c").alias("f1"), *([tokens("_t").alias("w0"), tokens("_c").alias("w1")] if needs_words else [])]
    base = spread(docs.select(F.col(id).alias("id"), F.col(title).alias("_t"), F.col(content).alias("_c"))).select("id", F.inline(F.array(F.struct(*made))))
    length = (padded_words(F.col("f0")) + padded_words(F.col("f1"))).alias("len")
    fields, words = [F.col("f0"), F.col("f1")], [F.col("w0"), F.col("w1")]
    if not profile_of(query.profile).gap:  # one vector: a phrase may cross from title to content
        base = base.withColumn("f", F.concat("f0", "f1"))
        fields, words = [F.col("f")], [F.concat(*words)]
    return base.select("id", length, *[unit_tf(u, fields, words).alias(f"tf_{i}") for i, u in enumerate(query.units)])


def score(query: Compiled, n_docs: int, avg_len: float, n: list[int]) -> Column:
    """The rank of a matched row. Excluded terms add nothing."""
    worth = profile_of(query.profile).worth
    ranked = [i for i, u in enumerate(query.units) if u.occur != MUST_NOT and u.words]
    return reduce(lambda a, b: a + b, [worth(F.col(f"tf_{i}"), F.col("len"), n_docs, avg_len, n[i]) for i in ranked], F.lit(0.0))


def scan_hits(docs: DataFrame, query: Compiled, title: str = "title", content: str = "content", id: str = "id") -> DataFrame:
    """(id, score) of the matching documents, read from the texts."""
    query = _unit_filter(query)
    if query.browse:
        return docs.select(F.col(id).alias("id"), F.lit(0.0).alias("score"))
    rows = counted(docs, query, title, content, id)
    if not query.units:
        return rows.select("id", F.lit(0.0).alias("score")).filter(F.lit(False))
    # one row of figures, however many documents
    figures = rows.agg(F.count("*"), F.avg("len"), *[F.sum((F.col(f"tf_{i}") > 0).cast("long")) for i in range(len(query.units))]).first()
    hits = rows.filter(accepts(query, {i: F.col(f"tf_{i}") for i in range(len(query.units))}))
    return hits.select("id", score(query, figures[0], figures[1], [x or 0 for x in figures[2:]]).alias("score"))


def _back(k: int):
    return lambda x: x - k


def unit_counts(post: DataFrame, query: Compiled, places: bool = False) -> DataFrame:
    """(id, len, title_len, tf_0, tf_1, ...) of the documents that hold a word of the query; one scan, one exchange.

    Positions are those in title and content together; under tsquery a phrase may run from one
    into the other, otherwise a gap between them keeps phrases within a field. With ``places``
    there is also places_i, where each unit stands.
    """
    gap = profile_of(query.profile).gap
    at = F.transform("positions", lambda x: x + F.when(F.col("field") == TITLE, 0).otherwise(F.col("title_len") + gap))
    exact, begun, columns = set(), set(), []

    def is_word(u: Unit, k: int) -> Column:
        last = u.prefix and k == len(u.words) - 1
        (begun if last else exact).add(u.words[k])
        return F.col("term").startswith(u.words[k]) if last else F.col("term") == u.words[k]

    for i, u in enumerate(query.units):
        for k in range(len(u.words)):
            if len(u.words) > 1 or places:
                columns.append(F.flatten(F.collect_list(F.when(is_word(u, k), at))).alias(f"p_{i}_{k}"))
            else:
                columns.append(F.sum(F.when(is_word(u, k), F.col("tf")).otherwise(0)).cast("int").alias(f"tf_{i}"))
    wanted = [F.col("term").isin(sorted(exact))] if exact else []
    wanted += [F.col("term").startswith(w) for w in sorted(begun)]
    rows = post.filter(reduce(lambda a, b: a | b, wanted))
    per = rows.groupBy("doc_id").agg(F.max("len").alias("_len"), F.max("title_len").alias("_title_len"), *columns)
    for i, u in enumerate(query.units):
        if not u.words:
            per = per.withColumn(f"tf_{i}", F.lit(0)).withColumn(f"places_{i}", F.array().cast("array<int>"))
        elif len(u.words) > 1 or places:
            starts = [F.transform(f"p_{i}_{k}", _back(k)) for k in range(len(u.words))]
            per = per.withColumn(f"places_{i}", reduce(F.array_intersect, starts)).withColumn(f"tf_{i}", F.size(f"places_{i}"))
    return per.select(F.col("doc_id").alias("id"), F.col("_len").alias("len"), F.col("_title_len").alias("title_len"), *[f"tf_{i}" for i in range(len(query.units))], *([f"places_{i}" for i in range(len(query.units))] if places else []))


def index_hits(post: DataFrame, stats: DataFrame, query: Compiled, corpus: DataFrame | None = None) -> DataFrame:
    """(id, score) of the matching documents, read from stored postings of the query's terms.

    ``corpus`` is the stored row of corpus figures; without it they are counted from ``stats``.
    """
    query = _unit_filter(query)
    if query.browse:
        return stats.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score"))
    units = [u for u in query.units if u.words]
    if not units:
        return stats.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score")).filter(F.lit(False))
    per = unit_counts(post, query)
    n_docs, avg_len = (corpus if corpus is not None else stats.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))).select("n_docs", "avg_len").first() or (0, None)
    # one row of figures, however many documents
    n = per.agg(*[F.sum((F.col(f"tf_{i}") > 0).cast("long")) for i in range(len(query.units))]).first()
    if all(u.occur == MUST_NOT for u in units):
        # a query of exclusions only needs the documents without any of them too
        per = stats.select(F.col("doc_id").alias("id")).join(per, "id", "left").fillna(0)
    hits = per.filter(accepts(query, {i: F.col(f"tf_{i}") for i in range(len(query.units))}))
    return hits.select("id", score(query, n_docs, avg_len, [x or 0 for x in n]).alias("score"))
