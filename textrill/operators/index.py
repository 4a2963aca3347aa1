"""The inverted index: postings with positions, document lengths, corpus figures.

Postings are ordered by term and document when they are stored, so that row groups
are pruned by the term filter and the postings of one term fill as many files as
they need; texts are not repeated in them. Each posting carries the length of its
document, so ranking joins nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.functions.text import tokens, word_count
from textrill.runtime import spread

TITLE, CONTENT = 0, 1


def postings(docs: DataFrame, title: str = "title", content: str = "content", id: str = "id") -> DataFrame:
    """(term, doc_id, field, tf, positions, len, title_len) of all documents; fields without words have none.

    Counted inside the row: the words of a field are sorted with their positions and cut
    where the word changes, so nothing is shuffled, and a long text costs one sort.
    """
    cut = spread(docs.select(id, title, content)).select(F.col(id).alias("doc_id"), F.inline(F.array(F.struct(tokens(title).alias("_t"), tokens(content).alias("_c")))))
    lengths = cut.select("doc_id", (F.size("_t") + F.size("_c")).alias("len"), F.size("_t").alias("title_len"), F.posexplode(F.array("_t", "_c")).alias("field", "words"))
    placed = lengths.filter(F.size("words") > 0).withColumn("s", F.array_sort(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("pos")))))
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["term"] != F.get("s", i - 1)["term"]))
    runs = placed.select("doc_id", "field", "len", "title_len", "s", F.inline(F.array(F.struct(starts.alias("starts"), F.transform("s", lambda x: x["pos"]).alias("pos")))))
    grouped = F.transform("starts", lambda p, j: F.struct(F.get("s", p)["term"].alias("term"), F.slice("pos", p + 1, F.coalesce(F.get("starts", j + 1), F.size("s")) - p).alias("positions")))
    return runs.select("doc_id", "field", "len", "title_len", F.inline(grouped)).select("term", "doc_id", "field", F.size("positions").alias("tf"), "positions", "len", "title_len")


def doc_stats(docs: DataFrame, title: str = "title", content: str = "content", id: str = "id") -> DataFrame:
    """(doc_id, len): words of title and content together."""
    return docs.select(F.col(id).alias("doc_id"), (word_count(title) + word_count(content)).cast("int").alias("len"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    per_doc = post.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len."""
    return stats.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def stale(docs: DataFrame, title_norm: str = "title_norm", content_norm: str = "content_norm") -> DataFrame:
    """Rows stored but not indexed: both searched columns are null."""
    return docs.filter(F.col(title_norm).isNull() & F.col(content_norm).isNull())


def write_postings(docs: DataFrame, folder: str, title: str = "title", content: str = "content", id: str = "id") -> None:
    """Stores postings, range-partitioned and sorted by term and document."""
    postings(docs, title, content, id).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id", "field").write.mode("overwrite").parquet(f"{folder}/postings")


def write_stats(docs: DataFrame, folder: str, title: str = "title", content: str = "content", id: str = "id") -> None:
    """Stores document lengths."""
    doc_stats(docs, title, content, id).write.mode("overwrite").parquet(f"{folder}/doc_stats")


def write(docs: DataFrame, folder: str, title: str = "title", content: str = "content", id: str = "id") -> None:
    """Stores the whole index: postings, document lengths and corpus figures."""
    write_postings(docs, folder, title, content, id)
    write_stats(docs, folder, title, content, id)
    corpus_stats(docs.sparkSession.read.schema("doc_id long, len int").parquet(f"{folder}/doc_stats")).write.mode("overwrite").parquet(f"{folder}/corpus")


def ensure(spark, folder: str) -> bool:
    """Whether the stored index exists; never raises."""
    try:
        return spark.read.parquet(f"{folder}/postings").columns == ["term", "doc_id", "field", "tf", "positions", "len", "title_len"] and bool(spark.read.parquet(f"{folder}/doc_stats").columns)
    except Exception:  # noqa: BLE001 - a missing index is an answer, not a failure
        return False
