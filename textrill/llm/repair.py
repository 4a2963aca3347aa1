"""Problems 3 and 4 over tables: corpus word counts, judgement of tokens, repair, canonical text.

Repair goes from words to tokens to texts. Words are counted over all rows; each
distinct token is judged once, joined with the exact counts of the words that
its candidate repairs hold; and only texts with a suspicious token are joined with
what was found about their tokens. No table of the corpus's vocabulary is held in
a worker; suspicious tokens are broadcast up to ``BROADCAST_TOKENS`` and joined beyond.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.llm import canonical, encoding
from textrill.llm.common import materialize, spread, table

BROADCAST_TOKENS = 200_000
TOKEN = 2
_CAUSES = "array<struct<cause:string,drop:double,known:boolean,rows:double>>"
_CAUSES_ARROW = pa.list_(pa.struct([("cause", pa.string()), ("drop", pa.float64()), ("known", pa.bool_()), ("rows", pa.float64())]))


def counted(docs: DataFrame, column: str) -> DataFrame:
    """(kind, word, n, contexts): the words of all rows, kind 0 or 1 for plain ones, and the tokens that are not ASCII, kind ``TOKEN``.

    Counted per task before they are shuffled. ``contexts`` is the number of distinct
    contexts, exact up to ``CONTEXTS``: a task sends that many of a word at most, so no
    word is a hot key.
    """
    schema = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("context", pa.int64()), ("n", pa.int64())])

    def rows_of(seen, tokens):
        out = {"kind": [], "word": [], "context": [], "n": []}

        def flush():
            made = pa.RecordBatch.from_pydict(out, schema)
            for c in out.values():
                c.clear()
            return made

        for (plain, word), (n, contexts, _) in seen.items():
            # the count goes with one of the contexts
            m = len(contexts)
            out["kind"] += [int(plain)] * m
            out["word"] += [word] * m
            out["context"] += contexts
            out["n"] += [n, *[0] * (m - 1)]
            if len(out["n"]) > 50_000:
                yield flush()
        for token in tokens:
            for c, v in zip(out.values(), (TOKEN, token, 0, 1)):
                c.append(v)
        yield flush()

    def count(batches):
        seen, tokens, kept = {}, set(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                kept += encoding.count_contexts(text, seen)
                tokens.update(encoding.tokens_of(text))
                if kept + len(tokens) > 1_000_000:
                    yield from rows_of(seen, tokens)
                    seen, tokens, kept = {}, set(), 0
        yield from rows_of(seen, tokens)

    rows = spread(docs.select(column)).mapInArrow(count, "kind int, word string, context long, n long")
    once = rows.groupBy("kind", "word", "context").agg(F.sum("n").alias("n"))
    return once.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.least(F.count("*"), F.lit(encoding.CONTEXTS)).cast("int").alias("contexts"))


def word_counts(docs: DataFrame, column: str) -> DataFrame:
    """(plain, word, n, contexts): the words of all rows."""
    return counted(docs, column).filter(F.col("kind") != TOKEN).select((F.col("kind") == 1).alias("plain"), "word", "n", "contexts")


def judged(docs: DataFrame, column: str) -> DataFrame:
    """(token, fixed, how, causes, suspicious) of the distinct tokens about which there is something to say; materialized."""
    every = materialize(counted(docs, column).filter((F.col("kind") == TOKEN) | (F.col("n") >= encoding.LEAST)), "p3-words")
    words = every.filter(F.col("kind") != TOKEN).select((F.col("kind") == 1).alias("plain"), "word", "n", "contexts")

    def ask(batches):
        for batch in batches:
            out = [(t, p, w) for t in batch.column(0).to_pylist() for p, w in (encoding.words_to_judge(t) or {(False, "")})]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 3, (pa.string(), pa.bool_(), pa.string()))], ["token", "plain", "word"])

    asked = spread(every.filter(F.col("kind") == TOKEN).select("word")).mapInArrow(ask, "token string, plain boolean, word string")
    known = asked.join(words, ["plain", "word"], "left").groupBy("token").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("plain", "word", "n", "contexts"))).alias("words"))

    def judge(batches):
        for batch in batches:
            out = []
            for token, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = {(w["plain"], w["word"]): (w["n"], w["contexts"]) for w in met}
                e = encoding.Judge(encoding.WordCounts(counts)).evidence(token)
                if e.causes or e.fixed is not None or "\ufffd" in token:
                    causes = [{"cause": c, "drop": d, "known": k, "rows": r} for c, (d, k, r) in e.causes.items()]
                    out.append((token, e.fixed, e.how, causes, e.suspicious or "\ufffd" in token))
            types = (pa.string(), pa.string(), pa.string(), _CAUSES_ARROW, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 5, types)], ["token", "fixed", "how", "causes", "suspicious"])

    return materialize(known.mapInArrow(judge, f"token string, fixed string, how string, causes {_CAUSES}, suspicious boolean"), "p3-evidence")


def suspects(docs: DataFrame, key: str, column: str, suspicious: DataFrame, broadcast_tokens: int) -> DataFrame:
    """(id, text, h) of the rows with a suspicious token; h is the same for equal texts."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(column).alias("text"))
    if suspicious.count() <= broadcast_tokens:
        shared = docs.sparkSession.sparkContext.broadcast({r["token"] for r in suspicious.collect()})

        def pick(batches):
            wanted = shared.value
            for batch in batches:
                yield batch.filter(pa.array([bool(t) and not wanted.isdisjoint(encoding.tokens_of(t)) for t in batch.column(1).to_pylist()], pa.bool_()))

        return spread(rows).mapInArrow(pick, "id long, text string").withColumn("h", F.xxhash64("text"))

    def cut(batches):
        for batch in batches:
            out = [(h, t) for h, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()) for t in set(encoding.tokens_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.string())], ["h", "token"])

    hashed = rows.withColumn("h", F.xxhash64("text"))
    held = spread(hashed.select("text", "h")).mapInArrow(cut, "h long, token string").join(suspicious, "token", "left_semi").select("h").distinct()
    return hashed.join(held, "h", "left_semi").select("id", "text", "h")


def _repaired(docs: DataFrame, key: str, column: str, broadcast_tokens: int) -> DataFrame:
    """(id, garbled_tokens, layers, repaired) of the rows with a suspicious token."""
    evidence = judged(docs, column)
    found = materialize(suspects(docs, key, column, evidence.filter("suspicious").select("token"), broadcast_tokens), "p3-suspects")

    def cut(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(set(encoding.tokens_of(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["h", "tokens"])

    once = found.groupBy("h").agg(F.first("text").alias("text")).mapInArrow(cut, "h long, tokens array<string>")
    own = once.select("h", F.explode("tokens").alias("token")).join(evidence, "token").groupBy("h").agg(F.collect_list(F.struct("token", "fixed", "how", "causes")).alias("own"))

    def run(batches):
        none = encoding.Evidence(None, None, {})
        for batch in batches:
            out = []
            for text, met in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                known = {e["token"]: encoding.Evidence(e["fixed"], e["how"], {c["cause"]: (c["drop"], c["known"], c["rows"]) for c in e["causes"]}) for e in met or ()}
                out.append(encoding.repair(text, lambda t: known.get(t, none)))  # noqa: B023
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[2] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[0] for x in out], pa.string())],
                ["id", "garbled_tokens", "layers", "repaired"],
            )

    return found.join(own, "h", "left").select("id", "text", "own").mapInArrow(run, "id long, garbled_tokens int, layers array<string>, repaired string")


def repaired(docs: DataFrame, key: str, column: str, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(key, garbled_tokens, layers, repaired) of every row; null text gives null, no layers and 0."""
    done = materialize(_repaired(docs, key, column, broadcast_tokens).filter("garbled_tokens > 0"), "p3-repaired")
    rows = docs.select(F.col(key).cast("long").alias(key), F.lit(0).alias("garbled_tokens"), F.array().cast("array<string>").alias("layers"), F.col(column).alias("repaired"))
    kept = rows.join(done.select(F.col("id").alias(key)).distinct(), key, "left_anti")
    return kept.unionAll(done.withColumnRenamed("id", key))


def garbled(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key) of the rows whose text holds wrongly decoded characters."""
    return _repaired(docs, key, column, BROADCAST_TOKENS).filter("garbled_tokens > 0").select(F.col("id").alias(key))


def canonical_text(docs: DataFrame, key: str, columns: list[str], garbled_column: str | None = None) -> DataFrame:
    """(key, field, canonical, kinds): one row a field, with the kinds of change it needed.

    ``kinds`` is empty where the text already had the one form; null and empty texts keep
    their value. With ``garbled_column`` there is ``garbled`` too: whether that column of
    the row was wrongly decoded, which is another fault.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [batch.column(1 + i).to_pylist() for i in range(len(columns))]
            out = {"id": [], "field": [], "canonical": [], "kinds": []}
            for r, k in enumerate(ids):
                for i, name in enumerate(columns):
                    text, kinds = canonical.canonicalize(texts[i][r])
                    for c, v in zip(out, (k, name, text, list(kinds))):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("field", pa.string()), ("canonical", pa.string()), ("kinds", pa.list_(pa.string()))]))

    rows = spread(docs.select(F.col(key).cast("long").alias("id"), *columns)).mapInArrow(run, "id long, field string, canonical string, kinds array<string>")
    if garbled_column is not None:
        wrong = garbled(docs, key, garbled_column).select(F.col(key).alias("id")).distinct().withColumn("garbled", F.lit(True))
        rows = rows.join(wrong, "id", "left").fillna(False, ["garbled"])
    return rows.withColumnRenamed("id", key)


def p3_found(spark, sf_dir):
    """(id) of rows of index_documents with wrongly decoded text."""
    return garbled(table(spark, sf_dir, "index_documents"), "id", "content_norm")


def p3_repaired(spark, sf_dir):
    """Every garbled row with the layers undone and its text given back as far as it still can be."""
    return _repaired(table(spark, sf_dir, "index_documents"), "id", "content_norm", BROADCAST_TOKENS).filter("garbled_tokens > 0")


def p4_found(spark, sf_dir):
    """(id, field) of the texts that look ordinary but hold other characters."""
    docs = table(spark, sf_dir, "index_documents")
    rows = canonical_text(docs, "id", ["title_norm", "content_norm"]).filter("size(kinds) > 0").select("id", F.regexp_replace("field", "_norm$", "").alias("field"))
    return rows.join(garbled(docs, "id", "content_norm").select("id"), "id", "left_anti")


def p4_canonical(spark, sf_dir):
    """Both fields of every row in the one form."""
    rows = canonical_text(table(spark, sf_dir, "index_documents"), "id", ["title_norm", "content_norm"])
    return rows.select("id", "field", "canonical", "kinds")
