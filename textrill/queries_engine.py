"""Queries over the engine's whole life: writes, searches after writes, settings, refusals, sources, streams and formats.

Registered beside those of ``queries``. What the tables cannot decide is compared with stated values.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.config import Config, offered
from textrill.engine import SearchEngine
from textrill.errors import UnsupportedCapability
from textrill.extract import samples
from textrill.functions import text as X
from textrill.operators import batch, blocks, index, ops, search
from textrill.plans.query import Request, compile_query, parse
from textrill.queries import _BLANK_LINES, _LINES, CONTENT, TITLE, _docs, _round_trip, _sql, _stored, _tables, query, stored_index
from textrill.runtime import forget_at_exit, shared_dir, table
from textrill.sources import documents as sources
from textrill.sources.store import Store


def _folder(spark, name: str) -> str:
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    forget_at_exit(spark, folder)
    return folder


def _values(rows: list[tuple], names: str) -> str:
    def one(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


# search strings, parsed in SQL on its own


_PARSED = f"""pieces AS (SELECT request_id, unnest(p) AS piece, generate_subscripts(p, 1) AS nth FROM (SELECT request_id, regexp_extract_all(coalesce(search, ''), '[+-]?"[^"]*"|[+-]?\\S+') AS p FROM search_requests)),
    signed AS (SELECT *, regexp_full_match(piece, '[+-]?"[^"]*"') AS phrase, CASE WHEN length(piece) > 1 AND piece[1] IN ('+', '-') THEN piece[1] ELSE '' END AS sign FROM pieces),
    said AS (SELECT request_id, nth, phrase, CASE sign WHEN '+' THEN 'must' WHEN '-' THEN 'must_not' ELSE 'should' END AS occur,
      CASE WHEN phrase THEN regexp_replace(piece[length(sign) + 2:length(piece) - 1], '\\s+', ' ', 'g') ELSE piece[length(sign) + 1:] END AS value FROM signed),
    terms AS (SELECT * FROM said WHERE trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY nth DESC) <= 64),
    units AS (SELECT request_id, nth, occur, {X.sql_tokens('value')} AS words,
      nth = max(CASE WHEN NOT phrase AND occur = 'should' THEN nth END) OVER (PARTITION BY request_id) AS prefix FROM terms),
    numbers AS (SELECT *, '[ \\t\\n\\r\\v\\f]*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n\\r\\v\\f]*' AS number FROM search_requests),
    asks AS (SELECT request_id, viewer, groups, circles, meta_tags, greatest(1, coalesce(size, 0))::BIGINT AS l, greatest(0, (coalesce(page, 1) - 1) * greatest(1, coalesce(size, 0)))::BIGINT AS o,
      len(list_distinct(coalesce(limit_fields, []))) > 0 AND NOT (list_contains(limit_fields, 'title') AND list_contains(limit_fields, 'content')) AS refused,
      CASE WHEN regexp_full_match(since, number) THEN trunc(since::DOUBLE)::BIGINT END AS since_n, CASE WHEN regexp_full_match(until, number) THEN trunc(until::DOUBLE)::BIGINT END AS until_n FROM numbers)"""

_FOUND = f"""{_PARSED},
    cut AS (SELECT id, {X.sql_tokens(TITLE)} AS tt, {X.sql_tokens(CONTENT)} AS ct FROM index_documents),
    tok AS (SELECT id, 0 AS f, unnest(tt) AS term, generate_subscripts(tt, 1) AS pos FROM cut UNION ALL SELECT id, 1, unnest(ct), generate_subscripts(ct, 1) FROM cut),
    kinds AS (SELECT DISTINCT words, coalesce(prefix, false) AS prefix FROM units WHERE len(words) > 0),
    places AS (SELECT words, prefix, len(words) AS k, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS nth FROM kinds),
    dict AS (SELECT DISTINCT term FROM tok),
    wanted AS (SELECT words, prefix, k, nth, word AS term FROM places WHERE NOT (prefix AND nth = k - 1) UNION ALL SELECT words, prefix, k, nth, term FROM places JOIN dict ON starts_with(term, word) WHERE prefix AND nth = k - 1),
    starts AS (SELECT words, prefix, k, id, f, pos - nth AS start, count(DISTINCT nth) AS n FROM wanted JOIN tok USING (term) GROUP BY 1, 2, 3, 4, 5, 6),
    hits AS (SELECT words, prefix, id, count(*) AS tf FROM starts WHERE n = k GROUP BY 1, 2, 3),
    known AS (SELECT words, prefix, count(*) AS n FROM hits GROUP BY 1, 2),
    fig AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(tt) + len(ct)) AS avg_len FROM cut),
    shape AS (SELECT request_id, count(*) FILTER (occur = 'must') AS musts, count(*) FILTER (occur = 'should') AS shoulds FROM units GROUP BY 1),
    per AS (SELECT request_id, id, sum(CASE WHEN occur = 'must_not' THEN 0 ELSE greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(tt) + len(ct)) / avg_len)) END) AS score,
      count(*) FILTER (occur = 'must') AS m, count(*) FILTER (occur = 'should') AS s, count(*) FILTER (occur = 'must_not') AS x
      FROM units u JOIN hits h ON h.words = u.words AND h.prefix = coalesce(u.prefix, false) JOIN known k ON k.words = h.words AND k.prefix = h.prefix JOIN cut USING (id), fig GROUP BY 1, 2),
    matched AS (SELECT request_id, id, round(score, 6) AS score FROM per JOIN shape USING (request_id) WHERE m = musts AND x = 0 AND (shoulds = 0 OR s > 0) AND musts + shoulds > 0
      UNION ALL SELECT request_id, id, 0 FROM search_requests r, index_documents WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.request_id = r.request_id)),
    keys AS (SELECT request_id, unnest(list_concat(CASE WHEN coalesce(viewer, '') <> '' THEN ['o:' || viewer, 'u:' || viewer] ELSE []::VARCHAR[] END,
      list_transform(list_filter(coalesce(groups, []), lambda x: x <> ''), lambda x: 'g:' || x), list_transform(list_filter(coalesce(circles, []), lambda x: x <> ''), lambda x: 'c:' || x))) AS token FROM asks),
    visible AS (SELECT DISTINCT request_id, doc_id AS id FROM keys JOIN index_access USING (token)),
    found AS (SELECT m.request_id, m.id, m.score FROM matched m JOIN visible USING (request_id, id) JOIN asks a ON a.request_id = m.request_id JOIN index_documents d ON d.id = m.id
      WHERE o <= 100000 AND NOT refused AND (since_n IS NULL OR modified >= since_n) AND (until_n IS NULL OR modified <= until_n)
      AND (len(list_filter(coalesce(meta_tags, []), lambda x: x IS NOT NULL)) = 0 OR EXISTS (SELECT 1 FROM index_tags t WHERE t.doc_id = m.id AND t.kind = 'meta' AND list_contains(meta_tags, t.value))))"""


@query(f"WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank FROM found) SELECT request_id, rank::INT AS rank, id, score FROM r JOIN asks USING (request_id) WHERE rank > o AND rank <= o + l")
def batch_pages(spark, d):
    """The page of every request of search_requests, over all rows."""
    return blocks.pages(table(spark, d, "search_requests"), *_tables(spark, d), TITLE, CONTENT)


@query(f"WITH {_FOUND} SELECT r.request_id, count(f.id) AS total FROM search_requests r LEFT JOIN found f USING (request_id) GROUP BY 1")
def batch_totals(spark, d):
    """The exact total of every request of search_requests."""
    return blocks.totals(table(spark, d, "search_requests"), *_tables(spark, d), TITLE, CONTENT)


@query(f"WITH {_PARSED} SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY nth) - 1)::INT AS unit, array_to_string(words, ' ') AS words, coalesce(prefix, false) AS prefix, occur FROM units")
def parsed_requests(spark, d):
    """Every request's search string cut into units."""
    units = batch.units_of(table(spark, d, "search_requests")).filter("unit >= 0")
    return units.select("request_id", "unit", F.concat_ws(" ", "words").alias("words"), "prefix", "occur")


@query(f"WITH {_PARSED} SELECT request_id, l AS \"limit\", o AS \"offset\", o > 100000 AS beyond, refused, since_n, until_n FROM asks")
def request_options(spark, d):
    """Paging, refusal of partial limit fields and numeric dates of every request."""
    return batch.units_of(table(spark, d, "search_requests")).select("request_id", "limit", "offset", "beyond", "refused", "since_n", "until_n").distinct()


@query("SELECT request_id, trim(translate(coalesce(search, ''), '+-\"', repeat(chr(32), 3))) AS label FROM search_requests")
def excerpt_labels(spark, d):
    """The words each request's excerpts are labelled with."""
    rows = table(spark, d, "search_requests").select("request_id", F.coalesce("search", F.lit("")).alias("s"))

    def label(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([search.excerpt_label(s) for s in b.column(1).to_pylist()], pa.string())], ["request_id", "label"])

    return rows.mapInArrow(label, "request_id long, label string")


_EXAMPLES = [
    ('+museu "sortida escolar" -pis mun', "fts5", '("sortida escolar" OR "mun"*) AND "museu" NOT "pis"'),
    ('+museu "sortida escolar" -pis mun', "tsquery", "(sortida <-> escolar | mun:*) & museu & !(pis)"),
    ('+museu "sortida escolar" -pis mun', "boolean", '+museu "sortida escolar" -pis mun*'),
    ("-a -b", "fts5", '"" NOT "a" NOT "b"'),
    ("-a -b", "tsquery", "!(a) & !(b)"),
    ("-a -b", "boolean", "-a -b"),
    ("informe.pdf", "fts5", '("informe.pdf"*)'),
    ("informe.pdf", "tsquery", "(informe.pdf:*)"),
    ("a-b", "boolean", "ab*"),
    ('foo"bar', "fts5", '("foo""bar"*)'),
    ('""', "fts5", ""),
]


@query(_values(_EXAMPLES, "search, profile, compiled"))
def compiled_text(spark, d):
    """Searches in the query language of each profile."""
    return spark.createDataFrame([(s, p, compile_query(s, p).text) for s, p, _ in _EXAMPLES], "search string, profile string, compiled string")


@query("SELECT (i - 6)::INT AS at, 'w' || i AS value FROM range(6, 70) t(i)")
def term_cap(spark, d):
    """Of 70 words the last 64 are kept."""
    return spark.createDataFrame([(i, t.value) for i, t in enumerate(parse(" ".join(f"w{i}" for i in range(70))))], "at int, value string")


_REFUSED = [("regex_filters", True), ("wildcard_filters", True), ("sub_tags", True), ("simple_queries", True), ("limit_fields title", True), ("limit_fields title content", False), ("limit_fields", False), ("widening", False)]


@query(_values(_REFUSED, "capability, refused"))
def refusals(spark, d):
    """What would narrow a result is refused; what widens it is skipped."""

    def refused(name: str) -> bool:
        key, *fields = name.split()
        value = {"x": 1} if key == "widening" else tuple(fields) if key == "limit_fields" else ("x",)
        try:
            Request("a", **{key: value}).checked()
            return False
        except UnsupportedCapability:
            return True

    return spark.createDataFrame([(n, refused(n)) for n, _ in _REFUSED], "capability string, refused boolean")


_SETTINGS = [("language unknown, stored", "simple"), ("language unknown, set", "refused"), ("bytes 0, stored", "1"), ("bytes 0, set", "refused"), ("bytes 10, set", "10"), ("offered first", "simple"), ("order", "simple a b")]


@query(_values(_SETTINGS, "setting, outcome"))
def settings(spark, d):
    """Settings fall back when stored, are refused when set, and languages come in order."""

    def outcome(f) -> str:
        try:
            return str(f())
        except ValueError:
            return "refused"

    got = [Config(language="klingon").language, outcome(lambda: Config().with_language("klingon").language), str(Config(content_bytes=0).content_bytes), outcome(lambda: Config().with_content_bytes(0).content_bytes), outcome(lambda: Config().with_content_bytes(10).content_bytes), offered()[0], " ".join(offered(["b", "simple", "a"]))]
    return spark.createDataFrame([(n, v) for (n, _), v in zip(_SETTINGS, got)], "setting string, outcome string")


# the engine over all rows


_engines: dict[tuple[str, str], tuple[SearchEngine, DataFrame]] = {}


def _input(spark, d) -> DataFrame:
    """index_documents as input documents: their stored text as a .txt file, their access lists given back."""
    docs, access, tags = _tables(spark, d)
    given = ops.with_access(docs.select("id", "provider_id", "document_id", "owner", "content", "link", "source", "modified", "hash"), access)
    metas = tags.filter("kind = 'meta'").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("value").alias("tags"))
    return given.join(metas, "id", "left").select("*", F.concat("document_id", F.lit(".txt")).alias("title"), F.lit(False).alias("content_encoded")).withColumnRenamed("id", "change_id")


def _engine(spark, d) -> tuple[SearchEngine, DataFrame]:
    """An engine that holds index_documents, and the outcomes of writing it; made once for an application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _engines:
        engine = SearchEngine(spark, _folder(spark, "engine"))
        engine.ensure()
        _engines[key] = engine, engine.index(_input(spark, d))
    return _engines[key]


_LAST = """last AS (SELECT d.*, EXISTS (SELECT 1 FROM index_access a WHERE a.doc_id = d.id AND regexp_matches(a.token, '^[ugc]:.')) OR coalesce(owner, '') <> '' AS open,
      coalesce(regexp_matches(content, '[^\\P{C}\\t\\n\\r]'), false) AS odd FROM index_documents d QUALIFY row_number() OVER (PARTITION BY provider_id, document_id ORDER BY id DESC) = 1)"""


@query(f"WITH {_LAST} SELECT provider_id, document_id, CASE WHEN open THEN 'done' ELSE 'failed' END AS status, NOT odd AS extracted, CASE WHEN odd THEN 'unsupported' END AS cause, CASE WHEN NOT open THEN 3 WHEN odd THEN 1 ELSE 0 END AS severity FROM last")
def engine_outcomes(spark, d):
    """What became of each document on the way into the engine; one that fails does not fail the others."""
    return _engine(spark, d)[1].select("provider_id", "document_id", "status", "extracted", "cause", "severity")


@query(f"WITH {_LAST} SELECT provider_id, document_id, document_id || '.txt' AS title, CASE WHEN odd THEN '' ELSE coalesce(content, '') END AS content, nullif(owner, '') AS owner, nullif(hash, '') AS hash, CASE WHEN odd THEN 'unsupported' END AS extraction_cause FROM last WHERE open")
def engine_documents(spark, d):
    """The rows the engine stored."""
    return _engine(spark, d)[0].store.read("documents").select("provider_id", "document_id", "title", "content", "owner", "hash", "extraction_cause")


@query(f"WITH {_LAST} SELECT provider_id, document_id, (len({X.sql_tokens('content')}) * (NOT odd)::INT + len({X.sql_tokens('document_id')}) + 1)::INT AS len FROM last WHERE open")
def engine_index(spark, d):
    """The lengths in the engine's index, written with the rows."""
    store = _engine(spark, d)[0].store
    return store.read("documents").join(store.read("doc_stats"), F.col("id") == F.col("doc_id")).select("provider_id", "document_id", "len")


@query(f"WITH {_LAST} SELECT count(*) AS total FROM last WHERE open AND NOT odd AND list_contains({X.sql_tokens('content')}, 'biblioteca') AND (owner = 'isbei' OR EXISTS (SELECT 1 FROM index_access a WHERE a.doc_id = last.id AND a.token IN ('u:isbei', 'g:ampa')))")
def engine_search(spark, d):
    """A search of the engine as a viewer, with options that are skipped; its exact total."""
    return _engine(spark, d)[0].search(Request('"biblioteca"', widening={"parts": ["x"]}), viewer="isbei", groups=["ampa"])[1]


@query(f"WITH {_LAST}, f AS (SELECT * FROM last WHERE open AND provider_id = (SELECT min(provider_id) FROM last) ORDER BY document_id LIMIT 1) SELECT provider_id, document_id, nullif(owner, '') AS owner, (SELECT count(DISTINCT token) FROM index_access a WHERE a.doc_id = f.id AND a.token[1:2] = 'g:') AS groups FROM f")
def engine_lookup(spark, d):
    """One document as it was put in."""
    engine = _engine(spark, d)[0]
    provider, document = engine.store.read("documents").agg(F.min(F.struct("provider_id", "document_id")).alias("m")).select("m.*").first()
    return engine.get_document(provider, document).select("provider_id", "document_id", "owner", F.size("groups").cast("long").alias("groups"))


@query(f"WITH {_LAST}, g AS (SELECT DISTINCT provider_id, document_id FROM index_changes WHERE op = 'delete') SELECT provider_id, document_id FROM last WHERE open AND (provider_id, document_id) NOT IN (SELECT (provider_id, document_id) FROM g)")
def engine_after_deletes(spark, d):
    """What is left when the feed's deletes were applied to an engine of its own, and the index was made again."""
    engine = SearchEngine(spark, _folder(spark, "engine"))
    engine.ensure()
    engine.index(_input(spark, d))
    engine.delete_list(table(spark, d, "index_changes").filter("op = 'delete'").select("provider_id", "document_id"))
    engine.rebuild()
    return engine.store.read("documents").join(engine.store.read("doc_stats"), F.col("id") == F.col("doc_id"), "left_semi").select("provider_id", "document_id")


ROUNDS = 25


@query(f"SELECT i::INT AS round, (i - i // 7)::INT AS live, true AS exact FROM range(1, {ROUNDS + 1}) t(i)")
def engine_interleaved(spark, d):
    """Writes and searches in turn: each round adds one, every 5th replaces and every 7th deletes the oldest; the next search sees it."""
    engine = SearchEngine(spark, _folder(spark, "interleaved"), seconds=None)
    engine.ensure()
    columns = "op string, provider_id string, document_id string, title string, content string, content_encoded boolean, owner string, users array<string>, groups array<string>, circles array<string>, tags array<string>, link string, source string, hash string, modified long"
    row = lambda key, words, op="index": (op, "notes", key, f"{key}.txt", words, False, "nora", [], [], [], [], None, "files", None, 1)
    live: dict[str, str] = {}
    out = []
    for n in range(1, ROUNDS + 1):
        rows = [row(f"n{n:02d}", f"nova{n} fulla")]
        live[f"n{n:02d}"] = f"nova{n}"
        oldest = min(live)
        if n % 7 == 0:
            del live[oldest]
            rows.append(row(oldest, None, "delete"))
        elif n % 5 == 0:
            live[oldest] = f"canvi{n}"
            rows.append(row(oldest, f"canvi{n} fulla"))
        engine.index(spark.createDataFrame(rows, columns))
        page, total = engine.search(Request("fulla", size=100), viewer="nora")
        seen = {r["document_id"] for r in page.collect()}
        exact = seen == set(live)
        if n % 5 == 0 or n % 7 == 0 or n == ROUNDS:  # what was replaced or deleted is gone from the rows too
            stored = {r["document_id"]: r["content"].split()[0] for r in engine.store.read("documents").select("document_id", "content").collect()}
            exact = exact and stored == live and total.first()["total"] == len(live)
        out.append((n, len(seen), exact))
    return spark.createDataFrame(out, "round int, live int, exact boolean")


_HEALTH = [("nothing there", "missing"), ("created", "ready"), ("no such profile", "engine"), ("segment lost", "unusable")]


@query(_values(_HEALTH, "situation, state"))
def health_states(spark, d):
    """The health card in each situation."""
    folder = _folder(spark, "health")
    engine = SearchEngine(spark, folder)
    states = [engine.health()["state"]]
    engine.ensure()
    states.append(engine.health()["state"])
    states.append(SearchEngine(spark, folder, Config(profile="none", lenient=True)).health()["state"])
    Store(spark, folder)._point({"number": 2, "next_id": 1, "segments": ["s-lost"], "dead": [], "live": 1, "gone": 0})
    states.append(engine.health()["state"])
    return spark.createDataFrame([(s, v) for (s, _), v in zip(_HEALTH, states)], "situation string, state string")


_EXISTS = [("index of index_documents", True, ""), ("nowhere", False, ""), ("created twice", True, "")]


@query(_values(_EXISTS, "place, there, warnings"))
def index_exists(spark, d):
    """Whether an index is there; making one twice changes nothing and warns of nothing."""
    stored_index(spark, d)
    store = Store(spark, _folder(spark, "made"))
    warnings = store.ensure() + store.ensure()
    rows = [index.ensure(spark, _stored[(spark.sparkContext.applicationId, d)]), index.ensure(spark, _folder(spark, "nowhere")), store.exists()]
    return spark.createDataFrame([(n, there, " ".join(warnings) if n == "created twice" else "") for (n, _, _), there in zip(_EXISTS, rows)], "place string, there boolean, warnings string")


_MOST = 2000


def _halved(step: int) -> str:
    size = f"list_sum(list_transform(list_distinct({X.sql_tokens('text')}), lambda x: octet_length(encode(x)) + 8))"
    cut = f"coalesce({', '.join(f'TRY(decode(encode(text)[1:octet_length(encode(text)) // 2 - {k}]))' for k in range(4))})"
    return f"s{step} AS (SELECT doc_id, CASE WHEN {size} > {_MOST} THEN {cut} ELSE text END AS text, whole FROM s{step - 1})"


@query(f"WITH s0 AS (SELECT doc_id, text, octet_length(encode(text)) AS whole FROM documents), {', '.join(map(_halved, range(1, 5)))} SELECT doc_id, text, coalesce(octet_length(encode(text)) < whole, false) AS ceiling FROM s4")
def engine_ceiling(spark, d):
    """Texts with more bytes of distinct words than an index vector holds, halved four times at most."""
    return ops.engine_ceiling(table(spark, d, "documents").select("doc_id", "text"), "text", _MOST)


# sources and streams


@query("SELECT doc_id::VARCHAR AS id, title, text AS body FROM documents")
def jsonl_corpus(spark, d):
    """The documents written as compressed JSON lines and read as a corpus."""
    folder = _folder(spark, "jsonl")
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "title", F.col("text").alias("body")).write.json(folder, compression="gzip")
    return sources.read_corpus(spark, folder)


@query("SELECT n_nationkey, n_name || chr(10) AS text, NULL::VARCHAR AS cause FROM nation")
def stream_files(spark, d):
    """A stream of files, one a nation, each extracted as it arrives."""
    from textrill.extract.dispatch import extract_files

    folder = _folder(spark, "files")
    table(spark, d, "nation").select("n_nationkey", "n_name").repartition(1).write.partitionBy("n_nationkey").text(f"{folder}/in")
    files = sources.stream_files(spark, f"{folder}/in/n_nationkey=*")

    def batch_of(rows, epoch):
        extract_files(rows.select("path", "content"), "path", "content", 1000).select("path", "text", "cause").write.mode("overwrite").parquet(f"{folder}/out/{epoch}")

    files.writeStream.foreachBatch(batch_of).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("path string, text string, cause string").parquet(f"{folder}/out/*")
    return out.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast(table(spark, d, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), "text", "cause")


@query("SELECT change_id FROM index_changes WHERE provider_id = 'files' AND title IS NULL")
def event_filter(spark, d):
    """Events of one subject that are not filled in yet."""
    from textrill.streaming.changes import only

    return only(table(spark, d, "index_changes").select("change_id", "provider_id", F.col("title").alias("content"))).select("change_id")


@query("SELECT id, extraction_cause IS NULL AS extracted, content AS text, extraction_cause AS cause, (extraction_cause IS NOT NULL)::INT AS severity FROM index_documents")
def pre_extracted(spark, d):
    """Documents that come with their text are taken as they are."""
    rows = _docs(spark, d).select("id", "title", "content", F.lit(False).alias("content_encoded"), F.col("extraction_cause").isNull().alias("extracted"), F.col("extraction_cause").alias("cause"), F.lit(None).cast("string").alias("message"))
    return sources.with_content(rows, 1 << 21).select("id", "extracted", "text", "cause", "severity")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN 3 ELSE 0 END AS severity FROM documents")
def broken_transport(spark, d):
    """Texts sent as base64, every third of them damaged on the way: severity 3, no text and no cause."""
    sent = table(spark, d, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b"))
    raw, broken = sources.transport(F.when(F.col("doc_id") % 3 == 0, F.concat("b", F.lit("!"))).otherwise(F.col("b")), F.lit(True))
    return sent.select("doc_id", F.decode(raw, "UTF-8").alias("text"), F.when(broken, 3).otherwise(0).alias("severity"))


@query("SELECT id, regexp_replace(content_norm, '�', '?', 'g') AS scrubbed, true AS damaged FROM (SELECT id, substr(content_norm, 1, 40) || '??' || substr(content_norm, 41) AS content_norm FROM index_documents WHERE content_norm IS NOT NULL)")
def utf8_scrubbed(spark, d):
    """Texts with two invalid bytes put in: each becomes one replacement character."""
    rows = _docs(spark, d).filter(F.col(CONTENT).isNotNull())
    raw = F.concat(F.encode(F.substring(CONTENT, 1, 40), "UTF-8"), F.unhex(F.lit("C3FF")), F.encode(F.substr(F.col(CONTENT), F.lit(41)), "UTF-8")).cast("string")
    return rows.select("id", F.replace(X.scrub(raw), F.lit("�"), F.lit("?")).alias("scrubbed"), (~F.is_valid_utf8(raw)).alias("damaged"))


# formats


def _lines(t: str) -> list[list[str]]:
    return [[line[i : i + 30_000] for i in range(0, len(line), 30_000)] for line in t.split("\n")]


@query(_LINES.format(r"array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: l <> ''), chr(10)) || CASE WHEN regexp_replace(coalesce(text, ''), '\n', '', 'g') = '' THEN '' ELSE chr(10) END"))
def extract_xls(spark, d):
    return _round_trip(spark, d, lambda t: samples.xls(_lines(t)), "xls")


@query(_LINES.format(_BLANK_LINES))
def extract_xlsx_inline(spark, d):
    return _round_trip(spark, d, samples.xlsx_inline, "xlsx")


@query(_LINES.format(_BLANK_LINES))
def extract_ods(spark, d):
    return _round_trip(spark, d, samples.odt, "ods")


@query(_LINES.format(_BLANK_LINES))
def extract_odp(spark, d):
    return _round_trip(spark, d, samples.odt, "odp")


@query(_sql["extract_pdf"])
def extract_pdf_encrypted(spark, d):
    """PDF under the standard security handler with an empty user password."""
    return _round_trip(spark, d, samples.pdf_encrypted, "pdf")


@query(_sql["extract_pdf"])
def extract_pdf_xref_stream(spark, d):
    """PDF with a cross-reference stream and objects inside an object stream."""
    return _round_trip(spark, d, samples.pdf_compressed, "pdf")


_HOSTILE = [
    ("docx, no zip", "docx", "parser gave up"), ("docx, encrypted package", "docx", "encrypted"), ("docx, part missing", "docx", "parser gave up"), ("docx, zip bomb", "docx", "parser gave up"), ("docx, nested too deep", "docx", "parser gave up"), ("docx, unclosed", "docx", "parser gave up"),
    ("odt, encrypted", "odt", "encrypted"), ("xls, password", "xls", "encrypted"), ("ppt, password", "ppt", "encrypted"), ("doc, encrypted", "doc", "encrypted"), ("xls, junk", "xls", "parser gave up"), ("doc, cut short", "doc", "parser gave up"),
    ("pdf, junk", "pdf", "parser gave up"), ("pdf, no pages", "pdf", "parser gave up"), ("pdf, real password", "pdf", "encrypted"), ("epub", "epub", "unsupported"), ("txt, not UTF-8", "txt", "unsupported"), ("txt, over budget", "txt", "budget cut"), ("txt, clean", "txt", None),
]


@query(_values([(n, c) for n, _, c in _HOSTILE], "file, cause"))
def extract_hostile(spark, d):
    """Files that are broken, locked or hostile: each gives a cause and none fails the batch."""
    from textrill.extract.dispatch import extract_files

    data = {
        "docx, no zip": b"not a zip", "docx, encrypted package": samples.ole({"EncryptedPackage": b"x"}), "docx, part missing": samples.zipped({"a": "b"}), "docx, zip bomb": samples.zipped({"word/document.xml": b"<w>" + b"0" * (30 << 20) + b"</w>"}),
        "docx, nested too deep": samples.zipped({"word/document.xml": "<a>" * 70 + "</a>" * 70}), "docx, unclosed": samples.zipped({"word/document.xml": "<d><p>kept</p><p>lost"}), "odt, encrypted": samples.odt("x", encrypted=True), "xls, password": samples.xls([["a"]], password=True),
        "ppt, password": samples.ppt([["x"]], password=True), "doc, encrypted": samples.doc("x", encrypted=True), "xls, junk": b"junk" * 400, "doc, cut short": samples.doc("abc " * 900)[:1100], "pdf, junk": b"nothing", "pdf, no pages": samples.pdf_objects([b"<</Type/Nothing>>"]),
        "pdf, real password": samples.pdf_encrypted("secret", password=b"real"), "epub": b"PK", "txt, not UTF-8": b"sortida\xc3\x28", "txt, over budget": b"word " * 400, "txt, clean": b"clean",
    }
    files = spark.createDataFrame([(n, f"{i}.{e}", bytearray(data[n])) for i, (n, e, _) in enumerate(_HOSTILE)], "file string, name string, content binary")
    return extract_files(files, "name", "content", 1000, None).select("file", "cause")


_PDF = [("whole", 3, 0, 0), ("one font without a map", 2, 0, 1), ("one page broken", 3, 1, 0)]


@query(_values(_PDF, "file, pages, unreadable, undecodable"))
def pdf_counters(spark, d):
    """Pages, unreadable pages and undecodable runs of PDF files, as columns."""
    from textrill.extract.pdf import counters

    def page(kind: str, n: int) -> bytes:
        return samples.pdf_pages(n, broken=1 if kind == "one page broken" else 0, unmapped=1 if kind == "one font without a map" else 0)

    files = spark.createDataFrame([(k, bytearray(page(k, n))) for k, n, _, _ in _PDF], "file string, content binary")

    def run(batches):
        for b in batches:
            out = [counters(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[i] for o in out], pa.int32()) for i in range(3)]], ["file", "pages", "unreadable", "undecodable"])

    return files.mapInArrow(run, "file string, pages int, unreadable int, undecodable int")
