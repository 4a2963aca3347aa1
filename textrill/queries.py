"""The engine's queries over the test tables, and the same queries as DuckDB SQL.

Every query runs over whole tables. The searched columns are ``title_norm`` and
``content_norm``, the text as it was indexed; excerpts come from the stored text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill import schemas
from textrill.functions import text as X
from textrill.operators import access as A
from textrill.operators import index, match, ops, search
from textrill.operators.match import IDF_FLOOR
from textrill.plans.query import MUST, MUST_NOT, SHOULD, Compiled, Request, compile_query
from textrill.runtime import forget_at_exit, materialize, shared_dir, table

TITLE, CONTENT = "title_norm", "content_norm"
VIEWER = A.viewer_tokens(viewer="isbei", groups=["ampa", "claustre", "musica"], circles=["circ-015"])
INTRUDER = A.viewer_tokens(viewer="nobody-at-all")
FLAGSHIP = '+museu "consell escolar" -pis tau'
COMBINED = '+guia "consell escolar" -vermella biblio'
BUDGET = 500
SINCE, UNTIL = "1664451200", "1749900800"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL if SQL can express it."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = " ".join(sql.split())
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "index_documents")


def _tables(spark, d):
    return _docs(spark, d), table(spark, d, "index_access"), table(spark, d, "index_tags")


# SQL of a compiled query


def _sql_unit(u, lists: list[str]) -> str:
    if not u.words:
        return "0"
    k = len(u.words)

    def q(s: str) -> str:
        return s.replace("'", "''")

    parts = []
    for t in lists:
        same = [f"{t}[i + {j + 1}] = '{q(w)}'" for j, w in enumerate(u.words[:-1])]
        last = f"starts_with({t}[i + {k}], '{q(u.words[-1])}')" if u.prefix else f"{t}[i + {k}] = '{q(u.words[-1])}'"
        parts.append(f"len(list_filter(range(0, greatest(0, len({t}) - {k - 1})), lambda i: {' AND '.join([*same, last])}))")
    return f"({' + '.join(parts)})"


def _sql_accepts(c: Compiled) -> str:
    ids = {o: [i for i, u in enumerate(c.units) if u.occur == o] for o in (SHOULD, MUST, MUST_NOT)}
    parts = []
    any_of = f"({' OR '.join(f'tf_{i} > 0' for i in ids[SHOULD])})" if ids[SHOULD] else ""
    if c.profile == "boolean":
        if not ids[SHOULD] and not ids[MUST]:
            return "false"
        if any_of and not ids[MUST]:
            parts.append(any_of)
    else:
        if any_of:
            parts.append(any_of)
        if not ids[SHOULD] and not ids[MUST] and (c.profile == "fts5" or not ids[MUST_NOT]):
            return "false"
    parts += [f"tf_{i} > 0" for i in ids[MUST]] + [f"tf_{i} = 0" for i in ids[MUST_NOT] if c.units[i].words]
    return " AND ".join(parts) or "true"


def sql_scored(c: Compiled) -> str:
    """A WITH clause whose last table, scored(id, score), holds the matching rows of index_documents."""
    c = match._unit_filter(c)
    if c.browse:
        return "WITH scored AS (SELECT id, 0.0::DOUBLE AS score FROM index_documents)"
    lists = ["list_concat(tt, ct)"] if c.profile == "tsquery" else ["tt", "ct"]
    tf = "".join(f", {_sql_unit(u, lists)} AS tf_{i}" for i, u in enumerate(c.units))
    n = "".join(f", sum((tf_{i} > 0)::INT) AS n_{i}" for i in range(len(c.units)))
    gains = []
    for i, u in enumerate(c.units):
        if u.occur == MUST_NOT or not u.words:
            continue
        if c.profile == "boolean":
            gains.append(f"tf_{i} * CASE WHEN n_{i} > 0 THEN power(log10(n_docs / n_{i}), 2) ELSE 0 END")
        else:
            raw = f"ln((n_docs - n_{i} + 0.5) / (n_{i} + 0.5))"
            gains.append(f"(CASE WHEN {raw} > 0 THEN {raw} ELSE {IDF_FLOOR} END) * (tf_{i} * 2.2::DOUBLE) / (tf_{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))")
    return f"""WITH cut AS (SELECT id, {X.sql_tokens(TITLE)} AS tt, {X.sql_tokens(CONTENT)} AS ct FROM index_documents),
        counted AS (SELECT id, len(tt) + len(ct) AS len{tf} FROM cut),
        figures AS (SELECT count(*)::DOUBLE AS n_docs, avg(len) AS avg_len{n} FROM counted),
        scored AS (SELECT id, {' + '.join(gains) or '0.0::DOUBLE'} AS score FROM counted, figures WHERE {_sql_accepts(c)})"""


def _sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_search(search_: str, tokens=None, where: str = "true", profile: str = "fts5", tags=()) -> str:
    """(id, score) of a search over index_documents as SQL."""
    can = f"AND id IN (SELECT doc_id FROM index_access WHERE token IN {_sql_list(tokens)})" if tokens is not None else ""
    tagged = f"AND id IN (SELECT doc_id FROM index_tags WHERE kind = 'meta' AND value IN {_sql_list(tags)})" if tags else ""
    return f"{sql_scored(compile_query(search_, profile))} SELECT id, round(score, 6) AS score FROM scored WHERE id IN (SELECT id FROM index_documents WHERE {where} {can} {tagged})"


# text functions


@query(f"SELECT id, array_to_string({X.sql_tokens(CONTENT)}, ' ') AS words, len({X.sql_tokens(TITLE)})::BIGINT AS title_words FROM index_documents")
def fold_tokens(spark, d):
    """The folded words of every row."""
    return _docs(spark, d).select("id", F.array_join(X.tokens(CONTENT), " ").alias("words"), F.size(X.tokens(TITLE)).cast("long").alias("title_words"))


@query(f"SELECT id, {X.sql_fold('title')} AS tsquery, lower({X.sql_fold('title')}) AS boolean, title AS fts5 FROM index_documents")
def normalise_profiles(spark, d):
    """Titles in the indexed form of each profile."""
    return _docs(spark, d).select("id", X.normalise("title", "tsquery").alias("tsquery"), X.normalise("title", "boolean").alias("boolean"), F.col("title").alias("fts5"))


@query(
    f"""WITH b AS (SELECT doc_id, text, encode(text) AS raw FROM documents),
    c AS (SELECT doc_id, text, raw, coalesce({', '.join(f"TRY(decode(raw[1:{BUDGET - k}]))" for k in range(4))}) AS cut FROM b)
    SELECT doc_id, octet_length(raw) > {BUDGET} AS was_cut, CASE WHEN octet_length(raw) <= {BUDGET} THEN text
      ELSE regexp_replace(CASE WHEN strpos(cut, ' ') > 0 AND length(cut) - strpos(reverse(cut), ' ') > 0 THEN substr(cut, 1, length(cut) - strpos(reverse(cut), ' ')) ELSE cut END, '[ \\t\\n\\r\\x00\\x0B]+$', '') END AS kept FROM c"""
)
def budget_cut(spark, d):
    """Every text within a byte budget, cut at a word."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.overflows(F.col("text"), BUDGET).alias("was_cut"), X.budget_cut(F.col("text"), BUDGET).alias("kept"))


@query(
    r"""SELECT id, CASE WHEN content_norm IS NULL THEN NULL WHEN regexp_matches(content_norm, '[^\P{C}\t\n\r]') THEN 'unsupported' WHEN octet_length(encode(content_norm)) > 2000 THEN 'budget cut' END AS cause FROM index_documents"""
)
def plain_text_gate(spark, d):
    """What the plain-text reader says of every text: refused for control characters, cut, or complete (null)."""
    c = F.col(CONTENT)
    return _docs(spark, d).select("id", F.when(~X.is_plain(c), "unsupported").when(X.overflows(c, 2000), "budget cut").alias("cause"))


@query(r"SELECT id, lower(regexp_extract(string_split(coalesce(title, ''), '/')[-1], '\.([^.]*)$', 1)) AS ext FROM index_documents")
def path_extension(spark, d):
    """File extension of every title."""
    return _docs(spark, d).select("id", X.path_extension(F.col("title")).alias("ext"))


@query("SELECT doc_id, text AS decoded, true AS same, NULL::VARCHAR AS broken FROM documents")
def base64_transport(spark, d):
    """Texts sent as base64 and strictly decoded again; broken transport gives null."""
    sent = table(spark, d, "documents").select("doc_id", "text", F.base64(F.encode("text", "UTF-8")).alias("b"))
    got = sent.withColumn("decoded", F.decode(X.decode_base64(F.col("b")), "UTF-8"))
    broken = F.decode(X.decode_base64(F.concat("b", F.lit("!!"))), "UTF-8")
    return got.select("doc_id", "decoded", (F.col("decoded") == F.col("text")).alias("same"), broken.alias("broken"))


@query("SELECT id, nullif(owner, '') AS owner, nullif(hash, '') AS hash, octet_length(encode(title)) AS title_bytes FROM index_documents")
def empty_to_null(spark, d):
    return _docs(spark, d).select("id", X.null_if_empty(F.col("owner")).alias("owner"), X.null_if_empty(F.col("hash")).alias("hash"), F.octet_length("title").cast("long").alias("title_bytes"))


# index


_CUT_SQL = f"""SELECT id AS doc_id, 0 AS field, unnest({X.sql_tokens(TITLE)}) AS term, generate_subscripts({X.sql_tokens(TITLE)}, 1) - 1 AS pos FROM index_documents
    UNION ALL SELECT id, 1, unnest({X.sql_tokens(CONTENT)}), generate_subscripts({X.sql_tokens(CONTENT)}, 1) - 1 FROM index_documents"""


@query(f"SELECT term, doc_id, field, count(*)::INT AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS places FROM ({_CUT_SQL}) GROUP BY ALL")
def postings(spark, d):
    """The inverted index of all rows; positions as text for comparison."""
    return index.postings(_docs(spark, d), TITLE, CONTENT).select("term", "doc_id", "field", "tf", F.concat_ws(" ", F.col("positions").cast("array<string>")).alias("places"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ({_CUT_SQL}) GROUP BY term")
def term_df(spark, d):
    return index.term_stats(index.postings(_docs(spark, d), TITLE, CONTENT))


@query(f"SELECT id AS doc_id, (len({X.sql_tokens(TITLE)}) + len({X.sql_tokens(CONTENT)}))::INT AS len FROM index_documents")
def doc_stats(spark, d):
    return index.doc_stats(_docs(spark, d), TITLE, CONTENT)


@query(f"SELECT count(*) AS n_docs, round(avg(len({X.sql_tokens(TITLE)}) + len({X.sql_tokens(CONTENT)})), 6) AS avg_len FROM index_documents")
def corpus_stats(spark, d):
    return index.corpus_stats(index.doc_stats(_docs(spark, d), TITLE, CONTENT)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


# matching, one query for each rule, from the stored index

_stored: dict[tuple[str, str], str] = {}


def stored_index(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, corpus figures) of the index of index_documents, built and stored once for an application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        folder = f"{shared_dir(spark)}/index-{key[0]}-{uuid.uuid4().hex[:12]}"
        index.write(_docs(spark, d), folder, TITLE, CONTENT)
        forget_at_exit(spark, folder)
        _stored[key] = folder
    read = spark.read.schema
    return read(schemas.POSTINGS).parquet(f"{_stored[key]}/postings"), read(schemas.DOC_STATS).parquet(f"{_stored[key]}/doc_stats"), spark.read.parquet(f"{_stored[key]}/corpus")


def _hits(spark, d, search_, profile="fts5"):
    return match.index_hits(*_index_for(spark, d, compile_query(search_, profile))).select("id", F.round("score", 6).alias("score"))


def _index_for(spark, d, compiled):
    post, stats, corpus = stored_index(spark, d)
    return post, stats, compiled, corpus


def _add_match(name: str, search_: str, profile: str = "fts5") -> None:
    def run(spark, d):
        return _hits(spark, d, search_, profile)

    run.__name__ = name
    run.__doc__ = f"Rows and ranks of the search {search_} under {profile}."
    query(sql_search(search_, profile=profile))(run)


for _name, _search, _profile in (
    ("match_term", '"biblioteca"', "fts5"),
    ("match_prefix", "biblio", "fts5"),
    ("match_phrase", '"consell escolar"', "fts5"),
    ("match_phrase_prefix", "l'est", "fts5"),
    ("match_should", "biblioteca library bücherei", "fts5"),
    ("match_must", "+guia +biblioteca", "fts5"),
    ("match_mustnot", '"biblioteca" -vermella', "fts5"),
    ("match_combined", COMBINED, "fts5"),
    ("match_must_should_fts5", "+museu escola", "fts5"),
    ("match_must_should_boolean", "+museu escola", "boolean"),
    ("exclusion_only_fts5", "-biblioteca -museu", "fts5"),
    ("exclusion_only_tsquery", "-biblioteca -museu", "tsquery"),
    ("exclusion_only_boolean", "-biblioteca -museu", "boolean"),
    ("operator_only_fts5", "+*** +museu", "fts5"),
    ("operator_only_tsquery", "+*** +museu", "tsquery"),
    ("match_tsquery", COMBINED, "tsquery"),
    ("match_tsquery_across_fields", '"docx el"', "tsquery"),
    ("match_boolean", COMBINED, "boolean"),
    ("match_boolean_stopwords", "the library of", "boolean"),
    ("match_file_code", "[0002625]", "fts5"),
    ("match_folded", "ciències Prüfungen", "fts5"),
):
    _add_match(_name, _search, _profile)


@query(sql_search(COMBINED))
def match_from_texts(spark, d):
    """The combined search again, read from the texts, as where there is no index."""
    return match.scan_hits(_docs(spark, d), compile_query(COMBINED), TITLE, CONTENT).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH w AS (SELECT id, {X.sql_tokens(TITLE)} AS tt, {X.sql_tokens(CONTENT)} AS ct FROM index_documents),
    p AS (SELECT id, len(tt) AS n, unnest(list_concat(tt, ct)) AS term, generate_subscripts(list_concat(tt, ct), 1) - 1 AS pos FROM w),
    h AS (SELECT id, pos, term, CASE WHEN pos < n THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM p WHERE term IN ('guia', 'biblioteca')),
    l AS (SELECT *, lag(term) OVER o AS before, lag(pos) OVER o AS p0, lag(weight) OVER o AS w0 FROM h WINDOW o AS (PARTITION BY id ORDER BY pos))
    SELECT id, round(sum(2 / (1 / w0 + 1 / weight) / (pos - p0)), 6) AS score FROM l WHERE before <> term GROUP BY id"""
)
def rank_cover_density(spark, d):
    """Cover-density rank of two required words: the covers are neighbours of different words."""
    from textrill.operators.cover import cover_hits

    post, stats, _ = stored_index(spark, d)
    return cover_hits(post, stats, compile_query("+guia +biblioteca", "tsquery")).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH w AS (SELECT id, {X.sql_tokens(TITLE)} AS tt, {X.sql_tokens(CONTENT)} AS ct FROM index_documents)
    SELECT id, round(len(list_filter(tt, lambda x: x = 'museu')) * 1.0::DOUBLE + len(list_filter(ct, lambda x: x = 'museu')) * 0.4::DOUBLE, 6) AS score FROM w WHERE list_contains(tt, 'museu') OR list_contains(ct, 'museu')"""
)
def rank_title_weight(spark, d):
    """Weights of the fields: a word in the title counts 1.0, in the content 0.4."""
    from textrill.operators.cover import cover_hits

    post, stats, _ = stored_index(spark, d)
    return cover_hits(post, stats, compile_query("+museu", "tsquery")).select("id", F.round("score", 6).alias("score"))


@query("SELECT id, content_norm AS scrubbed, content_norm IS NOT NULL AS valid FROM index_documents WHERE content_norm IS NOT NULL")
def utf8_repair(spark, d):
    """Texts made valid UTF-8, as they all are here."""
    rows = _docs(spark, d).filter(F.col(CONTENT).isNotNull())
    return rows.select("id", X.scrub(F.col(CONTENT)).alias("scrubbed"), F.is_valid_utf8(CONTENT).alias("valid"))


# filters, joins, paging


def _base(spark, d, request: Request, tokens=VIEWER):
    docs, access, tags = _tables(spark, d)
    compiled = compile_query(request.search)
    hits = None if compiled.browse else match.index_hits(*_index_for(spark, d, compiled))
    return search.base(docs, access, tags, request, tokens, compiled, hits, title=TITLE, content=CONTENT)


@query(f"{sql_search(FLAGSHIP, VIEWER)} ORDER BY 2 DESC, 1 LIMIT 20")
def search_bm25_top20(spark, d):
    """The flagship: match, access, BM25, best 20, ties by id."""
    request = Request(FLAGSHIP)
    return search.page(_base(spark, d, request), request)


@query(f"SELECT id FROM index_documents WHERE id IN (SELECT doc_id FROM index_access WHERE token IN {_sql_list(VIEWER)})")
def access_filter(spark, d):
    docs, access, _ = _tables(spark, d)
    return A.visible(docs, access, VIEWER).select("id")


@query(f"SELECT id FROM index_documents WHERE id IN (SELECT doc_id FROM index_access WHERE token IN {_sql_list(INTRUDER)})")
def access_intruder(spark, d):
    docs, access, _ = _tables(spark, d)
    return A.visible(docs, access, INTRUDER).select("id")


@query("SELECT id FROM index_documents WHERE id IN (SELECT doc_id FROM index_tags WHERE kind = 'meta' AND value IN ('files_remote', 'lang:ca'))")
def tag_filter(spark, d):
    docs, _, tags = _tables(spark, d)
    wanted = tags.filter((F.col("kind") == "meta") & F.col("value").isin("files_remote", "lang:ca")).select(F.col("doc_id").alias("id"))
    return docs.join(wanted, "id", "left_semi").select("id")


@query("SELECT id FROM index_documents WHERE provider_id = 'files'")
def provider_filter(spark, d):
    return _docs(spark, d).filter(F.col("provider_id") == "files").select("id")


@query(sql_search("biblioteca", VIEWER, f"modified >= {SINCE} AND modified <= {UNTIL}"))
def date_range(spark, d):
    return _base(spark, d, Request("biblioteca", since=SINCE, until=UNTIL))


@query(sql_search("biblioteca", VIEWER))
def date_not_numeric(spark, d):
    """Limits that are no numbers do not limit."""
    return _base(spark, d, Request("biblioteca", since="yesterday", until="0x10"))


@query(sql_search("biblioteca", VIEWER, tags=("files_home", "lang:es")))
def search_tags(spark, d):
    return _base(spark, d, Request("biblioteca", meta_tags=("files_home", "lang:es", 7)))


@query(sql_search("", VIEWER) + " ORDER BY 1 LIMIT 50")
def browse_empty(spark, d):
    """An empty search lists what the viewer may see, by id, with score 0."""
    request = Request("  ", size=50)
    return search.page(_base(spark, d, request), request)


@query(sql_search("biblioteca museu", VIEWER) + " ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 20")
def page_offset(spark, d):
    request = Request("biblioteca museu", page=3, size=10)
    return search.page(_base(spark, d, request), request)


@query(sql_search("biblioteca", VIEWER) + " ORDER BY 2 DESC, 1 LIMIT 1")
def page_size_zero(spark, d):
    """A size under 1 counts as 1."""
    request = Request("biblioteca", size=0)
    return search.page(_base(spark, d, request), request)


@query(f"SELECT count(*) AS total FROM ({sql_search('biblioteca', VIEWER)}) WHERE false")
def page_past_ceiling(spark, d):
    """Beyond the deepest page the total is 0 too."""
    return search.total(_base(spark, d, Request("biblioteca", page=5002, size=20)))


@query(f"SELECT count(*) AS total FROM ({sql_search('biblioteca museu', VIEWER)})")
def search_count(spark, d):
    return search.total(_base(spark, d, Request("biblioteca museu")))


@query(
    f"""SELECT p.id, p.score, d.document_id, d.title, d.link, {X.sql_excerpt('d.content', 'biblioteca')} AS excerpt
    FROM ({sql_search('biblioteca', VIEWER)} ORDER BY 2 DESC, 1 LIMIT 20) p JOIN index_documents d ON d.id = p.id"""
)
def search_page_shaped(spark, d):
    """A whole result page with titles and excerpts."""
    request = Request("biblioteca")
    docs = _docs(spark, d)
    return search.shaped(search.page(_base(spark, d, request), request), docs, request)


@query(f"SELECT id, {X.sql_excerpt('content', 'museu')} AS excerpt FROM index_documents")
def excerpt_centered(spark, d):
    return search.excerpts(_docs(spark, d), "museu")


@query(f"SELECT id, {X.sql_excerpt('content', '+ciencies')} AS excerpt FROM index_documents")
def excerpt_folded(spark, d):
    return search.excerpts(_docs(spark, d), "+ciencies")


# writes and upkeep


@query("SELECT extraction_cause, count(*) AS n FROM index_documents WHERE extraction_cause IS NOT NULL GROUP BY 1")
def cause_counts(spark, d):
    return ops.causes(_docs(spark, d))


@query("SELECT id FROM index_documents WHERE title_norm IS NULL AND content_norm IS NULL")
def stale_docs(spark, d):
    return index.stale(_docs(spark, d)).select("id")


@query("SELECT provider_id, document_id, count(*) AS rows, max(id) AS newest FROM index_documents GROUP BY 1, 2 HAVING count(*) > 1")
def stored_twice(spark, d):
    return ops.versions(_docs(spark, d))


@query("SELECT provider_id, document_id, arg_max(title, (modified, id)) AS title, arg_max(id, (modified, id)) AS id FROM index_documents GROUP BY 1, 2")
def replace_keeps_newest(spark, d):
    """One row a document: replacing leaves the newest."""
    docs = _docs(spark, d).select("provider_id", "document_id", "title", "modified", "id")
    return ops.without_stale_versions(docs, ["modified", "id"]).select("provider_id", "document_id", "title", "id")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY provider_id, document_id ORDER BY received_at DESC, change_id DESC) AS n FROM index_changes)
    SELECT provider_id, document_id, change_id, title, modified FROM r WHERE n = 1 AND op = 'index'"""
)
def replace_last_wins(spark, d):
    """What the feed leaves stored: the last operation of each document, deletes gone."""
    log = table(spark, d, "index_changes").select("provider_id", "document_id", "change_id", "op", "title", "modified", "received_at")
    return ops.snapshot(log, ["received_at", "change_id"]).select("provider_id", "document_id", "change_id", "title", "modified")


@query(
    """WITH t AS (SELECT change_id, op, list_concat(CASE WHEN coalesce(owner, '') <> '' THEN ['o:' || owner] ELSE []::VARCHAR[] END,
      list_transform(list_filter(coalesce(users, []), lambda x: x IS NOT NULL AND x <> ''), lambda x: 'u:' || x),
      list_transform(list_filter(coalesce(groups, []), lambda x: x IS NOT NULL AND x <> ''), lambda x: 'g:' || x),
      list_transform(list_filter(coalesce(circles, []), lambda x: x IS NOT NULL AND x <> ''), lambda x: 'c:' || x)) AS t FROM index_changes)
    SELECT change_id, array_to_string(list_sort(list_distinct(t)), ' ') AS tokens, op = 'index' AND len(t) = 0 AS refused FROM t"""
)
def access_tokens(spark, d):
    """The access tokens of every change; an index without any is refused."""
    rows = ops.mapped(table(spark, d, "index_changes"))
    return rows.select("change_id", F.array_join(F.sort_array("tokens"), " ").alias("tokens"), "refused")


@query("SELECT DISTINCT change_id, 'meta' AS kind, t AS value FROM (SELECT change_id, unnest(tags) AS t FROM index_changes) WHERE t IS NOT NULL AND t <> ''")
def tag_rows(spark, d):
    rows = ops.mapped(table(spark, d, "index_changes"))
    return rows.select("change_id", F.explode("tag_rows").alias("t")).select("change_id", "t.kind", "t.value")


@query(
    """WITH t AS (SELECT doc_id, list_sort(list_distinct(list(token))) AS t FROM index_access GROUP BY doc_id)
    SELECT d.id, d.owner, array_to_string(list_transform(list_filter(coalesce(t, []), lambda x: starts_with(x, 'u:')), lambda x: substr(x, 3)), ' ') AS users,
      array_to_string(list_transform(list_filter(coalesce(t, []), lambda x: starts_with(x, 'g:')), lambda x: substr(x, 3)), ' ') AS groups,
      array_to_string(list_transform(list_filter(coalesce(t, []), lambda x: starts_with(x, 'c:')), lambda x: substr(x, 3)), ' ') AS circles
    FROM index_documents d LEFT JOIN t ON t.doc_id = d.id"""
)
def get_documents(spark, d):
    """Every document as it was put in, its access lists given back from the tokens."""
    docs, access, _ = _tables(spark, d)
    rows = ops.with_access(docs.select("id", "owner"), access)
    return rows.select("id", "owner", *[F.array_join(k, " ").alias(k) for k in ("users", "groups", "circles")])


@query("SELECT id FROM index_documents WHERE NOT (provider_id = 'files' AND document_id = (SELECT min(document_id) FROM index_documents WHERE provider_id = 'files'))")
def delete_document(spark, d):
    docs = _docs(spark, d)
    first = docs.filter("provider_id = 'files'").agg(F.min("document_id")).first()[0]
    return ops.delete_document(docs, "files", first).select("id")


@query("SELECT id FROM index_documents WHERE provider_id <> 'files'")
def delete_provider(spark, d):
    return ops.delete_provider(_docs(spark, d), "files").select("id")


@query("SELECT id FROM index_documents WHERE false")
def delete_all(spark, d):
    return ops.reset(_docs(spark, d), "all").select("id")


@query(
    """WITH k AS (SELECT DISTINCT provider_id, document_id FROM index_changes WHERE op = 'delete')
    SELECT k.provider_id, k.document_id, EXISTS (SELECT 1 FROM index_documents d WHERE d.provider_id = k.provider_id AND d.document_id = k.document_id) AS deleted FROM k"""
)
def delete_list(spark, d):
    """The outcome of a list of deletes, document by document."""
    keys = table(spark, d, "index_changes").filter("op = 'delete'")
    return ops.delete_list(_docs(spark, d), keys)[1]


@query("SELECT doc_id, token FROM index_access WHERE doc_id NOT IN (SELECT id FROM index_documents)")
def access_orphans(spark, d):
    docs, access, _ = _tables(spark, d)
    return ops.orphans(access.select("doc_id", "token"), docs)


@query("SELECT CASE WHEN EXISTS (SELECT 1 FROM index_documents WHERE title_norm IS NULL AND content_norm IS NULL) THEN 'stale' ELSE 'ready' END AS state, (SELECT count(*) FROM index_documents WHERE extraction_cause IS NOT NULL) AS flagged")
def health(spark, d):
    """The health card over a usable index: its state and how many rows have a gap."""
    card = ops.health(_docs(spark, d), index_ready=True)
    return card.select("state", F.aggregate(F.map_values("causes"), F.lit(0).cast("long"), lambda a, x: a + x).alias("flagged"))


# harness


@query(
    f"""WITH w AS (SELECT id, {X.sql_tokens(TITLE)} AS tt, {X.sql_tokens(CONTENT)} AS ct FROM index_documents),
    q AS (SELECT id AS query, list_sort(list_filter(tt, lambda x: length(x) >= 5), 'DESC', 'NULLS LAST') AS c, tt FROM w WHERE id % 20 = 0),
    t AS (SELECT query, list_sort(list_transform(c, lambda x: [lpad((100000 - length(x))::VARCHAR, 6, '0'), x]))[1][2] AS term FROM q WHERE len(c) > 0),
    tf AS (SELECT id, term, count(*) AS tf, max(f) AS in_title FROM (SELECT id, unnest(tt) AS term, 1 AS f FROM w UNION ALL SELECT id, unnest(ct), 0 FROM w) GROUP BY 1, 2),
    fig AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(tt) + len(ct)) AS avg_len FROM w),
    df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
    s AS (SELECT query, tf.id, in_title, round(greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(tt) + len(ct)) / avg_len)), 6) AS score
      FROM t JOIN tf USING (term) JOIN df USING (term) JOIN w USING (id), fig),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s)
    SELECT query, count(*) AS hits, round(avg(in_title), 4) AS precision_at_10 FROM r WHERE rank <= 10 GROUP BY query"""
)
def precision_at_10(spark, d):
    """Every 20th row's longest title word as a query against all rows; how many of the best ten have it in the title."""
    from pyspark.sql import Window

    docs = materialize(_docs(spark, d).select("id", X.tokens(TITLE).alias("tt"), X.tokens(CONTENT).alias("ct")), "words")
    longest = F.get(F.array_sort(F.transform(F.filter("tt", lambda x: F.length(x) >= 5), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), F.lit(0))["w"]
    asked = docs.filter("id % 20 = 0").select(F.col("id").alias("query"), longest.alias("term")).filter("term IS NOT NULL")
    words = docs.select("id", F.explode(F.concat(F.transform("tt", lambda x: F.struct(x.alias("term"), F.lit(1).alias("f"))), F.transform("ct", lambda x: F.struct(x.alias("term"), F.lit(0).alias("f"))))).alias("x"))
    tf = words.groupBy("id", F.col("x.term").alias("term")).agg(F.count("*").alias("tf"), F.max("x.f").alias("in_title"))
    tf = tf.join(asked.select("term").distinct(), "term", "left_semi")
    lens = docs.select("id", (F.size("tt") + F.size("ct")).alias("len"))
    n_docs, avg_len = lens.agg(F.count("*"), F.avg("len")).first()
    df = tf.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_FLOOR))
    # the best ten of a term are those of every query asking for it
    scored = tf.join(df, "term").join(lens, "id").withColumn("score", F.round(match.bm25(F.col("tf"), 1.0, F.col("len"), avg_len) * idf, 6))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "id"))).filter("rank <= 10")
    return asked.join(best, "term").groupBy("query").agg(F.count("*").alias("hits"), F.round(F.avg("in_title"), 4).alias("precision_at_10"))


@query(
    """WITH v AS (SELECT viewer, unnest(list_distinct(list_concat(['o:' || viewer, 'u:' || viewer], list_transform(coalesce(groups, []), lambda x: 'g:' || x), list_transform(coalesce(circles, []), lambda x: 'c:' || x)))) AS token FROM accounts),
    n AS (SELECT viewer, count(DISTINCT doc_id) AS total FROM v JOIN index_access USING (token) WHERE doc_id IN (SELECT id FROM index_documents) GROUP BY 1)
    SELECT viewer, coalesce(total, 0) AS total FROM accounts LEFT JOIN n USING (viewer)"""
)
def access_totals(spark, d):
    """How many documents each viewer may see, exactly."""
    docs, access, _ = _tables(spark, d)
    people = table(spark, d, "accounts")
    tokens = people.select("viewer", F.explode(A.token_column(viewer=F.col("viewer"), groups=F.col("groups"), circles=F.col("circles"))).alias("token"))
    live = access.select("doc_id", "token").join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return people.select("viewer").join(A.visible_totals(tokens, live), "viewer", "left").fillna(0, ["total"])


@query("SELECT event_type, list_sort(list(value))[(floor(0.5 * count(*)))::BIGINT + 1] AS p50, list_sort(list(value))[least(floor(0.95 * count(*))::BIGINT, count(*) - 1) + 1] AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    """Percentiles as the value at index floor(q n) of the sorted values, without sorting a group in one task."""
    from textrill.operators.quantile import at_ranks

    return at_ranks(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


# extraction, by round trip over every document


def _round_trip(spark, d, make, extension: str):
    """Every text written in a format and read again."""
    import pyarrow as pa

    from textrill.extract.dispatch import extract_files

    def write(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{i}.{extension}" for i in b.column(0).to_pylist()]), pa.array([make(t) for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "name", "content"])

    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = docs.mapInArrow(write, "doc_id long, name string, content binary")
    return extract_files(files, "name", "content", 64 << 20, None).select("doc_id", "text", "cause")


_LINES = r"SELECT doc_id, {} AS text, NULL::VARCHAR AS cause FROM documents"
# a text node of blanks only becomes one blank
_BLANK_LINES = r"array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: CASE WHEN l <> '' AND regexp_full_match(l, '[ \t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*') THEN ' ' ELSE l END), chr(10)) || chr(10)".replace("\\\\", "\\")


@query(_LINES.format(_BLANK_LINES))
def extract_docx(spark, d):
    from textrill.extract import samples

    return _round_trip(spark, d, samples.docx, "docx")


@query(_LINES.format(_BLANK_LINES))
def extract_xlsx(spark, d):
    from textrill.extract import samples

    return _round_trip(spark, d, samples.xlsx_shared, "xlsx")


@query(_LINES.format(_BLANK_LINES))
def extract_pptx(spark, d):
    from textrill.extract import samples

    return _round_trip(spark, d, samples.pptx, "pptx")


@query(_LINES.format(_BLANK_LINES))
def extract_odt(spark, d):
    from textrill.extract import samples

    return _round_trip(spark, d, samples.odt, "odt")


@query(_LINES.format(r"CASE WHEN regexp_replace(coalesce(text, ''), '\n', '', 'g') = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\P{{C}}\t\n\r]', ' ', 'g'), '^\n+', ''), '\n+', chr(10), 'g'), '\n$', '') || chr(10) END").replace("{{", "{").replace("}}", "}"))
def extract_pdf(spark, d):
    from textrill.extract import samples

    return _round_trip(spark, d, samples.pdf, "pdf")


@query(_LINES.format(r"array_to_string(list_filter(string_split(replace(coalesce(text, ''), chr(160), ' '), chr(10)), lambda l: l <> ''), chr(10)) || CASE WHEN regexp_replace(coalesce(text, ''), '\n', '', 'g') = '' THEN '' ELSE chr(10) END"))
def extract_doc(spark, d):
    from textrill.extract import samples

    return _round_trip(spark, d, samples.doc, "doc")


@query(_LINES.format("coalesce(text, '') || chr(10)"))
def extract_ppt(spark, d):
    from textrill.extract import samples

    return _round_trip(spark, d, lambda t: samples.ppt([t.split("\n")]), "ppt")


@query(r"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\P{C}\t\n\r]') THEN text END AS text, CASE WHEN regexp_matches(text, '[^\P{C}\t\n\r]') THEN 'unsupported' END AS cause FROM documents""")
def extract_plain(spark, d):
    from textrill.extract.dispatch import extract_files

    docs = table(spark, d, "documents")
    files = docs.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    return extract_files(files, "name", "content", 64 << 20).select("doc_id", "text", "cause")


# streaming


@query(_sql["replace_last_wins"])
def stream_last_wins(spark, d):
    """The change feed as a stream: the last operation of each document, kept batch by batch."""
    from textrill.streaming.changes import latest, state_after

    source = table(spark, d, "index_changes")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # the feed as files that arrive one after another
    source.repartitionByRange(4, "change_id").write.parquet(f"{folder}/feed")
    changes = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    run = latest(changes, f"{folder}/state", f"{folder}/checkpoint")
    run.awaitTermination()
    epochs = [p["batchId"] for p in run.recentProgress if p["numInputRows"] > 0]
    return state_after(spark, f"{folder}/state", max(epochs)).filter("op = 'index'").select("provider_id", "document_id", "change_id", "title", "modified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
