"""The facade: index, search, delete, look up, check, over a store."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill import runtime
from textrill.config import PROFILES, Config, offered
from textrill.errors import UnsupportedEngine
from textrill.extract.common import ENGINE_CEILING, TIME_CAP
from textrill.operators import access as A
from textrill.operators import cover, match, ops, search
from textrill.plans.query import Compiled, Request, compile_query
from textrill.sources.documents import with_content
from textrill.sources.store import Store

log = logging.getLogger(__name__)
PROBE = "zzqjprobe00000000"


class SearchEngine:
    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, seconds: float | None = TIME_CAP):
        runtime.ship(spark)
        self.spark, self.config, self.seconds = spark, config or Config(), seconds
        self.store = Store(spark, folder)

    # settings

    def languages(self) -> list[str]:
        return offered()

    def set_language(self, language: str) -> None:
        self.config = self.config.with_language(language)

    def set_content_bytes(self, content_bytes: int) -> None:
        self.config = self.config.with_content_bytes(content_bytes)

    # writing

    def index(self, documents: DataFrame) -> DataFrame:
        """Replaces or adds documents, and deletes those with op 'delete'; one outcome row each.

        Input columns: provider_id, document_id, title, content, content_encoded, owner, users, groups,
        circles, tags, link, source, hash, modified, and op if there are deletes. Of several versions of
        a document in one call the last is taken, by what there is of received_at, change_id and modified,
        in this order; versions that tie in all of them are told apart by title, content and hash. A document
        without any access token is refused and its stored row kept.

        Ids are new ones in every call and follow the order of (provider_id, document_id).
        """
        rows = documents if "op" in documents.columns else documents.withColumn("op", F.lit("index"))
        order = [c for c in ("received_at", "change_id", "modified") if c in rows.columns]
        rows = ops.last_wins(rows, [*order, *[c for c in ("title", "content", "hash") if c in rows.columns]])
        rows = with_content(ops.mapped(rows), self.config.content_bytes, self.seconds)
        if self.config.ceiling_bytes:
            rows = ops.engine_ceiling(rows, "text", self.config.ceiling_bytes)
            rows = rows.withColumn("cause", F.when(F.col("ceiling") & F.col("cause").isNull(), ENGINE_CEILING).otherwise(F.col("cause"))).drop("ceiling")
        # sorted slices with their numbers, so that ids follow the key at any size and no task sees all rows
        slices = rows.repartitionByRange(*ops.KEY).sortWithinPartitions(*ops.KEY)
        done = runtime.materialize(slices.withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "indexed")
        first, starts = self.store.next_id(), []
        for r in done.groupBy("_slice").count().orderBy("_slice").collect():  # a row a slice
            starts += [F.lit(r["_slice"]), F.lit(first)]
            first += r["count"]
        numbered = done.withColumn("id", F.col("_at") + F.try_element_at(F.create_map(*starts), F.col("_slice"))) if starts else done.withColumn("id", F.col("_at"))
        fresh = numbered.filter("op = 'index' AND NOT refused")
        gone = done.filter("NOT refused").select(*ops.KEY)
        dead = self.store.read("documents").select("id", *ops.KEY).join(gone, ops.KEY, "left_semi").select(F.col("id").alias("doc_id"))
        self.store.apply(
            {
                "documents": fresh.select("id", *ops.KEY, "owner", "title", F.coalesce("text", F.lit("")).alias("content"), "link", "source", "modified", "hash", F.col("cause").alias("extraction_cause")),
                "access": fresh.select(F.col("id").alias("doc_id"), F.explode("tokens").alias("token")),
                "tags": fresh.select(F.col("id").alias("doc_id"), F.explode("tag_rows").alias("t")).select("doc_id", "t.kind", "t.value"),
            },
            dead,
            first,
        )
        status = F.when(F.col("op") == "delete", "removed").when(F.col("refused"), "failed").otherwise("done")
        return done.select(*ops.KEY, status.alias("status"), "extracted", "cause", F.when(F.col("refused"), "no access token").otherwise(F.col("message")).alias("message"), F.when(F.col("refused"), 3).otherwise(F.col("severity")).alias("severity"))

    def _remove(self, docs: DataFrame) -> None:
        self.store.apply(None, docs.select(F.col("id").alias("doc_id")))

    def delete(self, provider: str, document: str) -> None:
        self._remove(self.store.read("documents").filter((F.col("provider_id") == provider) & (F.col("document_id") == document)))

    def delete_list(self, keys: DataFrame) -> DataFrame:
        stored = self.store.read("documents")
        outcome = runtime.materialize(ops.delete_list(stored, keys)[1], "outcome")
        self._remove(stored.join(outcome.filter("deleted").select(*ops.KEY), ops.KEY, "left_semi"))
        return outcome

    def reset(self, provider: str = "all") -> None:
        stored = self.store.read("documents")
        self._remove(stored if provider == "all" else stored.filter(F.col("provider_id") == provider))

    def rebuild(self) -> None:
        self.store.rebuild()

    # searching

    def _found(self, request: Request, tokens: list[str]) -> DataFrame:
        self._supported()
        request = request.checked()
        for name in request.widening:
            log.debug("search option not offered, skipped: %s", name)
        query = compile_query(request.search, self.config.profile)
        hits = None if query.browse else self._hits(query)
        return search.base(self.store.read("documents"), self.store.read("access"), self.store.read("tags"), request, tokens, query, hits)

    def _hits(self, query: Compiled) -> DataFrame:
        """The matching documents with the rank of the profile, from the stored index: cover density under tsquery."""
        post, stats = self.store.read("postings"), self.store.read("doc_stats")
        return cover.cover_hits(post, stats, query) if query.profile == "tsquery" and self.config.cover_density else match.index_hits(post, stats, query)

    def _supported(self) -> None:
        if self.config.profile not in PROFILES:
            raise UnsupportedEngine(self.config.profile)

    def search(self, request: Request, viewer: str = "", groups=(), circles=()) -> tuple[DataFrame, DataFrame]:
        """(page with titles and excerpts, one-row total) of a request, as the viewer may see it."""
        found = self._found(request, A.viewer_tokens(viewer=viewer, groups=groups, circles=circles))
        return search.shaped(search.page(found, request), self.store.read("documents"), request).orderBy(F.desc("score"), "id"), search.total(found)

    # upkeep

    def get_document(self, provider: str, document: str) -> DataFrame:
        return ops.get_document(self.store.read("documents"), self.store.read("access"), provider, document)

    def ensure(self) -> list[str]:
        """Creates the store if there is none; the warnings of what could not be done."""
        return self.store.ensure()

    def probe(self) -> bool:
        """Whether a search runs; a missing or broken index says no instead of raising."""
        try:
            self._supported()
            if not self.store.exists():
                return False
            self._hits(compile_query(PROBE, self.config.profile)).limit(1).collect()
            return True
        except Exception:  # noqa: BLE001 - the answer is no
            return False

    def causes(self) -> DataFrame:
        return ops.causes(self.store.read("documents"))

    def stale(self) -> DataFrame:
        """Stored documents that the index does not hold."""
        return self.store.read("documents").join(self.store.read("doc_stats").select(F.col("doc_id").alias("id")), "id", "left_anti")

    def health(self) -> dict:
        """The health card. State: the first that applies of engine (no such profile), missing, unusable (a search fails), stale, ready."""
        if self.config.profile not in PROFILES:
            state = "engine"
        elif not self.store.exists():
            state = "missing"
        elif not self.probe():
            state = "unusable"
        else:
            state = "ready" if self.stale().limit(1).isEmpty() else "stale"
        try:
            counts = {r["extraction_cause"]: r["n"] for r in self.causes().collect()}
        except Exception:  # noqa: BLE001 - counts never break the card
            counts = {}
        return {"state": state, "language": self.config.language, "languages": self.languages(), "content_bytes": self.config.content_bytes, "causes": counts}
