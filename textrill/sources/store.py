"""The stored tables in one folder, written as segments and named by numbered pointers.

A write adds a *segment*: the tables of its new documents (documents, access, tags,
postings, lengths), and the ids of the documents it takes away. It becomes current by
one small pointer file of the next number, written aside and renamed without
overwriting. So readers see all of a write or none of it, a job that dies at any point
changes nothing, and of two writers the second is refused instead of undoing the first.
The old pointer is never removed before the new one stands.

Pointers carry the next free id, so ids are never used again. Reads leave out the ids
that were taken away. When there are more than ``MOST_SEGMENTS`` segments, or more dead
documents than live ones, the next write joins all of them into one.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill import schemas
from textrill.errors import StoreConflict
from textrill.operators import index

TABLES = {"documents": schemas.DOCUMENTS, "access": schemas.ACCESS, "tags": schemas.TAGS, "postings": schemas.POSTINGS, "doc_stats": schemas.DOC_STATS}
DEAD = "doc_id long"
MOST_SEGMENTS = 8
BROADCAST_DEAD = 1_000_000
EMPTY = {"number": 0, "next_id": 1, "segments": [], "dead": [], "live": 0, "gone": 0}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _pointer(self) -> dict | None:
        """The pointer of the highest number."""
        fs, folder = self._fs(f"{self.folder}/pointers")
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = sorted(n for n in names if n.endswith(".json"))
        if not numbers:
            return None
        _, path = self._fs(f"{self.folder}/pointers/{numbers[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, pointer: dict) -> None:
        name = f"{pointer['number']:012d}.json"
        fs, aside = self._fs(f"{self.folder}/pointers/{uuid.uuid4().hex}.aside")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        _, there = self._fs(f"{self.folder}/pointers/{name}")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, there, self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            fs.delete(aside, False)
            if fs.exists(there):
                raise StoreConflict(f"another writer made version {pointer['number']} first; read again and repeat") from error
            raise

    def exists(self) -> bool:
        return self._pointer() is not None

    def create(self) -> None:
        """Empty tables, unless there are some."""
        if not self.exists():
            self._point({**EMPTY, "number": 1})

    def ensure(self) -> list[str]:
        """Creates what is missing; what went wrong comes back as warnings, as a failed step must not stop an installation."""
        try:
            self.create()
            self.read("postings").limit(0).collect()
            return []
        except Exception as error:  # noqa: BLE001 - told, not raised
            return [f"the search index could not be made ready: {error}"]

    def next_id(self) -> int:
        return (self._pointer() or EMPTY)["next_id"]

    # reading

    def _of(self, pointer: dict, name: str) -> DataFrame:
        schema = TABLES[name]
        if not pointer["segments"]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{s}/{name}" for s in pointer["segments"]])
        if not pointer["dead"]:
            return rows
        dead = self.spark.read.schema(DEAD).parquet(*[f"{self.folder}/{s}/dead" for s in pointer["dead"]])
        dead = F.broadcast(dead) if pointer["gone"] <= BROADCAST_DEAD else dead
        key = "id" if name == "documents" else "doc_id"
        return rows.join(dead.withColumnRenamed("doc_id", key), key, "left_anti").select(*schema.names)

    def read(self, name: str) -> DataFrame:
        return self._of(self._pointer() or EMPTY, name)

    # writing

    def apply(self, fresh: dict[str, DataFrame] | None, dead: DataFrame | None, next_id: int | None = None) -> None:
        """Adds the documents, access and tags of ``fresh`` and takes away the documents whose ids are in ``dead`` (doc_id)."""
        old = self._pointer() or EMPTY
        new = {**old, "number": old["number"] + 1, "next_id": max(old["next_id"], next_id or 0)}
        name = f"s-{uuid.uuid4().hex}"
        base = f"{self.folder}/{name}"
        if dead is not None:
            dead.select("doc_id").distinct().write.parquet(f"{base}/dead")
            gone = self.spark.read.schema(DEAD).parquet(f"{base}/dead").count()
            if gone:
                new |= {"dead": [*old["dead"], name], "gone": old["gone"] + gone, "live": old["live"] - gone}
        if fresh is not None:
            new["live"] += self._write(fresh, base)
            new["segments"] = [*old["segments"], name]
        if len(new["segments"]) > MOST_SEGMENTS or new["gone"] > max(new["live"], 1000):
            new = self._compacted(new)
        self._point(new)
        self._forget(keep={*old["segments"], *old["dead"], *new["segments"], *new["dead"]})

    def _write(self, tables: dict[str, DataFrame], base: str) -> int:
        """Writes a segment with the index derived from its documents; returns how many there are."""
        tables["documents"].write.parquet(f"{base}/documents")
        written = self.spark.read.schema(schemas.DOCUMENTS).parquet(f"{base}/documents")
        # independent of each other, so their jobs share the cluster
        with ThreadPoolExecutor(4) as pool:
            jobs = [
                pool.submit(tables["access"].dropDuplicates(["doc_id", "token"]).sortWithinPartitions("token", "doc_id").write.parquet, f"{base}/access"),
                pool.submit(tables["tags"].sortWithinPartitions("kind", "value", "doc_id").write.parquet, f"{base}/tags"),
                pool.submit(index.write_postings, written, base),
                pool.submit(index.write_stats, written, base),
            ]
            for job in jobs:
                job.result()
        return self.spark.read.schema(schemas.DOC_STATS).parquet(f"{base}/doc_stats").count()

    def _compacted(self, pointer: dict) -> dict:
        """All segments as one, without the dead; postings are carried over, not made again."""
        name = f"s-{uuid.uuid4().hex}"
        base = f"{self.folder}/{name}"
        order = {"access": ("token", "doc_id"), "tags": ("kind", "value", "doc_id"), "postings": ("term", "doc_id", "field")}
        for table in TABLES:
            rows = self._of(pointer, table)
            if table == "postings":
                rows = rows.repartitionByRange("term", "doc_id")
            (rows.sortWithinPartitions(*order[table]) if table in order else rows).write.parquet(f"{base}/{table}")
        return {**pointer, "segments": [name], "dead": [], "gone": 0}

    def _forget(self, keep: set[str]) -> None:
        """Segments and pointers before the last ones go; the last ones stay for readers that are under way."""
        fs, path = self._fs(self.folder)
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("s-") and name not in keep:
                fs.delete(status.getPath(), True)
        _, pointers = self._fs(f"{self.folder}/pointers")
        stale = sorted((s for s in fs.listStatus(pointers) if s.getPath().getName().endswith(".json")), key=lambda s: s.getPath().getName())[:-2]
        for status in stale:
            fs.delete(status.getPath(), False)

    def rebuild(self) -> None:
        """The index again from the stored rows."""
        old = self._pointer() or EMPTY
        name = f"s-{uuid.uuid4().hex}"
        live = self._write({t: self._of(old, t) for t in ("documents", "access", "tags")}, f"{self.folder}/{name}")
        self._point({**old, "number": old["number"] + 1, "segments": [name], "dead": [], "gone": 0, "live": live})
        self._forget(keep={name, *old["segments"], *old["dead"]})
