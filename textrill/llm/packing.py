"""Filling containers of fixed capacity (problem 6).

Sum-of-squares packing (Csirik et al.): a document of size s goes where the sum
of the squared numbers of open containers per residual gap becomes smallest,
into an open container with a gap of at least s or into a new one. A document
larger than the capacity is cut into full containers and a rest; no other is cut.

Documents are dealt by hash into lots of about ``LOT`` pieces, each packed by
itself, for all capacities at once. A lot needs memory for its own sizes only;
lots grow in number, not in size, with the collection. A lot's containers that
stay emptier than ``REOPEN`` of the capacity are emptied at the end and
their pieces packed anew, largest first, where they leave the least gap.

Documents without tokens need no space: they are returned with container null
and 0 tokens. Ties are settled by the smaller gap, then by the older container.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.llm.common import materialize, table
from textrill.llm.tokens import token_counts

LOT = 20_000
REOPEN = 0.1
MAX_SPECS = 1_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, in the order given; all sizes in 1..capacity."""
    n_open = np.zeros(capacity + 1, np.int64)  # open containers by gap
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    bins = 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes):
        s = int(s)
        # change of the sum of squares for each gap g >= s: one less at g, one more at g - s
        here = n_open[s:]
        after = n_open[: capacity - s + 1]
        change = 2 * (after - here) + 2
        change[0] = 1 - 2 * here[0]  # a full container is no longer open
        change = np.where(here > 0, change, far)
        g = int(change.argmin())
        fresh = 2 * int(n_open[capacity - s]) + 1 if s < capacity else 0
        if change[g] <= fresh:
            gap = g + s
            b = stacks[gap].pop()
            n_open[gap] -= 1
            left = g
        else:
            b, bins, left = bins, bins + 1, capacity - s
        out[i] = b
        if left:
            n_open[left] += 1
            stacks.setdefault(left, []).append(b)
    return out


def repack(sizes: np.ndarray, where: np.ndarray, capacity: int, share: float = REOPEN) -> np.ndarray:
    """Empties the containers with more than ``share`` unused and packs their items largest first, best fit."""
    if not len(sizes):
        return where
    used = np.bincount(where, sizes).astype(np.int64)
    loose = (capacity - used) > share * capacity
    mine = np.flatnonzero(loose[where])
    order = mine[np.argsort(-sizes[mine], kind="stable")]
    out = where.copy()
    gaps = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    free = iter([*np.flatnonzero(loose), *range(len(used), len(used) + len(order))])
    for i in order:
        s = int(sizes[i])
        at = np.flatnonzero(gaps[s:])
        if len(at):
            gap = s + int(at[0])
            b = stacks[gap].pop()
            gaps[gap] -= 1
        else:
            gap, b = capacity, int(next(free))
        out[i] = b
        if gap > s:
            gaps[gap - s] += 1
            stacks.setdefault(gap - s, []).append(b)
    return np.unique(out, return_inverse=True)[1]


def pack_lot(sizes: np.ndarray, capacity: int) -> np.ndarray:
    return repack(sizes, sum_of_squares(sizes, capacity), capacity)


def pack(counts: DataFrame, key: str, capacities: list[tuple[int, int]], lot: int = LOT) -> DataFrame:
    """(spec_id, container, key, piece, tokens) for ``counts`` (key, tokens), a materialized table.

    ``capacities`` are (spec_id, capacity) pairs. Containers are numbered lot by
    lot: ``container`` is the lot's number times 2^32 plus a number in the lot.
    """
    if len(capacities) > MAX_SPECS:
        raise ValueError(f"at most {MAX_SPECS} capacities")
    if any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive")
    schema = "spec_id int, container long, id long, piece int, tokens int"
    fields = pa.schema([("spec_id", pa.int32()), ("container", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int32())])
    lots = max(1, -(-counts.count() // lot))
    specs = F.array(*[F.struct(F.lit(int(a)).cast("int").alias("spec_id"), F.lit(int(b)).cast("int").alias("capacity")) for a, b in capacities])
    rows = counts.select(F.col(key).alias("id"), "tokens", F.explode(specs).alias("spec")).select("id", "tokens", "spec.spec_id", "spec.capacity", F.pmod(F.xxhash64("id"), F.lit(lots)).alias("lot"))

    def run(at: tuple, data: pa.Table) -> pa.Table:
        spec, number, capacity = at[0].as_py(), at[1].as_py(), data.column("capacity")[0].as_py()
        ids, tokens = data.column("id").to_numpy(), data.column("tokens").to_numpy()
        order = np.lexsort((ids, _scatter(ids)))  # an order of its own, the same on every run
        ids, tokens = ids[order], tokens[order]
        full, rest = np.divmod(tokens, capacity)
        some = rest > 0
        where = np.zeros(len(ids), np.int64)
        where[some] = pack_lot(rest[some], capacity)
        first = int(where.max()) + 1 if len(where) else 0
        n_full = int(full.sum())
        cut = np.repeat(np.arange(len(ids)), full)
        piece_full = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
        empty = tokens == 0
        base = number << 32
        out = {
            "spec_id": np.full(n_full + int(some.sum()), spec, np.int32),
            "container": base + np.concatenate([first + np.arange(n_full), where[some]]),
            "id": np.concatenate([ids[cut], ids[some]]),
            "piece": np.concatenate([piece_full, full[some]]).astype(np.int32),
            "tokens": np.concatenate([np.full(n_full, capacity), rest[some]]).astype(np.int32),
        }
        packed = pa.Table.from_pydict(out, fields)
        none = int(empty.sum())
        if none:
            packed = pa.concat_tables([packed, pa.Table.from_pydict({"spec_id": [spec] * none, "container": [None] * none, "id": ids[empty], "piece": [0] * none, "tokens": [0] * none}, fields)])
        return packed

    return rows.groupBy("spec_id", "lot").applyInArrow(run, schema).withColumnRenamed("id", key)


def _scatter(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _packed(spark, sf_dir) -> DataFrame:
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "p6-counts")
    specs = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens").limit(MAX_SPECS + 1).collect()
    return pack(counts, "doc_id", [tuple(r) for r in specs])


def p6_packed(spark, sf_dir):
    """Every piece of every document with its container, for each capacity of pack_specs."""
    return _packed(spark, sf_dir)


def p6_report(spark, sf_dir):
    """For each capacity: containers, tokens and the share of space left unused."""
    specs = table(spark, sf_dir, "pack_specs")
    by = _packed(spark, sf_dir).filter("container IS NOT NULL").groupBy("spec_id", "container").agg(F.sum("tokens").alias("used"))
    totals = by.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return totals.join(F.broadcast(specs.limit(MAX_SPECS)), "spec_id").withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
