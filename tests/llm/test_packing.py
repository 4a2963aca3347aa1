import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textrill.llm import packing as K
from textrill.llm.tokens import Counter, encoding, token_counts


def slow_sum_of_squares(sizes, capacity):
    """The rule written out: try every choice, keep the least sum of squares."""
    gaps, out = [], []
    for s in sizes:
        best = None
        for b in [*range(len(gaps)), None]:
            if b is not None and gaps[b] < s or b is not None and gaps[b] == 0:
                continue
            g = list(gaps)
            if b is None:
                g.append(capacity - s)
            else:
                g[b] -= s
            counts = np.bincount([x for x in g if 0 < x < capacity] or [0], minlength=capacity + 1)
            counts[0] = 0
            value = int((counts.astype(np.int64) ** 2).sum())
            if best is None or value < best[0]:
                best = (value, b)
        if best[1] is None:
            gaps.append(capacity - s)
            out.append(len(gaps) - 1)
        else:
            gaps[best[1]] -= s
            out.append(best[1])
    counts = np.bincount([x for x in gaps if 0 < x < capacity] or [0], minlength=capacity + 1)
    counts[0] = 0
    return int((counts.astype(np.int64) ** 2).sum()), out


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 24).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=25))))
def test_never_too_full_and_greedy(case):
    capacity, sizes = case
    where = K.sum_of_squares(np.array(sizes, np.int64), capacity)
    used = np.bincount(where, sizes) if sizes else np.array([])
    assert (used <= capacity).all()
    # each step is as good as the best step by trial
    for n in range(1, len(sizes) + 1):
        before = K.sum_of_squares(np.array(sizes[: n - 1], np.int64), capacity)
        gaps = list(capacity - np.bincount(before, sizes[: n - 1]).astype(int)) if n > 1 else []
        after = list(capacity - np.bincount(where[:n], sizes[:n]).astype(int))

        def squares(g):
            c = np.bincount([x for x in g if 0 < x < capacity] or [0], minlength=capacity + 1)
            c[0] = 0
            return int((c.astype(np.int64) ** 2).sum())

        choices = [squares([*gaps, capacity - sizes[n - 1]])] + [squares([*gaps[:b], g - sizes[n - 1], *gaps[b + 1 :]]) for b, g in enumerate(gaps) if g >= sizes[n - 1]]
        assert squares(after) == min(choices)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_repacking_keeps_all(sizes):
    s = np.array(sizes, np.int64)
    where = K.pack_lot(s, 50)
    assert len(where) == len(s)
    used = np.bincount(where, s) if len(s) else np.array([])
    assert (used <= 50).all() and (used > 0).all()
    first = K.sum_of_squares(s, 50)
    assert len(used) <= len(np.unique(first))


def test_little_waste():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 200, 5000)
    where = K.pack_lot(sizes, 256)
    assert sizes.sum() / (256 * (where.max() + 1)) > 0.97


def test_over_a_table(spark):
    rows = [(i, (i * 37) % 300) for i in range(500)] + [(1000, 0), (1001, 5000), (1002, 256), (1003, 256)]
    df = spark.createDataFrame(rows, "doc_id long, tokens int")
    got = K.pack(df, "doc_id", [(1, 256), (2, 1000), (3, 1)], lot=100).collect()
    tokens = dict(rows)
    for spec, capacity in ((1, 256), (2, 1000), (3, 1)):
        mine = [r for r in got if r["spec_id"] == spec]
        total, fill = {}, {}
        for r in mine:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
            if r["container"] is not None:
                fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        assert total == tokens
        assert max(fill.values()) <= capacity
        cut = [r for r in mine if tokens[r["doc_id"]] <= capacity]
        assert len(cut) == len({r["doc_id"] for r in cut})
        assert {r["doc_id"] for r in mine if r["container"] is None} == {d for d, t in rows if t == 0}
    again = K.pack(df, "doc_id", [(1, 256), (2, 1000), (3, 1)], lot=100).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert K.pack(df.limit(0), "doc_id", [(1, 256)]).count() == 0
    with pytest.raises(ValueError):
        K.pack(df, "doc_id", [(1, 0)])


def test_tokens(spark):
    texts = ["Hello  world", "l'estel ï \n\n x", " lead", "tail  ", "", None, "a" * 100_000, "1,2.3 €— 漢字 🎉 \t\n", "x\r\n y"]
    counter = Counter()
    for t in texts:
        assert counter.count(t) == (len(encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary(t)) if t else 0)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id long, t string, source string")
    got = {r["id"]: (r["source"], r["tokens"]) for r in token_counts(df, "id", "t", ["source"]).collect()}
    assert got == {i: ("s", counter.count(t)) for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_add_up(text):
    text = text.encode("utf-8", "ignore").decode()
    assert Counter().count(text) == len(encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary(text))
