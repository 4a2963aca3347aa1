"""Near duplicates against brute force, hot groups included."""

import itertools
import random

import pytest

from textrill.llm import neardup as N
from textrill.llm.common import materialize
from textrill.llm.components import components

VOCAB = [f"w{i}" for i in range(400)]


def truth(rows):
    sets = {}
    for i, t in rows:
        w = N.words_of(t) if t else []
        if len(w) >= N.LEAST_WORDS:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= N.THRESHOLD}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, n = [], 0
    for _ in range(60):
        base = rng.choices(VOCAB, k=rng.randint(25, 90))
        for _ in range(rng.choice([1, 1, 2, 3])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            out.append((n, " ".join(words)))
            n += 1
    hot = " ".join(rng.choices(VOCAB, k=40))
    out += [(n + i, hot if i % 3 else hot + f" end{i}") for i in range(90)]  # a third of all rows alike
    out += [(9001, None), (9002, ""), (9003, "too short"), (9004, hot.upper()), (9005, hot.replace("w", "ẃ"))]
    return out


def test_pairs(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, t string, shingles string")
    found = materialize(N.features(df, "id", "t"), "f")
    members, linked = N.links(found)
    got = [(r["id_a"], r["id_b"]) for r in N.all_pairs(members, linked).collect()]
    assert len(got) == len(set(got))
    assert set(got) == truth(rows)


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "id long, t string")
    found = materialize(N.features(df, "id", "t"), "f")
    members, linked = N.links(found)
    got = {r["id"]: r["group"] for r in N.groups(members, materialize(linked, "l")).collect()}
    parent = {i: i for i in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in truth(rows):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {i: root(i) for i in got}


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(3)], "k long, id long")
    got = [(r["k"], r["a_id"], r["b_id"]) for r in N.pairs_within(df, "k", "id", []).collect()]
    want = [(k, a, b) for k, n in ((1, 50), (2, 3)) for a, b in itertools.combinations(range(n), 2)]
    assert sorted(got) == want


def test_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(rows, "id long, t string")
    members, linked = N.links(materialize(N.features(df, "id", "t"), "f"))
    assert {(r["id_a"], r["id_b"]) for r in N.all_pairs(members, linked).collect()} == truth(rows)


def test_sketch_estimates():
    rng = random.Random(1)
    for share in (0.6, 0.75, 0.9):
        ones = []
        for _ in range(40):
            both = [rng.getrandbits(63) for _ in range(int(200 * share))]
            rest = int(200 * (1 - share) / 2)
            a, b = (N.np.unique(N.np.array(both + [rng.getrandbits(63) for _ in range(rest)], N.np.uint64)) for _ in range(2))
            x = N.odd_sketch(N.minhash(a, N.BANDS * N.DEPTH)) ^ N.odd_sketch(N.minhash(b, N.BANDS * N.DEPTH))
            ones.append(sum(bin(int(w) & (2**64 - 1)).count("1") for w in x))
        assert abs(sum(ones) / len(ones) - N.most_ones(share)) < 8


def test_long_and_empty(spark):
    long = " ".join(f"x{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, None)], "id long, t string")
    members, linked = N.links(materialize(N.features(df, "id", "t"), "f"))
    assert [(r["id_a"], r["id_b"]) for r in N.all_pairs(members, linked).collect()] == [(1, 2)]
    members, linked = N.links(materialize(N.features(df.limit(0), "id", "t"), "f"))
    assert N.all_pairs(members, linked).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102), (5, 5), (None, 7), (200, 199)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    rows = []
    for i in range(600):
        both = [f"c{i}x{j}" for j in range(62)]
        for side in "ab":
            rows.append((len(rows), " ".join([*both, *[f"{side}{i}x{j}" for j in range(20)]])))  # 60 of 100 shingles
    df = spark.createDataFrame(rows, "id long, t string")
    members, linked = N.links(materialize(N.features(df, "id", "t"), "f"))
    assert {(r["rep_a"], r["rep_b"]) for r in linked.collect()} == {(i, i + 1) for i in range(0, 1200, 2)}


def test_the_sketch_drops_no_pair_at_the_threshold():
    rng = N.np.random.default_rng(3)
    k, dropped = N.BANDS * N.DEPTH, 0
    for _ in range(10_000):
        a = rng.integers(0, 2**63, k, dtype=N.np.uint64)
        b = N.np.where(rng.random(k) < N.THRESHOLD, a, rng.integers(0, 2**63, k, dtype=N.np.uint64))
        ones = sum(int(x).bit_count() for x in (N.odd_sketch(a) ^ N.odd_sketch(b)).view(N.np.uint64))
        dropped += ones > N.most_ones(N.THRESHOLD - N.SLACK)
    assert dropped == 0
