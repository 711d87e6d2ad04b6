import random
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def elements(text):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(docs, percent=85):
    """The size of each row's set, and the component of each id."""
    s = [(d, elements(t)) for d, t in docs]
    of = {d: d for d, _ in docs if d is not None}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for (d, a), (e, b) in combinations(s, 2):
        if d is not None and e is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((top(d), top(e)))
            of[y] = x
    return sorted(((d, len(a), None if d is None else top(d) if a else d) for d, a in s), key=str)


def corpus(seed, sizes, copies, changes):
    g = random.Random(seed)
    vocab = ["".join(g.choice(["er", "ti", "an", "ö", "Sh"]) for _ in range(g.randint(1, 4))) for _ in range(500)]
    passage = [g.choice(vocab) for _ in range(30)]
    texts = [[g.choice(vocab) for _ in range(g.choice(sizes))] for _ in range(100)]
    for t in texts[:20]:
        t[3:3] = passage
    for t in [*texts]:
        for _ in range(g.randint(0, copies)):
            v = list(t)
            for _ in range(g.randint(0, changes) if v else 0):
                k = g.randrange(len(v) + 1)
                v[k : k + g.randint(0, 1)] = [g.choice(vocab)] * g.randint(0, 1)
            texts.append(v)
    return [(i, g.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]


ODD = [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "a b c"), (9006, "a b c"), (None, "a b c"), (None, None)]


@pytest.mark.parametrize(("seed", "sizes", "copies", "changes", "light"), [(1, [0, 1, 3, 4, 16, 20, 27], 4, 2, None), (2, [40, 80, 120, 127, 300], 4, 4, None), (3, [14, 20, 22, 24, 27, 30], 6, 2, 24), (4, [14, 20, 24, 40], 6, 2, 0)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, seed, sizes, copies, changes, light):
    docs = corpus(seed, sizes, copies, changes) + ODD
    if light is not None:  # whatever the boundary, the same links
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_jaccard_join"](spark, str(tmp_path)).collect()), key=str)
    want = brute(docs)
    assert got == want and len({c for *_, c in want}) < len(want) - 30


@pytest.mark.parametrize(("rounds", "dense"), [(1, 2), (1, 0), (3, 2)])
def test_lists_with_several_components_in_small_blocks(spark, monkeypatch, rounds, dense):
    """Copies of copies: most of a list is unlike its centre."""
    monkeypatch.setattr(jaccard_join, "OUTSIDE_BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "MEMBER_BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "SCANNED", 100)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    g = random.Random(12)
    texts = [[f"w{g.randrange(10**6)}" for _ in range(150)]]
    for _ in range(80):
        v = list(g.choice(texts))
        for _ in range(g.randint(1, 5)):
            v[g.randrange(len(v))] = f"n{g.randrange(10**6)}"
        texts.append(v)
    docs = [(i, " ".join(v)) for i, v in enumerate(texts)]
    got = jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)


def test_rows_that_share_an_id_and_other_columns(spark):
    g = random.Random(4)
    a, b = ([f"{c}{g.randrange(10**6)}" for _ in range(100)] for c in "ab")
    docs = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "x"])), (4, " ".join([*b, "y"])), (7, " ".join(a)), (8, "z " * 60), (8, "z " * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("'n' AS n", "text", "doc_id", "1 AS id", "2 AS rep", "3 AS token")
    got = sorted((tuple(r) for r in jaccard_join.components(df).collect()), key=str)
    assert got == brute(docs) and {c for d, _, c in got if d != 8} == {4}
    assert jaccard_join.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_sizes_and_subsets_are_exact(percent):
    for t in range(1, 60):
        own = jaccard_join.partners(t, 10**6, percent)
        for s in range(1, 140):
            c = jaccard_join.overlap(s, t, percent)
            assert 100 * c >= percent * (s + t - c) and (c == 0 or 100 * (c - 1) < percent * (s + t - c + 1))
            assert (s in own) == (100 * min(s, t) >= percent * max(s, t))
            if s in own and c <= min(s, t):
                assert t - c + 1 <= jaccard_join.listed(np.array([t]), percent)[0]
    g = np.random.default_rng(1)
    x = g.integers(0, 1 << 62, 12).astype(np.uint64)
    for drop in range(4):
        y = x[drop:]
        kx, ky = (set(zip(*(v.tolist() for v in jaccard_join.subsets(z, 24, percent)), strict=True)) for z in (x, y))
        linked = 100 * len(y) >= percent * 12
        assert any(k in ky and k[1:] == (len(y), 12) for k in kx) == linked


def test_the_boundary_follows_the_cost():
    assert jaccard_join.boundary({10: 100, 20: 100}, {10: 100_000, 20: 100_000, 24: 1}) == 10
    assert jaccard_join.boundary({10: 100, 20: 100}, {10: 100_000, 20: 10**9}) == 20
    assert jaccard_join.boundary({10: 100}, {}) == 0


def test_one_very_long_text(spark):
    g = random.Random(3)
    w = [f"w{g.randrange(5000)}" for _ in range(400_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:-50])), (3, " ".join(w[:200_000])), (4, "short text of its own")]
    got = {r.id: r.component_id for r in jaccard_join.components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_cells_bound_the_overlap():
    g = np.random.default_rng(7)
    for n, m, common in ((1, 1, 1), (20, 23, 20), (400, 380, 350), (130, 127, 125), (5000, 4600, 4590), (300, 300, 0)):
        x = g.integers(0, 1 << 63, n, np.uint64)
        y = np.concatenate([x[:common], g.integers(0, 1 << 63, m - common, np.uint64)])
        (a,), (b,) = (jaccard_join.cells(z, np.zeros(len(z), np.int64), np.array([len(z)])) for z in (x, y))
        a, b = (np.frombuffer(z, np.uint8) for z in (a, b))
        assert a.sum() == n and b.sum() == m
        assert common <= jaccard_join.bound(a, b[None, :])[0] == jaccard_join.bound(b, a[None, :])[0] <= min(n, m)
    assert jaccard_join.bound(a, b[None, :])[0] < 0.9 * 300  # unlike sets are told apart
    full = np.full(4, 255, np.uint8)
    assert jaccard_join.bound(full, full[None, :])[0] > 10**9
