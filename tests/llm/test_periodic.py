import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import periodic
from tidemark.llm.queries import QUERIES


def brute(w, least=24, times=3):
    """All maximal stretches of each period, of which the smallest period of each counts."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def words(g, n, kinds, stretches):
    w = [g.randrange(kinds) for _ in range(n)]
    for _ in range(stretches if n >= 30 else 0):
        a, p = g.randrange(n), g.choice([1, 2, 3, 4, 6, 7, 8, 9, 12, g.randint(1, 60)])
        for i in range(a + p, min(n, a + p * g.randint(2, 9) + g.randrange(p))):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (40, 4)])
@pytest.mark.parametrize("block", [1 << 20, 50])
def test_runs_equal_brute_force(monkeypatch, least, times, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    monkeypatch.setattr(periodic, "SLAB", max(7, block >> 6))
    g = random.Random(least + block)
    total = 0
    for _ in range(500):
        w = words(g, g.randint(0, 260), g.choice([1, 2, 3, 5, 40]), g.randint(0, 4))
        want = brute(w, least, times)
        assert periodic.runs(np.array(w, np.int32), least, times) == sorted(want, key=lambda r: (r[0], r[2]))
        total += len(want)
    assert total > 200


def test_runs_within_runs_and_powers():
    inner = [1] * 24 + [2, 3, 4, 5, 6, 7]
    w = inner * 40
    got = periodic.runs(np.array(w, np.int32))
    assert got == sorted(brute(w)) and (0, 1200, 30) in got and sum(p == 1 for *_, p in got) == 40
    assert periodic.runs(np.tile(np.array([1, 2, 3], np.int32), 400)) == [(0, 1200, 3)]  # not 6, 9, ...
    assert periodic.strongest([(0, 30, 7), (5, 60, 14), (9, 60, 14)]) == (0, 30, 7)


def test_a_very_long_text():
    g = np.random.default_rng(5)
    w = g.integers(0, 1000, 600_000).astype(np.int32)
    w[100_000:400_000] = np.tile(w[100_000:175_000], 4)
    w[500_000:500_100] = 7
    got = periodic.runs(w)
    assert [p for *_, p in got] == [75_000, 1] and got[0][0] <= 100_000 and got[0][1] >= 300_000


def digest(doc_id, text):
    w = (text or "").encode().split()
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(w), key=lambda r: (r[0], r[2]))
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    own = [None] * 4 if best is None else [*best, 1000 * best[1] // best[2]]
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *own, sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(), sha256(rest).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    g = random.Random(3)
    docs = [(i, g.choice([" ", "\n", " \x0b\t"]).join(f"wö{x}" for x in words(g, g.randint(0, 300), g.choice([2, 30]), 3))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, " \n "), (303, docs[0][1]), (0, docs[0][1]), (None, "a " * 50), (None, None), (304, "a b " * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, want = sorted(map(tuple, out.collect()), key=str), sorted((digest(*d) for d in docs), key=str)
    assert got == want and sum(r[1] > 0 for r in got) > 20


def test_columns_that_clash_and_empty_tables(spark):
    df = spark.createDataFrame([("b " * 24, 1, "r", 2)], "text string, runs int, RUNS_ string, strongest int")
    got = periodic.find(df)
    assert got.columns == ["text", "runs", "RUNS_", "strongest", "runs__", "strongest_", "collapsed"]
    r = got.first()
    assert (r.runs, r["RUNS_"], r.strongest, r.collapsed) == (1, "r", 2, "b") and [tuple(x) for x in r["runs__"]] == [(0, 24, 1)]
    assert periodic.find(df.limit(0)).count() == 0
