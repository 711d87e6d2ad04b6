import random
from collections import Counter

import numpy as np

from tidemark.llm import minhash
from tidemark.llm.queries import QUERIES


UPPER = {c: c - 32 for c in range(97, 123)}


def sets(text):
    w = [x for x in "".join(c.lower() if c.isalnum() else " " for c in text or "").split()]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, threshold=0.8):
    parent = {d: d for d, _ in docs if d is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = [(d, t, sets(t)) for d, t in docs if d is not None and t]
    for i, (d, t, a) in enumerate(s):
        for e, u, b in s[:i]:
            if t == u or (a and b and (a & b).total() >= threshold * (a | b).total()):
                x, y = sorted((top(d), top(e)))
                parent[y] = x
    return {d: top(d) for d in parent}


def corpus():
    g = random.Random(8)
    vocab = ["".join(g.choice(["er", "ti", "an", "ö", "sh"]) for _ in range(g.randint(1, 4))) for _ in range(400)]
    docs = [(i, " ".join(g.choice(vocab) for _ in range(g.choice([0, 1, 3, 5, 30, 100, 127, 128, 260])))) for i in range(150)]
    for i in range(60):
        w = docs[i][1].split()
        for _ in range(2):
            v = list(w)
            for _ in range(max(1, len(v) // 60)) if v else ():
                v[g.randrange(len(v))] = "changed"
            docs.append((len(docs), " ".join(v) if g.random() < 0.5 else ", ".join(v).translate(UPPER)))
    docs += [(1000 + i, docs[70][1]) for i in range(40)]
    long = " ".join(g.choice(vocab) for _ in range(200)).split()
    for i in range(120):  # a large group of near copies
        v = list(long)
        v[i] = f"own{i}"
        docs.append((2000 + i, " ".join(v)))
    # Repeated runs count: the same sets, of which only some have the same weights.
    base = [g.choice(vocab) for _ in range(20)]
    docs += [(3000 + n, " ".join(base * n + [g.choice(vocab) for _ in range(2)])) for n in (2, 3, 9, 10, 11)]
    return docs + [(5000, None), (5001, ""), (5002, "!!!"), (5003, "!!!"), (5004, "?"), (None, docs[3][1]), (None, None)]


def test_query_equals_brute_force(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op2_minhash"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == brute(docs)
    assert all(r.class_id is None for r in rows if r.doc_id is None)


def test_collisions_follow_the_weighted_similarity():
    g = np.random.default_rng(2)
    for common, only, scale, w in ((80, 20, 6, 1), (60, 60, 6, 1), (900, 100, 9, 1), (3, 1, 2, 1), (40, 10, 6, 3)):
        element = g.integers(0, 1 << 62, common + 2 * only).astype(np.uint64)
        row = np.repeat([0, 1], [common + only, common + only])
        both = np.concatenate([element[: common + only], element[:common], element[common + only :]])
        s = minhash.sign(row, both, np.full(len(both), w, np.int64), scale, 2, 4000)
        assert abs((s[0] == s[1]).mean() - common / (common + 2 * only)) < 0.04
    weights = np.array([3, 1, 1, 2], np.int64)
    s = minhash.sign(np.array([0, 0, 1, 1]), np.array([7, 8, 7, 8], np.uint64), weights, 2, 2, 4000)
    assert abs((s[0] == s[1]).mean() - 2 / 5) < 0.04


def test_drifting_copies_in_small_blocks(spark, monkeypatch):
    """Copies of copies, where most of a band is unlike its centre."""
    monkeypatch.setattr(minhash, "UNLIKE_BLOCK", 3)
    monkeypatch.setattr(minhash, "MEMBER_BLOCK", 5)
    g = random.Random(12)
    texts = [[f"w{g.randrange(10**6)}" for _ in range(120)]]
    for _ in range(80):
        v = list(g.choice(texts))
        for _ in range(3):
            v[g.randrange(len(v))] = f"n{g.randrange(10**6)}"
        texts.append(v)
    docs = [(i, " ".join(v)) for i, v in enumerate(texts)]
    got = minhash.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.id: r.class_id for r in got.collect()} == brute(docs)


def test_chain_of_bands_and_clashing_columns(spark):
    g = random.Random(4)
    words = [f"w{g.randrange(10**6)}" for _ in range(300)]
    docs = [(i, " ".join(words[12 * i : 12 * i + 150]), "x") for i in range(8)] + [(9, "a b", "y"), (9, "a b", "y"), (None, "n", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, id string").selectExpr("text", "doc_id", "id", "id as class_id", "1 as a", "id as x")
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    want = brute([(d, t) for d, t, _ in docs])
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, {*want.values(), None}))
    assert minhash.deduplicate(df.limit(0)).count() == 0


def test_weights_decide(spark):
    """Two texts with the same runs of words are alike only as far as they repeat them alike."""
    line = " ".join(f"w{i}" for i in range(20)) + " "
    docs = [(1, line * 2), (2, line * 20), (3, line * 19)]
    got = {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) == {1: 1, 2: 2, 3: 2}


def test_unlike_texts_under_one_id_all_stay(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "b " + text, "p"), (1, "a " + text, "q"), (1, "c", "r"), (2, None, "s"), (2, None, "s"), (3, "c", "t"), (4, "d", "u"), (4, "d", "v"), (5, "", "w"), (5, None, "w"), (None, "c", "x"), (None, "c", "x")]
    got = set()
    for n in (1, 5):
        kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(n)).collect()
        got.add(tuple(sorted(map(str, kept))))
        near = [r for r in kept if r.text and r.text.endswith(text)]
        rest = sorted((tuple(r) for r in kept if r not in near), key=str)
        assert len(near) == 1 and near[0].doc_id == 1
        assert [r[:2] for r in rest] == sorted([(1, "c"), (2, None), (4, "d"), (5, ""), (5, None), (None, "c"), (None, "c")], key=str)
    assert len(got) == 1


def test_one_very_long_text(spark):
    g = random.Random(3)
    w = [f"w{g.randrange(5000)}" for _ in range(1_200_000)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:-50])), (3, "short text of its own")]
    got = {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
