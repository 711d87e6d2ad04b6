import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocation
from tidemark.llm.arrow_text import utf8

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return [w for p in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)) if (w := [x for x in re.split("[ \t]+", p) if x])]


def brute(docs, least, top=2000, covered=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in words_of(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    known = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    most = Counter()
    for (lang, p), a in known.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i : i + k]] = max(most[lang, p[i : i + k]], a)
    rows = []
    for (lang, p), a in known.items():
        if 100 * most[lang, p] < covered * a:
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((lang, -s, -a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out, rank = [], Counter()
    for lang, s, a, p, le, r, m in sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3].encode())):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p, -a, le, r, m, -s))
    return sorted(out)


def corpus(seed, rows):
    g = random.Random(seed)
    vocab = ["".join(g.choice(["er", "Ti", "an", "ö", "ß"]) for _ in range(g.randint(1, 3))) for _ in range(60)]
    line = "Copyright of the  whole\tsentence in one line"
    docs = []
    for _ in range(rows):
        w = [vocab[min(59, int(g.expovariate(0.15)))] + g.choice(["", "", "", ",", ".", "\n", "\x0b", "!?"]) for _ in range(g.randint(0, 120))]
        docs.append((g.choice(["en", "de", None, ""]), g.choice([" ", "  ", "\t"]).join(w) + g.choice(["", "\n" + line, line.upper() + ":"])))
    return docs + [docs[5]] * 40 + [("en", None), (None, None), ("fr", ""), ("fr", " .,;"), ("zz", "alone")]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many parts and buckets, some ranges cut
        monkeypatch.setattr(collocation, "PART_BYTES", 1000)
        monkeypatch.setattr(collocation, "BUCKET_BYTES", 3000)
    docs = corpus(1, 150)
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("text", "'x' AS phrase", "lang", "1 AS n", "2 AS part").repartition(3)
    for least, top, covered in ((6, 2000, 100), (12, 7, 60)) if small else ((6, 2000, 100),):
        got = sorted(map(tuple, collocation.mine(df, least=least, top=top, covered=covered).collect()))
        want = brute(docs, least, top, covered)
        assert got == want and len(want) >= 7 and {x[0] for x in want} >= {"", "en", "und"}


def test_empty_table_and_texts_without_phrases(spark):
    df = spark.createDataFrame([("en", None), ("en", "a b c")], "lang string, text string")
    assert collocation.mine(df).count() == 0 and collocation.mine(df.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    """Scores of counts that no corpus here could reach."""
    big = 3_000_000_000_000
    known = [("en", "a b", big), ("en", "a", big + 7), ("en", "b", 2 * big + 1), ("en", "a b c", big - 5), ("en", "c", big), ("en", "b c", big)]
    n = 40 * big + 3
    tables = (spark.createDataFrame(known, "lang string, phrase string, f long"), spark.createDataFrame([("en", n)], "lang string, n long"))
    f = {p: a for _, p, a in known}
    real = collocation.counts
    try:
        collocation.counts = lambda *_: tables
        got = {r.phrase: (r.score, r.l, r.r) for r in collocation.mine(spark.createDataFrame([], "lang string, text string")).collect()}
    finally:
        collocation.counts = real
    cut = lambda p, k: 1000 * f[p] * n // (f[" ".join(p.split()[:k])] * f[" ".join(p.split()[k:])])
    assert {p: s for p, (s, *_) in got.items()} == {p: min(cut(p, k) for k in range(1, len(p.split()))) for p in ("a b", "b c", "a b c")}


def test_memory_of_a_bucket_is_bounded():
    """Far more rows than the memory given are counted, from a stream."""
    schema = pa.schema([("h", pa.int64()), ("m", pa.int64())])
    batches = (pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + 200_000) % 1_500_000), pa.array(np.ones(200_000, np.int64))], schema=schema) for k in range(0, 6_000_000, 200_000))
    old, collocation.MEMORY = collocation.MEMORY, "64MB"
    try:
        got = sum(b.num_rows for b in collocation._counted(pa.RecordBatchReader.from_batches(schema, batches), "SELECT h FROM r GROUP BY h HAVING sum(m) >= 4"))
    finally:
        collocation.MEMORY = old
    assert got == 1_500_000


def test_one_very_long_piece(spark):
    text = "alpha beta gamma " * 300_000
    got = collocation.mine(spark.createDataFrame([("en", text), ("en", "delta. " * 200)], "lang string, text string"))
    assert sorted(map(tuple, got.collect())) == brute([("en", text), ("en", "delta. " * 200)], 100)


def test_pieces_are_cut_and_their_blanks_made_equal():
    raw, at = utf8(pa.array(["Ab  c, d.e\tf \nX", None, "", "y z ", "..", "q"]))
    own, cuts, row, n = collocation.cut(raw, at)
    assert [own[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] == [b"ab c", b"d", b"e f", b"x", b"y z", b"q"]
    assert row.tolist() == [0, 0, 0, 0, 3, 5] and n.tolist() == [2, 1, 2, 1, 2, 1]
