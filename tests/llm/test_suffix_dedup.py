import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix, suffix_dedup
from tidemark.llm.queries import QUERIES

TOP = 1 << 63


def brute(docs, length=50):
    least = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            least[s] = min(least.get(s, TOP), TOP - 1 if d is None else d)
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < (TOP - 1 if d is None else d):
                gone[i : i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array_and_prefixes_equal_sorting():
    g = np.random.default_rng(0)
    for _ in range(200):
        n, k = int(g.integers(1, 70)), int(g.integers(1, 5))
        t = np.append(g.integers(1, k + 1, n), 0).astype(np.uint16)
        sa = suffix.suffix_array(t, k + 1)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
        common = suffix.common_prefixes(t, sa, 20)
        for i, j in zip(sa[1:], sa[:-1], strict=True):
            m = 0
            while max(i, j) + m <= n and t[i + m] == t[j + m]:
                m += 1
            assert common[i] == min(m, 20)


def test_suffix_array_with_many_names():
    g = np.random.default_rng(1)
    t = np.append(g.integers(1, 200, 60000), 0).astype(np.uint16)
    t[30000:45000] = t[:15000]
    sa = suffix.suffix_array(t, 200)
    raw = t.astype(">u2").tobytes()
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[2 * i :])


@pytest.fixture(scope="module")
def docs():
    g = random.Random(3)
    syllables = ["er", "en", "ö", "tion", "a ", "the ", "ß", ".\n", "in", "re"]
    text = lambda n: "".join(g.choice(syllables) for _ in range(n))
    passages = [text(g.randint(20, 60)) for _ in range(6)]
    out = [(i, text(g.randint(0, 80))) for i in range(40)]
    for i in range(40, 120):
        body = text(g.randint(0, 30)) + g.choice(passages) + text(g.randint(0, 9)) + g.choice(passages)[g.randint(0, 5) :] + text(g.randint(0, 20))
        out.append((i * 37 % 1000, body))
    out += [(1000 + i, out[50][1]) for i in range(20)] + [(2000 + i, "Der " * g.randint(5, 60)) for i in range(8)]
    out += [(3000 + i, out[60][1][:i] + "x" + out[60][1][i:]) for i in range(0, 60, 3)]
    out += [(5000, None), (5001, ""), (5002, "x" * 49), (5003, "x" * 50), (5004, "x" * 51), (5005, out[61][1] * 40), (None, out[62][1]), (5006, out[63][1]), (5006, out[63][1]), (5007, "\x00" * 80), (4999, "\x00" * 60)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_query_equals_brute_force(spark, tmp_path, docs, small, monkeypatch):
    if small:
        monkeypatch.setattr(suffix_dedup, "LEAST_PARTS", 3)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["op6_suffix_dedup"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(docs)


def test_clean_keeps_columns_that_clash(spark):
    text = "é" * 40 + " tail that is long enough to be a passage of its own, or so"
    rows = [(1, text, 5), (2, "ab " + text, 6), (3, None, 7), (4, "short", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").selectExpr("n_bytes as kept", "doc_id", "text", "n_bytes", "n_bytes as c0")
    got = {r.doc_id: r for r in suffix_dedup.clean(df).collect()}
    assert suffix_dedup.clean(df).columns == df.columns
    assert [got[i].text for i in (1, 2, 3, 4)] == [text, "ab ", None, "short"] and got[2].kept == 6
    assert suffix_dedup.clean(df.limit(0)).count() == 0


def test_clean_takes_whole_characters(spark):
    """The repeated string begins and ends inside a character; what stays is text, and its own U+FFFD stays."""
    common = "é" * 24 + "x"
    rows = [(1, "ê"[:1] + common + "é"), (2, "é" + common + "ù\ufffd")]
    got = {r.doc_id: r.text for r in suffix_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    raw = [t.encode() for _, t in rows]
    gone = {x for j in range(len(raw[1]) - 49) if raw[1][j : j + 50] in raw[0] for x in range(j, j + 50)}
    at, want = 0, ""
    for c in rows[1][1]:
        n = len(c.encode())
        want += "" if gone & set(range(at, at + n)) else c
        at += n
    assert got == {1: rows[0][1], 2: want} and want.endswith("\ufffd") and max(gone) == len(raw[1]) - 5


def _kernel(docs, parts=4, buckets=5, shards=7):
    """Removed bytes by document, and what buckets and shards were sent."""
    import pyarrow as pa

    rows_of = [docs[p::parts] for p in range(parts)]

    def part(p, turned):
        rows = rows_of[p][::-1] if turned else rows_of[p]
        ids, texts = pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())
        return suffix_dedup.Part(pa.chunked_array([ids]), pa.chunked_array([texts])), rows

    pick = lambda t, v: t.filter(pa.compute.equal(t["to"], v))
    sent = pa.concat_tables([suffix_dedup._send(p, part(p, False)[0], buckets) for p in range(parts)])
    judged = pa.concat_tables([suffix_dedup._judge(pick(sent, b)) for b in set(sent["to"].to_pylist())])
    # Rows of a part may come in another order when it is read again.
    asked = pa.concat_tables([suffix_dedup._ask(p, part(p, True)[0], pick(judged, p), buckets, shards) for p in range(parts)])
    told = pa.concat_tables([judged, *[suffix_dedup._sort(pick(asked, b)) for b in set(asked["to"].to_pylist())]])
    gone = {}
    for p in range(parts):
        w, rows = part(p, False)
        mask = suffix_dedup._removed(w, pick(told, p), buckets, shards)
        for i, (d, _) in enumerate(rows):
            gone.setdefault(d, []).append(int(mask[w.at[i] : w.at[i + 1]].sum()))
    return {d: sorted(n) for d, n in gone.items()}, sent, asked


def _wanted(docs):
    out = {}
    for d, _, n, _, _ in brute(docs):
        out.setdefault(d, []).append(n)
    return {d: sorted(n) for d, n in out.items()}


@pytest.mark.parametrize("array", [1 << 20, 400, 1])
def test_kernel_with_tiny_arrays(docs, monkeypatch, array):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array)
    some = [d for d in docs if d[0] is not None]
    assert _kernel(some)[0] == _wanted(some)


def test_equal_hashes_remove_nothing(docs, monkeypatch):
    """Where all letters hash alike, every string has the same anchor, and bytes alone tell strings apart."""
    monkeypatch.setattr(suffix_dedup, "_LETTER", np.full(256, 7, np.uint64))
    some = [d for d in docs if d[0] is not None]
    for array in (1 << 30, 1):
        monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array)
        assert _kernel(some)[0] == _wanted(some)


@pytest.mark.parametrize("array", [1 << 20, 4000, 300])
def test_a_large_anchor_is_split(monkeypatch, array):
    """One passage between texts that differ in each document: its edges have as many windows as there are documents."""
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array)
    longest = []
    sort = suffix_dedup._least_of_strings
    monkeypatch.setattr(suffix_dedup, "_least_of_strings", lambda raw, length, doc: longest.append(int((length + 1).sum())) or sort(raw, length, doc))
    g = random.Random(5)
    text = lambda n: "".join(g.choice("abcdefgh ") for _ in range(n))
    passage, ends = text(120), [text(60) for _ in range(3)]
    docs = [(i * 7919 % 1000, text(g.randint(20, 60)) + passage + (g.choice(ends)[: g.randint(5, 60)] if i % 3 else "") + text(30)) for i in range(300)]
    gone, sent, asked = _kernel(docs)
    assert gone == _wanted(docs)
    assert max(longest, default=0) <= array + 77
    # A bucket has one entry for each part that has an anchor.
    h = np.concatenate([np.cumsum(suffix_dedup._columns(d, 2)[0], dtype=np.uint64) for d in sent["data"].to_pylist()])
    assert np.unique(h, return_counts=True)[1].max() <= 4


def test_long_texts_go_in_spans(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPAN", 200)
    g = random.Random(9)
    body = "".join(g.choice("abcdefghijklmnop ") for _ in range(9000))
    docs = [(5, body), (3, body[4000:4300]), (7, "x" * 30 + body[100:900]), (9, body), (1, body[8990:]), (2, "q" * 5000), (4, "q" * 700)]
    assert _kernel(docs, parts=2)[0] == _wanted(docs)


def test_windows_of_a_text_of_several_mb():
    """A text beyond every block: each string that occurs twice is found, against a brute force by hash."""
    g = np.random.default_rng(4)
    raw = g.integers(97, 123, 5 << 20).astype(np.uint8)
    raw[3_000_000:3_400_000] = raw[100_000:500_000]
    raw[[2_999_999, 3_400_000]] = 48
    text = raw.tobytes().decode()
    gone, _, _ = _kernel([(1, text[:2_500_000]), (2, text[2_500_000:])], parts=2)
    assert gone == {1: [0], 2: [400_000]}


def test_recursion_is_never_left(monkeypatch):
    """On two MB of windows the reduced strings have far more names than a byte has, and are sorted the same way."""
    sizes = []
    real = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda t, letters: sizes.append((len(t), letters)) or real(t, letters))
    g = np.random.default_rng(2)
    words_ = [bytes(g.integers(97, 123, int(n)).astype(np.uint8)) + b" " for n in g.integers(2, 9, 3000)]
    raw = b"".join(words_[i] for i in g.zipf(1.3, 600_000) % 3000)[: 2 << 20]
    half = len(raw) // 2
    raw = raw[:half] + raw[: 1 << 19] + raw[half:]
    t = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16), 0)
    sa = suffix.suffix_array(t, 256)
    assert len(sizes) >= 3 and max(k for _, k in sizes) > 4096
    assert sizes[1][0] <= len(t) // 2 and np.array_equal(np.sort(sa), np.arange(len(t)))
    for i in g.integers(0, len(sa) - 1, 3000).tolist():
        assert raw[sa[i] :] < raw[sa[i + 1] :]
