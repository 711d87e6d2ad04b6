import hashlib
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import arrow_text, bpe
from tidemark.llm.queries import QUERIES

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
HARD = [
    "", " ", "  a", "a  b ", "\n a \n", "Hello <|endoftext|> World's 123 <|startoftext|>x<|", "ΑΣ ΣΑΣ İx é ﬁ ½ ² ñ ß",
    "\x1c a\x1fb \x85c d", "🙂🙂 日本語テキスト", "a" * 3000, "!" * 500 + "." * 500, "ab" * 2000, "\x00\x01�",
]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", FILES)
def test_hard_texts_equal_the_library(name):
    own, other = bpe.load(P.path(name)), library(name)
    for text in HARD:
        ids = other.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids, dtype=np.int64)).decode() == other.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_equals_the_library(name, text):
    own, other = bpe.load(P.path(name)), library(name)
    assert own.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_every_code_point_equals_the_library(name):
    """All planes that have letters, unassigned code points among them."""
    own, other = bpe.load(P.path(name)), library(name)
    points = [c for c in range(0x80, 0x32000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = " ".join(f"ab{chr(c)}cd1{chr(c)}!{chr(c)}" for c in points[i : i + 64])
        assert own.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_a_very_long_word_takes_little_memory():
    """A line of 6 MB without a blank, in a process of its own; the library is asked for the same word in short."""
    code = f"""
import resource, random, public_tokenizers as P
from tidemark.llm import bpe
own = bpe.load(P.path("{FILES[0]}"))
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
g = random.Random(1)
word = "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6 << 20))
ids = own.encode(word)
assert own.decode(ids).decode().replace(" ", "").startswith(word[:1000])
print(len(ids), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) >> 10)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n > 1 << 20 and mb < 150


def test_long_words_equal_the_library():
    own, other = bpe.load(P.path(FILES[0])), library(FILES[0])
    g = random.Random(4)
    for letters in ("ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz", "aé漢"):
        word = "".join(g.choice(letters) for _ in range(20_000))
        assert own.encode(word).tolist() == other.encode(word, add_special_tokens=False).ids


def test_new_columns_never_clash(spark):
    df = spark.createDataFrame([(1, "some words", [7], "x")], "doc_id long, text string, IDS array<int>, decoded string")
    out = bpe.encode(df, P.path(FILES[0]), decoded="decoded")
    assert out.columns == ["doc_id", "text", "IDS", "decoded", "ids_", "decoded_"]
    r = out.first()
    assert r.IDS == [7] and r.decoded == "x" and r.decoded_ == library(FILES[0]).decode(r.ids_, skip_special_tokens=False)
    assert bpe.decode(out, P.path(FILES[0]), ids="ids_").columns[-1] == "decoded__"


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(arrow_text, "CACHE", 5)
    own, other = bpe.Bpe(P.path(FILES[0])), library(FILES[0])
    text = " ".join(f"word{i} tion{i}x" for i in range(200))
    assert own.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids
    assert len(own._words) <= 6 and len(own._chunks) <= 6


def test_a_worker_holds_no_words_between_tasks(spark, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    run = bpe.encode(df, P.path(FILES[0]), decoded="decoded")
    texts = [*HARD, None, *(f"word{i} tion{i}x" for i in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    own, other = bpe.load(P.path(FILES[0])), library(FILES[0])
    assert len(own._edges) <= bpe.EDGES
    for _ in range(2):
        got = [r for out in run(iter([batch, batch.slice(0, 0)])) for r in out.to_pylist()]
        assert [r["ids"] for r in got] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert not any(map(len, (own._words, own._chunks, own._fits, own._edges)))
    left = run(iter([batch]))
    next(left)
    left.close()  # a task that needs no more rows ends early
    assert not own._words


def test_ends_of_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "EDGES", 3)
    own, other = bpe.Bpe(P.path(FILES[0])), library(FILES[0])
    g = random.Random(5)
    text = " ".join("".join(g.choice("aeinorstxz") for _ in range(12)) for _ in range(200))
    assert own.encode(text).tolist() == other.encode(text, add_special_tokens=False).ids
    assert 0 < len(own._edges) <= 3


def test_round_trip_in_spark_keeps_other_columns(spark):
    rows = [(1, "some words here", "x", None), (2, None, "y", 3), (2, None, "y", 3), (3, "", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token string, n_tokens int")
    path = P.path(FILES[1])
    back = bpe.decode(bpe.encode(df, path), path).collect()
    assert [(r.doc_id, r.text or "") for r in back] == [(r.doc_id, r.decoded) for r in back]
    assert [r.n_tokens for r in back] == [None, 3, 3, 4]
    at_once = bpe.encode(df, path, decoded="d").collect()
    assert [(r.ids, r.d) for r in at_once] == [(r.ids, r.decoded) for r in back]
    nulls = df.selectExpr("doc_id", "cast(null as array<int>) ids")
    assert {r.decoded for r in bpe.decode(nulls, path).collect()} == {""}
    assert bpe.decode(bpe.encode(df.limit(0), path), path).count() == 0


def test_query_equals_the_library(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD, None])], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    other = library(FILES[0])
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, str(tmp_path)).collect()}
    for i, text in enumerate([*HARD, ""]):
        ids = other.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert pq.read_table(tmp_path / "documents.parquet").num_rows == len(got)
