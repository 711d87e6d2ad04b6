import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import arrow_text, token_files
from tidemark.llm.queries import QUERIES

TEXTS = ["plain words, here", None, "", "two  spaces", " lead", "trail ", "a <|endoftext|> b", "x\n\n y", "long " * 3000, "plain words, here"]


def expected(ids_and_texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, out = 0, []
    for doc_id, text in sorted(ids_and_texts, key=lambda x: x[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(97 * i % 101, t) for i, t in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op7_token_files"](spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(rows)


def test_files_have_encodings_and_page_indexes(spark, tmp_path):
    rows = [(i, "some words " * (i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as ids", "1 as n_tokens")
    path = str(tmp_path / "tokens")
    token_files.write(df, path, P.path("byte_bpe_50k.json"), 0)
    files = sorted((tmp_path / "tokens").glob("part-*"))
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for c in range(meta.num_columns):
            column = meta.row_group(0).column(c)
            if column.path_in_schema.startswith("ids"):
                assert "RLE_DICTIONARY" in column.encodings
            else:
                assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index and column.has_offset_index
    table = token_files.read(spark, path)
    plan = table.where("doc_id = 17").select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "EqualTo(doc_id,17)" in plan
    ids = [r.doc_id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert ids == sorted(ids) == list(range(500))


def test_empty_table_and_repeated_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "n")], "doc_id long, text string")
    token_files.write(df, str(tmp_path / "a"), P.path("byte_bpe_50k.json"), 0)
    got = token_files.contract(token_files.read(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 2), (1, 4, 2), (1, 6, 2)]
    token_files.write(df.limit(0), str(tmp_path / "b"), P.path("byte_bpe_50k.json"), 0)
    assert token_files.contract(token_files.read(spark, str(tmp_path / "b"))).count() == 0


def test_many_texts_equal_the_library():
    own = token_files.Encoder(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    g = random.Random(7)
    bits = [" ", "  ", "\n", "\t", "\u00a0", "word", "it's", "it 's", "12", "é", "漢字", "!?", "<|endoftext|>", "\u0378", "\x1c", "a" * 90, "\u2028"]
    texts = ["".join(g.choice(bits) for _ in range(g.randrange(40))) for _ in range(3000)] + [x or "" for x in TEXTS]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    for step in (1, 7, 5000):
        assert [i for r in range(0, len(texts), step) for i in own.encode_all(texts[r : r + step])] == want


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "PIECES", 20)
    monkeypatch.setattr(token_files, "WORDS", 30)
    own = token_files.Encoder(P.path("byte_bpe_50k.json"))
    for i in range(50):
        own.encode(f"some{i} words{i} here " + "x" * 500)
    assert len(own.known) <= 20 and len(own.words) <= 30 and max(map(len, own.known)) <= arrow_text.CACHED_LETTERS


def test_files_beyond_five_digits_go_by_number(spark):
    names = ["part-99999-a.parquet", "part-100000-a.parquet", "part-00001-a.parquet"]
    rows = spark.createDataFrame([(i, 10 ** (2 - i), n, 0) for i, n in enumerate(names)], "doc_id long, n_tokens long, file_name string, row_index long")
    table = rows.select("doc_id", "n_tokens", F.struct("file_name", "row_index").alias("_metadata"))
    assert {r.doc_id: r.start for r in token_files.offsets(table).collect()} == {2: 0, 0: 1, 1: 101}


class Counted:
    """The library's model, and what it was asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, word):
        self.asked.append(word)
        return self.model.tokenize(word)


def test_library_gets_each_distinct_pre_token_once():
    own = token_files.Encoder(P.path("byte_bpe_50k.json"))
    own.model = Counted(own.library.model)
    words, marks = [f"wört{'abcdefghij'[i % 10]}{'äöüßé'[i // 10]}" for i in range(50)], ["***", "###", "!?", "...", "++"]
    for m in marks:
        own.encode_all([" ".join(w + m for w in words[i:] + words[:i]) for i in range(3)])
    assert len(own.model.asked) == len(set(own.model.asked)) == 50 + 3 + len(marks) + 1  # three words also without a blank before them; the placeholder


def test_stretches_of_a_long_text_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "LETTERS", 30)
    own = token_files.Encoder(P.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    g = random.Random(11)
    bits = [" ", "  ", "\n ", "'s", "'re", "'", "''ll", "'LL", "'ve'd", "x", "word", "7", "²", "é", "é", "漢", "🙂", "　", "᠎", "\0", "<|", "<|endoftext|>", "<|endoftext|><|endoftext|>", "!?"]
    texts = ["".join(g.choice(bits) for _ in range(g.randrange(120))) for _ in range(1500)]
    texts += ["".join(f"a{c}b {c}1{c} {c}{c}'s" for c in map(chr, range(i, i + 256)) if not "\ud800" <= c <= "\udfff") for i in range(0, 0x20000, 256)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    ids, n = own.encode_flat(texts, np.array([0], "<u4").tobytes())
    assert ids.tolist() == [i for x in want for i in [*x, 0]] and n.tolist() == [len(x) + 1 for x in want]
