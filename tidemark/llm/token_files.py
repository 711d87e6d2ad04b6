"""Token ids as Parquet list columns, and selective reads of them.

A table of token files holds one row for each document in ascending order of its key, over files in that order:
``doc_id`` and ``n_tokens`` (delta encoded under the version 2 writer), and ``ids`` (a list, dictionary encoded). Row
groups and pages have set sizes and every page has an index entry, so that ids of few documents or the metadata alone
can be read without the rest. Every document ends with the end id, so an empty or null text has one token.
Repeated keys keep all their rows, in the order of a hash of their texts; an empty table gives no files' rows; a very long text is
one row. Only the key and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.arrow_text import give_back, pieces, remember, utf8
from tidemark.llm.bpe import byte_letters

#: Text of a file, about; letters that are encoded at once, about.
FILE_BYTES, LETTERS = 64 << 20, 1 << 20
#: Pre-tokens that a worker remembers: those met in more than one group of texts, and those met in one (some 150 MB).
PIECES, WORDS = 500_000, 250_000
SCHEMA = "doc_id long, n_tokens long, ids array<int>"

#: Classes of code points in the byte-level pattern (0: not asked for yet), and the place where a stretch of text ends.
_LETTER, _DIGIT, _OTHER, _SPACE, _STOP = 1, 2, 3, 4, 5
#: A long text is cut here: no pre-token crosses the place before a blank between visible characters.
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Encoder:
    """A byte-level BPE file, run by the tokenizers library over pre-tokens.

    Many texts are cut into the pre-tokens of the byte-level pattern at once, as arrays; the library says of which class
    a code point is. It encodes each distinct pre-token once for as long as it is remembered. Special tokens in a text
    become their ids, as the library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"], spec["added_tokens"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("not a plain byte-level file")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        #: The longest special token wins, as in the library.
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self._tails = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self._class = np.zeros(0x110000, np.uint8)
        letters = byte_letters()
        self._letters = np.array([ord(c) for c in sorted(letters, key=letters.get)], "<u4")
        #: Ids of pre-tokens (as UTF-8): those met again after they were new, and new ones.
        self.known: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        """The class of each code point: letters and digits make one pre-token with their like, white space with nothing visible."""
        out = self._class[codes]
        if not out.all():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(codes[out == 0]).tolist():
                self._class[c] = next((k for k, like in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")) if len(cut(like + chr(c))) == 1), _SPACE)
            out = self._class[codes]
        return out

    def _stretches(self, texts: list[str], end: bytes) -> Iterator[tuple[int, str, bytes]]:
        """Row, text and the ids behind it, of stretches that no pre-token crosses."""
        for row, text in enumerate(texts):
            parts = self._special.split(text) if self._special else [text]
            for part, name in zip(parts[::2], [*parts[1::2], None], strict=True):
                at = 0
                while len(part) - at > 2 * LETTERS and (m := _CUT.search(part, at + LETTERS)):
                    yield row, part[at : m.start()], b""
                    at = m.start()
                yield row, part[at:], end if name is None else self._tails[name]

    def _starts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in stretches that end with a placeholder each, which is one by itself:
        ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
        kind = self._classes(codes)
        kind[ends] = _STOP
        start = np.ones(len(kind), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[ends] = True
        start[ends[:-1] + 1] = True
        # White space leaves its last character to what follows; a blank joins it.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _STOP))
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        q = np.flatnonzero(codes == 39)
        q = q[start[q]]
        q = q[kind[q + 1] == _LETTER]
        one, two = codes[q + 1], codes[q + 2]
        short, long = np.isin(one, [*b"stmd"]), (np.isin(one, [*b"rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[q[short | long] + 1] = False
        start[q[short] + 2] = True
        start[q[long] + 3] = True
        return np.flatnonzero(start)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens by the library's model, which takes a letter for each byte; no UTF-8 text has the byte 255."""
        letters = self._letters[np.frombuffer(b"\xff".join(words), np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in letters.split("\xff")] if words else []

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens; the library gets the new ones."""
        got = [*map(self.known.get, words)]
        gaps = [i for i, x in enumerate(got) if x is None]
        again, fresh = {}, {}
        for i in gaps:
            if (x := self.words.get(words[i])) is not None:
                got[i] = again[words[i]] = x
        gaps = [i for i in gaps if got[i] is None]
        for i, x in zip(gaps, self._encode([words[i] for i in gaps]), strict=True):
            got[i] = fresh[words[i]] = x
        for w in again:
            del self.words[w]
        remember(self.known, again, PIECES)
        remember(self.words, fresh, WORDS)
        return got

    def _group(self, texts: list[str], tails: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches one after another, and how many each has."""
        joined = "\0".join([*texts, ""])
        raw = joined.encode()
        codes = np.frombuffer(raw, np.uint8) if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        start = self._starts(codes, ends)
        stops = np.searchsorted(start, ends)
        if len(raw) > len(joined):
            start = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[start]
        at = np.append(start, len(raw))
        cut = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        which = cut.indices.to_numpy().astype(np.int64)
        own = {t: i for i, t in enumerate(dict.fromkeys(tails), len(cut.dictionary))}
        which[stops] = [own[t] for t in tails]
        ids = [*self._ids(cut.dictionary.to_pylist()), *own]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        total = np.cumsum(n)
        out = flat[np.repeat(first[which] - (total - n), n) + np.arange(total[-1])]
        return out, np.diff(total[stops], prepend=0)

    def encode_flat(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, those of ``end`` behind each, and how many each text has."""
        counts, out = np.zeros(len(texts), np.int64), [np.zeros(0, "<u4")]
        group: list[tuple[int, str, bytes]] = []
        letters = 0

        def done() -> None:
            rows, parts, tails = map(list, zip(*group, strict=True))
            ids, n = self._group(parts, tails)
            np.add.at(counts, rows, n)
            out.append(ids)
            group.clear()

        for stretch in self._stretches(texts, end):
            group.append(stretch)
            letters += len(stretch[1])
            if letters >= LETTERS:
                done()
                letters = 0
        if group:
            done()
        return np.concatenate(out), counts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, n = self.encode_flat(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def _cached(path: str) -> Encoder:
    return Encoder(path)


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode all rows and write their token files to ``path``, in ascending order of the key over all files."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _cached(tokenizer)
        for b in batches:
            for row, last in pieces(*utf8(b.column(1)), LETTERS):
                ids, n = encoder.encode_flat([t or "" for t in b.column(1).slice(row, last - row).to_pylist()], end)
                at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, last - row), pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])
            give_back()

    # The files' number follows the text; a repeated key is cut by hashes of its texts.
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    rows = df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text")).withColumn("_h", F.xxhash64("text"))
    (
        rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text").mapInArrow(run, SCHEMA)
        .write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary#ids.list.element", "true").option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
        .option("compression", "zstd").parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files; select columns to read no others, filter ``doc_id`` to skip row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def offsets(table: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``file``, ``row_index`` and ``start``, the number of ids of all rows before; from
    metadata columns only. Files are summed one by one, then rows within each file, so no task sees all rows."""
    rows = table.select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # A part's number has five digits at least: names order as their numbers only after they are read as numbers.
    before = Window.orderBy(F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select("doc_id", "n_tokens", "file", "row_index", (F.col("file_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def digests(table: DataFrame) -> DataFrame:
    """``file``, ``row_index`` and ``ids_crc32``, the unsigned CRC-32 of a row's ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], names=["file", "row_index", "ids_crc32"])

    rows = table.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"), "ids")
    return rows.mapInArrow(run, "file string, row_index long, ids_crc32 long")


def contract(table: DataFrame) -> DataFrame:
    """Start, length and digest of every document of token files."""
    return offsets(table).join(digests(table), ["file", "row_index"]).select("doc_id", "start", "n_tokens", "ids_crc32")
