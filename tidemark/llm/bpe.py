"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the tokens that start at each place of a word. The encoder takes the
longest one whose pair with the token before it is *compatible* (merging would leave the boundary between the two
untouched) and steps back where none fits. Since the encoding of every prefix is unique, a place that once failed fails
for good, so each place is left at most once for each of its tokens, and the result equals that of applying the merges
by rank.

Null texts are empty: no tokens, an empty decoded text. Special tokens are found in the raw text first, as the
tokenizers library does by default. Ties cannot occur; repeated rows are encoded alike; an empty table gives no rows.
A word takes some bytes of memory for each of its letters, so that a very long one is encoded whole. Other columns are
kept by ``encode`` and ``decode`` whatever their names: where a table has a column of the new one's name, the new one
gets an underscore behind it.

Spark keeps Python workers from stage to stage, and two tasks' workers stand beside an executor's heap. So a model is
held in arrays, and what it has learned of a task's words goes when the task ends.

Text beyond the Latin letters is normalized and cut into words by the file's own normalizer and pre-tokenizer, run by
the tokenizers library, so that both have the same Unicode tables; merges are made here.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.arrow_text import give_back, pieces, remember, utf8

#: Cells of the pair table that a worker holds; it is emptied when full.
CELLS = 300_000
#: Ends of tokens that a worker holds while pairs are judged; they are dropped when full.
EDGES = 4096
#: Bytes (or ids) of texts that are worked on at once, about.
PIECE = 2 << 20
_END = 256
_NEVER = 1 << 60
#: str.split() parts at these, the tokenizer's \s does not.
_LOOSE_SPACE = regex.compile(r" (?=\s|$)")
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Letters whose classes and cases have never changed and that are their own normal form.
_LATIN = re.compile("[\x00-\u024f]*")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by its rule: printable Latin-1
    characters stand for themselves, the others get the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class OffsetTable:
    """Token strings in one buffer with their offsets, as an Arrow binary array; a token is read between two offsets."""

    def __init__(self, parts: list[bytes]):
        self.array = pa.array(parts, pa.large_binary())

    def gather(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after another."""
        if not len(ids):
            return b""
        taken = self.array.take(pa.array(ids.astype(np.int32)))
        _, offsets, data = taken.buffers()
        return data.to_pybytes()[: np.frombuffer(offsets, np.int64)[len(ids)]]


class Bpe:
    """A byte-level BPE vocabulary file of the tokenizers library, with or without word ends.

    Known pre-tokenizers: the word split of ``word_bpe`` files (white space removed) and the byte-level one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        kinds = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        self.lower = "Lowercase" in kinds
        # The library's own vocabulary is not asked for anything.
        library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None, "model": model | {"vocab": {}, "merges": []}}))
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        pre = spec["pre_tokenizer"]
        if pre["type"] == "Sequence":
            self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
            self.drops_space = True
        else:
            #: The fixed pattern of the library's byte-level pre-tokenizer.
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            self.drops_space = False
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        strings = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = token

        def symbols(token: str) -> str:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            text = token[: -len(self.suffix)] if ends else token
            codes = [letters[c] for c in text]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + _END) if ends else "".join(map(chr, codes))

        #: The rank of each merge, by ``left * size + right``; the first merge that makes each token, and its two halves.
        self.rank: dict[int, int] = {}
        self.made, *self.halves = (array("i", [-1]) * self.size for _ in range(3))
        for r, (a, b) in enumerate(map(tuple, model["merges"])):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left * self.size + right] = r
            if self.made[whole] < 0:
                self.made[whole], self.halves[0][whole], self.halves[1][whole] = r, left, right
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        of: dict[str, int] = {}
        for token, i in vocab.items():
            if self.made[i] < 0 or self._apart(self.halves[0][i], self.halves[1][i], self.made[i]):
                of[symbols(token)] = i
        #: Letters of each token, and the longest token that it begins with.
        self.length, self.shorter = [0] * self.size, [-1] * self.size
        for s, i in of.items():
            self.automaton.add_word(s, i)
            self.length[i] = len(s)
            self.shorter[i] = next((of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in of), -1)
        self.automaton.make_automaton()
        self._words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self.decimal = OffsetTable([b"%d " % i for i in range(self.size)])
        if self.drops_space:
            self.table = OffsetTable([s.encode() + b" " for s in strings])
        else:
            special = {i: s for s, i in self.special.items()}
            self.table = OffsetTable([special[i].encode() if i in special else bytes(letters[c] for c in s) for i, s in enumerate(strings)])
        self.forget()

    def forget(self) -> None:
        """Drop all that was learned from texts."""
        for known in (self._words, self._chunks, self._fits, self._edges):
            known.clear()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at the right (side 1) or left (side 0) end of a token while it is merged, each with the rank of
        the merge that takes it up."""
        out = self._edges.get((token, side))
        if out is None:
            out, part = [(token, _NEVER)], token
            while (rank := self.made[part]) >= 0:
                part = self.halves[side][part]
                out.append((part, rank))
            out.reverse()
            if len(self._edges) >= EDGES:
                self._edges.clear()
            self._edges[token, side] = out
        return out

    def _apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """No merge of a rank below ``until`` joins the end of ``a`` with the start of ``b``."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = left[i], right[j]
            r = self.rank.get(x * self.size + y)
            if r is not None and r < until and r < x_gone and r <= y_gone:
                return False
            if x_gone == y_gone == _NEVER:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """One cell of the pair table, filled when first asked for."""
        cell = a * self.size + b
        fits = self._fits.get(cell)
        if fits is None:
            if len(self._fits) > CELLS:
                self._fits.clear()
            fits = self._fits[cell] = self._apart(a, b)
        return fits

    def encode_symbols(self, s: str) -> array:
        n, length, shorter, size, cell = len(s), self.length, self.shorter, self.size, self._fits.get
        longest, dead = array("i", [-1]) * n, bytearray(n + 1)
        for last, token in self.automaton.iter(s):
            longest[last - length[token] + 1] = token  # a longer one ends later
        tokens = array("I")
        at, token, before = 0, longest[0], -1
        while True:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if before < 0:
                        break
                    fits = cell(before * size + token)
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, before = end, token
                if at == n:
                    return tokens
                token = longest[at]
            else:
                dead[at] = 1
                token = tokens.pop()
                at -= length[token]
                before = tokens[-1] if tokens else -1
                token = shorter[token]

    def _word(self, word: str) -> bytes:
        out = self._words.get(word)
        if out is None:
            s = word.encode("utf-8").decode("latin-1")
            if self.suffix:
                s = s[:-1] + chr(ord(s[-1]) + _END)
            out = self.encode_symbols(s).tobytes()
            remember(self._words, {word: out})
        return out

    def _chunk(self, chunk: str) -> bytes:
        """A part of a text that no pre-token crosses."""
        out = self._chunks.get(chunk)
        if out is None:
            if chunk.isascii() or _LATIN.fullmatch(chunk):
                found = self.pattern.findall(chunk.lower() if self.lower else chunk)
            else:
                text = self.normalizer.normalize_str(chunk) if self.normalizer else chunk
                found = [text[i:j] for _, (i, j) in self.cutter.pre_tokenize_str(text)]
            out = b"".join(map(self._word, found))
            remember(self._chunks, {chunk: out})
        return out

    def _plain(self, text: str) -> bytes:
        if self.drops_space:
            if _SEPARATORS.search(text):
                return b"".join(map(self._chunk, regex.split(r"\s+", text)))
            get, chunk = self._chunks.get, self._chunk
            return b"".join([get(c) or chunk(c) for c in text.split()])
        if _LOOSE_SPACE.search(text):
            return self._chunk(text)
        # No pre-token crosses the place before a space that a visible character follows.
        first, *rest = text.split(" ")
        get, spaced = self._chunks.get, self._spaced
        return (self._chunk(first) if first else b"") + b"".join([get(" " + p) or spaced(p) for p in rest])

    def _spaced(self, part: str) -> bytes:
        return self._chunk(" " + part)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without added special tokens."""
        if "<|" in text and any(s in text for s in self.special):
            parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
            raw = b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in parts if p)
        else:
            raw = self._plain(text)
        return np.frombuffer(raw, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text, special tokens kept. A vocabulary without a decoder joins tokens by spaces."""
        raw = self.table.gather(ids)
        if self.drops_space:
            return raw[:-1]
        return raw.decode("utf-8", "replace").encode()

    def decimals(self, ids: np.ndarray) -> bytes:
        return self.decimal.gather(ids)[:-1]


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores as no column of the table has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One model for each Python worker and path."""
    return Bpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns of ``df``, the token ids of its text, and, if named, the text that these decode to.

    Rows go through in pieces of bounded bytes, so a worker's memory does not follow the batches' sizes.
    """
    place = df.columns.index(text)
    names = [free_name(df.columns, n) for n in (ids, decoded) if n]
    more = [T.StructField(n, t) for n, t in zip(names, (T.ArrayType(T.IntegerType(), False), T.StringType()), strict=False)]
    schema = T.StructType([*df.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage left
        model = load(path)
        b = part = None
        try:
            for b in batches:
                for r0, r1 in pieces(*utf8(b.column(place)), PIECE):
                    part = b.slice(r0, r1 - r0)
                    got = [model.encode(t.as_py() or "") for t in part.column(place)]
                    at = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
                    own = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(got).view(np.int32)))]
                    if decoded:
                        own.append(pa.array([model.decode(g).decode() for g in got], pa.string()))
                    yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[f.name for f in schema.fields])
                    del got, own
                    give_back()
        finally:
            b = part = None
            model.forget()
            give_back()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of its token ids; null ids give an empty text."""
    place = df.columns.index(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(free_name(df.columns, text), T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            lists = b.column(place).fill_null([])
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            for r0, r1 in pieces(flat, at - at[0], PIECE):
                got = [model.decode(flat[at[r] : at[r + 1]]).decode() for r in range(r0, r1)]
                yield pa.RecordBatch.from_arrays([*b.slice(r0, r1 - r0).columns, pa.array(got, pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
