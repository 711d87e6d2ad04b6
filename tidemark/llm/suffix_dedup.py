"""Exact substring deduplication by suffix arrays over shards of windows.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Each such
string has an anchor, the rightmost least hash of its grams of ``GRAM`` bytes, so equal strings have equal anchors. The
starts of a document fall into runs with one anchor; a run's bytes are its window (at most 76 bytes). Then

1. parts of the documents send the hash of each of their anchors once to a bucket of anchors, with the size of its
   windows;
2. a bucket tells the parts which of their anchors occur in another document as well (the others' strings are single);
3. the parts send these anchors' windows to shards: each distinct window of a part once, with its least document id;
4. a shard sorts all suffixes of its windows by induced sorting, and computes permuted common prefixes: suffixes in a
   row with LENGTH bytes in common are one string; a part is told which of its strings have a smaller id elsewhere;
5. the parts remove what starts in a smaller document.

Hashes only say where windows meet: whether strings are equal is decided by their bytes. An anchor with more windows
than a shard takes (both edges of a passage that many documents share have one) is split: its strings of LENGTH bytes
are dealt one by one by their own hash, each distinct string of a part once. So no shard holds a whole large anchor.

Texts move once (all steps read one exchange), a task holds one part, bucket or shard, and these grow in number, not in
size; a text longer than a part is a part, and is worked on in spans.

Null texts are empty; a null id counts as greater than all others; rows with one id are one document and do not remove
each other's bytes; texts shorter than LENGTH lose nothing; an empty table gives no rows; other columns are kept
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import mix, pieces, trim, utf8
from tidemark.llm.suffix import common_prefixes, suffix_array

LENGTH, GRAM = 50, 24
_GRAMS = LENGTH - GRAM + 1
#: Bytes of text in a part, of the texts whose anchors share a bucket, of those whose windows share a shard, and of the
#: windows in one suffix array, about; the least number of parts, buckets and shards.
PART_BYTES, BUCKET_BYTES, SHARD_BYTES, ARRAY_BYTES, LEAST_PARTS = 3 << 20, 12 << 20, 3 << 20, 1 << 20, 32
#: Starts of a long text that are worked on at once.
SPAN = 1 << 18
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x9E3779B185EBCA87)]
_NO_DOC = np.iinfo(np.int64).max
#: Factors of a string's hash, by place.
_PLACES = mix(np.arange(1, LENGTH + 1, dtype=np.uint64) * _ODD[1]) | np.uint64(1)
#: What a bucket says of an anchor: its strings are single, its windows are wanted, or its strings one by one.
_SINGLE, _WINDOWS, _STRINGS = range(3)


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of starts with one anchor: row, first start, last start, and the anchor's hash (48 bits)."""
    empty = np.zeros(0, np.int64)
    n = len(raw)
    if n < LENGTH:
        return empty, empty, empty, empty.astype(np.uint64)
    one = _LETTER[raw]
    two = one[:-1] * _ODD[0] + one[1:]
    del one
    four = two[:-2] * _ODD[1] + two[2:]
    eight = four[:-4] * _ODD[2] + four[4:]
    sixteen = eight[:-8] * _ODD[3] + eight[8:]
    g = mix(sixteen[: n - GRAM + 1] * _ODD[4] + eight[16 : n - GRAM + 17])
    del two, four, eight, sixteen
    least, width = g, 1
    while width * 2 <= _GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := _GRAMS - width:
        least = np.minimum(least[:-rest], least[rest:])
    starts = len(least)
    long_rows = np.flatnonzero(np.diff(at) >= LENGTH)
    first, last = at[long_rows], at[long_rows + 1] - LENGTH
    valid = np.zeros(starts + 1, np.int8)
    valid[first] += 1
    valid[last + 1] -= 1
    newest = g[_GRAMS - 1 :] == least
    event = newest.copy()
    event[1:] |= least[1:] > least[:-1]
    event[first] = True
    event &= np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    begin = np.flatnonzero(event)
    row = np.searchsorted(at, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], n) - 1, at[row + 1] - LENGTH)
    # Least hashes crowd at the small numbers; mixed again, they are dealt evenly.
    return row, begin, end, mix(least[begin]) >> np.uint64(16)


def _spans(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first byte and offsets of stretches of bounded size; those of a long text overlap, so that every
    string of LENGTH bytes begins in one of them."""
    for r0, r1 in pieces(raw, at, SPAN):
        begin, end = int(at[r0]), int(at[r1])
        if end - begin <= 2 * SPAN:
            yield r0, begin, at[r0 : r1 + 1] - begin
        else:
            for x in range(begin, end, SPAN):
                yield r0, x, np.array([0, min(SPAN + LENGTH - 1, end - x)])


class Part:
    """The windows of a part's documents."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray):
        self.raw, self.at = utf8(texts)
        self.doc = ids.combine_chunks().fill_null(_NO_DOC).to_numpy(zero_copy_only=False)
        found = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0, np.uint64)]]
        for r0, x, cut in _spans(self.raw, self.at):
            row, begin, end, h = windows(self.raw[x : x + cut[-1]], cut)
            for all_, new in zip(found, (row + r0, begin + x, end + x, h), strict=True):
                all_.append(new)
        row, self.begin, self.end, h = map(np.concatenate, found)
        self.owner = self.doc[row]
        order = np.argsort(h, kind="stable")
        self.begin, self.end, self.owner, self.h = self.begin[order], self.end[order], self.owner[order], h[order]
        #: The windows are ordered by anchor; the first window of each anchor, and the end.
        self.first = np.append(np.flatnonzero(np.append(True, self.h[1:] != self.h[:-1])), len(h)) if len(h) else np.zeros(1, np.int64)
        self.anchor = self.h[self.first[:-1]]

    def sizes(self) -> np.ndarray:
        """Of each anchor, twice the bytes of its windows, and one more if it occurs in two documents."""
        if not len(self.anchor):
            return np.zeros(0, np.uint64)
        total = np.add.reduceat(self.end - self.begin + LENGTH, self.first[:-1])
        least, most = (f.reduceat(self.owner, self.first[:-1]) for f in (np.minimum, np.maximum))
        return (2 * total + (least < most)).astype(np.uint64)

    def items(self, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """What goes to the shards, in the order of its hash: hash, least id and bytes of each distinct window (or
        string); then the item, first start and owner of each window (string) of the part."""
        count = np.diff(self.first)
        whole = np.flatnonzero(np.repeat(said == _WINDOWS, count))
        split = np.flatnonzero(np.repeat(said == _STRINGS, count))
        n = self.end[split] - self.begin[split] + 1
        strings = np.repeat(self.begin[split] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        begin = np.concatenate([self.begin[whole], strings])
        end = np.concatenate([self.end[whole] + LENGTH, strings + LENGTH])
        owner = np.concatenate([self.owner[whole], np.repeat(self.owner[split], n)])
        data = self.raw.tobytes()
        known: dict[bytes, int] = {}
        of = np.fromiter((known.setdefault(data[x:y], len(known)) for x, y in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
        texts = list(known)
        least = np.full(len(texts), _NO_DOC)
        np.minimum.at(least, of, owner)
        h = np.zeros(len(texts), np.uint64)
        h[of[: len(whole)]] = self.h[whole]
        if len(split):
            ones = np.unique(of[len(whole) :])
            for i in range(0, len(ones), 1 << 13):
                some = ones[i : i + (1 << 13)]
                letters = _LETTER[np.frombuffer(b"".join([texts[j] for j in some.tolist()]), np.uint8).reshape(-1, LENGTH)]
                h[some] = mix((letters * _PLACES).sum(axis=1, dtype=np.uint64)) >> np.uint64(16)
        # Recomputed in any order of the part's rows, the items come in the same order.
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)
        order = order[np.argsort(h[order], kind="stable")]
        place = np.empty(len(texts), np.int64)
        place[order] = np.arange(len(texts))
        return h[order], least[order], [texts[i] for i in order.tolist()], place[of], begin, owner


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, byte plane by byte plane, which compresses well where high bytes repeat."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _columns(data: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(p.T).reshape(-1).view(np.uint64) for p in planes]


def _steps(h: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(h, prepend=np.uint64(0))


def _deal(h: np.ndarray, places: int) -> np.ndarray:
    """The place of each hash; ascending as the hashes are."""
    return ((h >> np.uint64(16)) * np.uint64(places)) >> np.uint64(32)


def _cuts(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal keys."""
    if len(key):
        where = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        yield from zip(key[where].tolist(), where.tolist(), np.append(where[1:], len(key)).tolist(), strict=True)


_SENT = (["to", "sender", "kind", "data", "bytes"], [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])
_SENT_SQL = "to int, sender int, kind int, data binary, bytes binary"


def _table(rows: list[tuple]) -> pa.Table:
    names, types = _SENT
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _send(part: int, own: Part, buckets: int) -> pa.Table:
    """A part's anchors and their sizes to the buckets."""
    size = own.sizes()
    return _table([(b, part, 0, _planes(_steps(own.anchor[i:j]), size[i:j]), b"") for b, i, j in _cuts(_deal(own.anchor, buckets))])


def _judge(t: pa.Table) -> pa.Table:
    """In a bucket: what is said of each part's anchors, in the parts' order (kind 0)."""
    got = [_columns(d, 2) for d in t["data"].to_pylist()]
    count = [len(g[0]) for g in got]
    h = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    size = np.concatenate([g[1] for g in got])
    del got
    order = np.argsort(h, kind="stable")
    h, size = h[order], size[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    n = np.diff(np.append(first, len(h)))
    shared = (n > 1) | (np.bitwise_or.reduceat(size, first) & np.uint64(1)).astype(bool)
    large = np.add.reduceat(size >> np.uint64(1), first) > ARRAY_BYTES
    said = np.empty(len(h), np.uint8)
    said[order] = np.repeat(np.where(shared, np.where(large, _STRINGS, _WINDOWS), _SINGLE).astype(np.uint8), n)
    rows = []
    for to, sender, i, j in zip(t["sender"].to_pylist(), t["to"].to_pylist(), np.cumsum([0, *count[:-1]]), np.cumsum(count), strict=True):
        if said[i:j].any():
            rows.append((to, sender, 0, said[i:j].tobytes(), b""))
    return _table(rows)


def _of_kind(t: pa.Table, kind: int) -> dict[int, bytes]:
    some = t.filter(pa.compute.equal(t["kind"], kind))
    return dict(zip(some["sender"].to_pylist(), some["data"].to_pylist(), strict=True))


def _said(own: Part, told: pa.Table, buckets: int) -> np.ndarray:
    """What the buckets say of each anchor of a part."""
    said = np.zeros(len(own.anchor), np.uint8)
    answers = _of_kind(told, 0)
    for b, i, j in _cuts(_deal(own.anchor, buckets)):
        if b in answers:
            said[i:j] = np.frombuffer(answers[b], np.uint8)
    return said


def _ask(part: int, own: Part, told: pa.Table, buckets: int, shards: int) -> pa.Table:
    """The part's windows and strings to the shards."""
    h, least, texts, _, _, _ = own.items(_said(own, told, buckets))
    rows = []
    for s, i, j in _cuts(_deal(h, shards)):
        size = np.fromiter(map(len, texts[i:j]), np.uint64, j - i)
        rows.append((s, part, 1, _planes(_steps(h[i:j]), least[i:j].view(np.uint64), size), b"".join(texts[i:j])))
    return _table(rows)


def _sort(t: pa.Table) -> pa.Table:
    """In a shard: for each window of each part, a bit for each start whose LENGTH bytes have a smaller id (kind 1)."""
    got = [_columns(d, 3) for d in t["data"].to_pylist()]
    count = [len(g[0]) for g in got]
    h = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    doc = np.concatenate([g[1] for g in got]).view(np.int64)
    size = np.concatenate([g[2] for g in got]).astype(np.int64)
    del got
    data = b"".join(t["bytes"].to_pylist())
    begin = np.cumsum(size) - size
    order = np.argsort(h, kind="stable")
    anchors = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    reach = np.cumsum(size[order] + 1)
    ends = np.append(anchors[1:], len(h))
    mask = np.zeros(len(h), np.uint32)
    a = 0
    while a < len(anchors):
        # Whole anchors, with about ARRAY_BYTES of windows; a larger one came as single strings.
        i = int(anchors[a])
        b = max(a + 1, int(np.searchsorted(reach[ends - 1], (reach[i - 1] if i else 0) + ARRAY_BYTES, "right")))
        some = order[i : int(ends[b - 1])]
        mask[some] = _smaller(data, begin[some], size[some], doc[some])
        a = b
    rows = []
    for to, sender, i, j in zip(t["sender"].to_pylist(), t["to"].to_pylist(), np.cumsum([0, *count[:-1]]), np.cumsum(count), strict=True):
        if mask[i:j].any():
            rows.append((to, sender, 1, mask[i:j].tobytes(), b""))
    return _table(rows)


def _smaller(data: bytes, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits of the starts of each window whose string also stands in a window with a smaller id."""
    known: dict[bytes, int] = {}
    of = np.fromiter((known.setdefault(data[x : x + n], len(known)) for x, n in zip(begin.tolist(), size.tolist(), strict=True)), np.int64, len(begin))
    least = np.full(len(known), _NO_DOC)
    np.minimum.at(least, of, doc)
    length = np.fromiter(map(len, known), np.int64, len(known))
    told = _least_of_strings(np.frombuffer(b"".join(known), np.uint8), length, least)
    n = length - LENGTH + 1
    step = np.arange(_GRAMS)
    out = np.zeros(len(begin), np.uint32)
    for i in range(0, len(begin), 1 << 14):
        own = of[i : i + (1 << 14)]
        place = (np.cumsum(n) - n)[own][:, None] + np.minimum(step, n[own][:, None] - 1)
        bits = (told[place] < doc[i : i + (1 << 14), None]) & (step < n[own][:, None])
        out[i : i + (1 << 14)] = (bits * (1 << step)).sum(axis=1)
    return out


def _least_of_strings(raw: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every start in every window, the least id of the windows that hold its LENGTH bytes."""
    at = np.cumsum(length + 1) - (length + 1)
    n = len(raw) + len(length) + 1
    inside = np.ones(n, dtype=bool)
    inside[at + length] = inside[-1] = False
    letters, coded = np.unique(raw, return_inverse=True)
    t = np.ones(n, np.uint16)  # a window ends with 1, the text with 0
    t[inside] = coded + 2
    t[-1] = 0
    del coded
    sa = suffix_array(t, len(letters) + 2)
    common = common_prefixes(t, sa, LENGTH)
    starts = length - LENGTH + 1
    start = np.repeat(at - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    owner = np.full(n, _NO_DOC)
    owner[start] = np.repeat(doc, starts)
    new = common[sa] < LENGTH
    new[0] = True
    least = np.minimum.reduceat(owner[sa], np.flatnonzero(new))
    owner[sa] = least[np.cumsum(new) - 1]
    return owner[start]


def _removed(own: Part, told: pa.Table, buckets: int, shards: int) -> np.ndarray:
    """A mask of the part's bytes that go."""
    h, least, texts, item, begin, owner = own.items(_said(own, told, buckets))
    mask = np.zeros(len(h), np.uint32)
    answers = _of_kind(told, 1)
    for s, i, j in _cuts(_deal(h, shards)):
        if s in answers:
            mask[i:j] = np.frombuffer(answers[s], np.uint32)
    starts = np.fromiter(map(len, texts), np.int64, len(texts)) - LENGTH + 1
    change = np.zeros(len(own.raw) + 1, np.int32)
    # In a document with more than the least id of its window's copies, everything goes.
    later = np.flatnonzero(owner > least[item])
    np.add.at(change, begin[later], 1)
    np.subtract.at(change, begin[later] + starts[item[later]] + LENGTH - 1, 1)
    marked = np.flatnonzero((mask[item] != 0) & (owner == least[item]))
    for step in range(_GRAMS):
        x = begin[marked[(mask[item[marked]] >> np.uint32(step)) & np.uint32(1) == 1]] + step
        np.add.at(change, x, 1)
        np.subtract.at(change, x + LENGTH, 1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


_FOUND = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]


def _of_whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The mask with all bytes of a character that loses one of them."""
    if not len(raw):
        return gone
    character = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
    touched = np.zeros(int(character[-1]) + 1, bool)
    touched[character[gone]] = True
    return touched[character]


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the
    bytes that stay; with ``whole_characters``, without those of characters that lost one)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts, buckets, shards = (max(LEAST_PARTS, -(-total // size)) for size in (PART_BYTES, BUCKET_BYTES, SHARD_BYTES))
    own = len(docs.columns)
    k, x = docs.columns.index(key), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *_FOUND])
    plain = docs.toDF(*[f"c{i}" for i in range(own)])
    dealt = plain.withColumn("_part", F.pmod(F.xxhash64(f"c{k}", f"c{x}"), F.lit(parts)).cast("int"))

    def part_of(t: pa.Table) -> Part:
        return Part(t.column(k).cast(pa.int64()), t.column(x))

    def number(t: pa.Table) -> int:
        return t.column(own)[0].as_py()

    @trim
    def send(t: pa.Table) -> pa.Table:
        return _send(number(t), part_of(t), buckets)

    @trim
    def ask(t: pa.Table, told: pa.Table) -> pa.Table:
        return _ask(number(t), part_of(t), told, buckets, shards) if len(t) and len(told) else _table([])

    @trim
    def remove(t: pa.Table, told: pa.Table) -> pa.Table:
        part = part_of(t)
        gone = _removed(part, told, buckets, shards)
        before = np.concatenate([[False], gone[:-1]])
        before[part.at[:-1][part.at[:-1] < len(gone)]] = False
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (gone, gone & ~before)]
        counts = [pa.array(np.diff(part.at)), *[pa.array(s[part.at[1:]] - s[part.at[:-1]]) for s in sums]]
        del sums, before
        if whole_characters:
            gone = _of_whole_characters(part.raw, gone)
        kept = pa.array([part.raw[i:j][~gone[i:j]].tobytes() for i, j in zip(part.at[:-1].tolist(), part.at[1:].tolist(), strict=True)], pa.binary())
        return pa.table([*t.columns[:own], *counts, kept], names=[f"c{i}" for i in range(own + 4)])

    judged = dealt.groupBy("_part").applyInArrow(send, _SENT_SQL).groupBy("to").applyInArrow(trim(_judge), _SENT_SQL)
    asked = dealt.groupBy("_part").cogroup(judged.groupBy("to")).applyInArrow(ask, _SENT_SQL)
    told = judged.unionByName(asked.groupBy("to").applyInArrow(trim(_sort), _SENT_SQL))
    out = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return dealt.groupBy("_part").cogroup(told.groupBy("to")).applyInArrow(remove, out).toDF(*schema.names)


def contract(documents: DataFrame) -> DataFrame:
    found = deduplicate(documents.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns and shortened texts; a character that lost one of its bytes goes whole, and
    a null text stays null."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    k, x = docs.columns.index(key), docs.columns.index(text)
    found = deduplicate(named, f"c{k}", f"c{x}", whole_characters=True)
    cut = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col(f"c{x}"))
    return found.withColumn(f"c{x}", cut).select(*named.columns).toDF(*docs.columns)
