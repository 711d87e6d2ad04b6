"""Phrase collocations of each language, by counts of all n-grams over deduplicated pieces.

Texts are lower-cased (A-Z) and cut at ``. , ; : ! ?`` and line ends into pieces, and those at blanks and tabs into
words; phrases lie within a piece. Then

1. equal pieces become one with a multiplicity: within a batch first, then in the part to which a piece's hash sends
   it, so a piece that a third of all texts holds arrives once from each batch;
2. a part counts the hashes of its own words and word pairs, weighted by multiplicity, and sends each once to a bucket of
   hashes; the bucket sums them in duckdb, which goes to disk beyond its memory, and tells the parts which reach
   ``least``;
3. a part sends the phrases all of whose words and pairs reach ``least`` (no other phrase can), each once, to buckets of
   phrases, which sum them by their letters in duckdb; hashes have only left out what could not count;
4. each phrase that counts looks up the counts of its two parts at every cut: the requests are shuffled to the counts.

A part, a bucket and a block of records are bounded by ``PART_BYTES`` and ``BUCKET_BYTES`` of text, so with the input
they grow in number; a phrase or hash has at most one record from each part, however often it occurs. duckdb's spill is
a folder of the task's own, gone when the task ends, like Spark's own spill: a lost executor loses nothing but that task.

Null texts are empty, a null language is ``und``; repeated rows all count; a text without words counts nothing; a very
long piece is a part of its own; phrases of equal score and count are in the order of their UTF-8 bytes; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import _LOWER, _power_table, give_back, mix, pieces, trim, utf8, words
from tidemark.shared import stored

#: Occurrences of a phrase, its words, phrases of a language, and the share of occurrences (in hundredths) within a
#: longer phrase at which a phrase is a part of that one.
LEAST, LONGEST, TOP, COVERED = 100, 5, 2000, 100
#: Bytes of text of a part and of the texts whose hashes or phrases share a bucket, about; parts and buckets at least.
PART_BYTES, BUCKET_BYTES, LEAST_PARTS = 4 << 20, 12 << 20, 16
#: Bytes of text that are cut at once, and bytes from which what is sent is compressed.
SLICE_BYTES, SHORT = 8 << 20, 256
#: duckdb's memory, beyond which it goes to disk; ranges that each language's phrases are first ranked in.
MEMORY, RANGES = "160MB", 16
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
#: Kinds of bytes: of words, blanks within a piece, ends of a piece.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*range(10, 14), *b".,;:!?"]] = 2
_NOT_SPACE = np.arange(256) != 32


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of rows of text, lower-cased, with single blanks between their words: their bytes, offsets (one more than
    pieces), rows, and numbers of words. Pieces without words are left out."""
    low = _LOWER[raw]
    kind = _KIND[low]
    word = kind == 0
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[at] = True
    start = np.flatnonzero(word & (~np.append(False, word[:-1]) | edge[:-1])) if len(low) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.flatnonzero(word & (~np.append(word[1:], False) | edge[1:])) + 1
    ends = np.append(0, np.cumsum(kind == 2, dtype=np.int64))
    row = np.searchsorted(at, start, "right") - 1
    new = np.append(True, (ends[start[1:]] != ends[end[:-1]]) | (row[1:] != row[:-1]))
    keep = word.copy()
    blank = end[np.flatnonzero(~new) - 1]
    keep[blank], low[blank] = True, 32
    to = np.append(0, np.cumsum(keep, dtype=np.int64))
    first = np.flatnonzero(new)
    return low[keep], np.append(to[start[first]], to[-1]), row[first], np.diff(np.append(first, len(start)))


def _strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def _hashes(column: pa.Array) -> np.ndarray:
    """A hash of each string."""
    raw, at = utf8(column)
    out = [np.zeros(0, np.uint64)]
    for r0, r1 in pieces(raw, at):
        part, own = raw[at[r0] : at[r1]], at[r0 : r1 + 1] - at[r0]
        up, down = _power_table(len(part) + 1)
        total = np.append(np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]))
        out.append(mix((total[own[1:]] - total[own[:-1]]) * down[own[:-1]] + np.diff(own).astype(np.uint64)))
    return np.concatenate(out)


def _of_language(lang: str) -> np.uint64:
    return np.uint64(int(_hashes(pa.array([f"{lang} "]))[0]))


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """The one of n ranges of hashes that each is in."""
    return ((h >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int32)


def _summed(strings: pa.Array, weight: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings, and the sums of their weights."""
    got = pa.table([strings, pa.array(weight)], names=["s", "m"]).group_by("s", use_threads=False).aggregate([("m", "sum")]).combine_chunks()
    column = got.column("s")
    return (column.chunk(0) if column.num_chunks else strings.slice(0, 0)), got.column("m_sum").to_numpy().astype(np.int64)


def _lines(column: pa.Array) -> pa.Array:
    """The lines of all rows of a column of joined lines."""
    raw, at = utf8(column)
    end = np.flatnonzero(raw == 10)
    return _strings(raw[raw != 10], np.append(0, end - np.arange(len(end))))


def _joined(strings: pa.Array, first: np.ndarray) -> list[bytes]:
    """The strings of each range, every one with a line end, packed."""
    raw, at = utf8(strings)
    n = len(at) - 1
    out = np.full(len(raw) + n, 10, np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[at[1:] + np.arange(n)] = False
    out[inside] = raw
    cuts = (at + np.arange(n + 1))[first].tolist()
    return [_packed(out[i:j].tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]


def _packed(raw: bytes) -> bytes:
    """Compressed from some length on; the first byte says whether."""
    return b"\1" + zstandard.compress(raw, 3) if len(raw) >= SHORT else b"\0" + raw


def _unpacked(packed: bytes) -> bytes:
    return zstandard.decompress(packed[1:]) if packed[0] else packed[1:]


def _numbers(x: np.ndarray, first: np.ndarray) -> list[bytes]:
    """64-bit numbers of each range, packed: the first bytes of all, then the second ones, and so on."""
    planes = lambda part: np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8).T.tobytes()
    cuts = first.tolist()
    return [_packed(planes(x[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]


def _read_numbers(packed: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(packed), np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _read_lines(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return _lines(pa.array([_unpacked(x.as_py()) for x in column], pa.large_binary()))


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Ranges of a batch's rows with about ``SLICE_BYTES`` of text (its second column)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _cut(docs: DataFrame, parts: int) -> DataFrame:
    """``part``, ``lang``, the distinct pieces of a slice for that part (lines), their ``m``, and words in all."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        code = pc.dictionary_encode(pc.fill_null(batch.column(0), "und"))
        langs, code = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
        raw, at = utf8(batch.column(1))
        blocks = []
        for r0, r1 in pieces(raw, at):
            own, cuts, row, n = cut(raw[at[r0] : at[r1]], at[r0 : r1 + 1] - at[r0])
            blocks.append(pa.table([pa.array(code[r0 + row].astype(np.int32)), _strings(own, cuts), pa.array(n)], names=["lang", "s", "n"]))
        got = pa.concat_tables(blocks).group_by(["lang", "s"], use_threads=False).aggregate([("n", "count"), ("n", "sum")]).combine_chunks()
        if not len(got):
            return None
        lang, m, n = (got.column(c).to_numpy() for c in ("lang", "n_count", "n_sum"))
        seed = np.array([_of_language(x) for x in langs], np.uint64)
        part = _range(mix(_hashes(got.column("s")) ^ seed[lang]), parts)
        order = np.lexsort((lang, part))
        lang, part, m, n = lang[order], part[order], m[order], n[order]
        first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (lang[1:] != lang[:-1])))
        upto = np.append(first, len(part))
        lines = pa.array(_joined(got.column("s").take(pa.array(order)), upto), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([langs[k] for k in lang[first]], pa.string()), lines, pa.array(_numbers(m.astype(np.int64), upto), pa.binary()), pa.array(np.add.reduceat(n, first))], names=["part", "lang", "lines", "m", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _sliced(batch):
                if (out := one(piece)) is not None:
                    yield out
                give_back()

    return docs.mapInArrow(run, "part int, lang string, lines binary, m binary, n long")


class _Part:
    """The distinct pieces of a part in one language: their words, and hashes of words and pairs."""

    def __init__(self, table: pa.Table, lang: str):
        own = table.filter(pc.equal(table.column("lang"), lang))
        strings, m = _summed(_read_lines(own.column("lines")), np.concatenate([_read_numbers(x.as_py()) for x in own.column("m")]))
        self.raw, at = utf8(strings)
        place = np.int32 if len(self.raw) < 1 << 31 else np.int64
        starts, ends, hashes, after, weight = ([np.zeros(0, kind)] for kind in (place, place, np.uint64, place, np.int64))
        for r0, r1 in pieces(self.raw, at):
            start, end, h, first = words(self.raw[at[r0] : at[r1]], at[r0 : r1 + 1] - at[r0], _NOT_SPACE)
            n = np.diff(first)
            starts.append((start + at[r0]).astype(place))
            ends.append((end + at[r0]).astype(place))
            hashes.append(h)
            after.append((np.repeat(first[1:], n) - np.arange(len(h))).astype(place))
            weight.append(np.repeat(m[r0:r1], n))
        self.start, self.end, h, self.left, self.weight = map(np.concatenate, (starts, ends, hashes, after, weight))
        seed = _of_language(lang)
        self.one = mix(h * _ODD[0] + seed)
        self.paired = self.left > 1  # words that have a next one; left counts the words from each to its piece's end
        self.two = mix(h[:-1] * _ODD[1] + h[1:] * _ODD[2] + seed) if len(h) else h

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        pair = np.flatnonzero(self.paired)
        return np.concatenate([self.one, self.two[pair]]), np.concatenate([self.weight, self.weight[pair]])

    def phrases(self, frequent: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray]:
        """Phrases whose words and pairs are all frequent, with their numbers."""
        of = np.zeros(1 << 20, dtype=bool)
        of[(frequent >> np.uint64(44)).astype(np.int64)] = True

        def known(h: np.ndarray) -> np.ndarray:
            out = of[(h >> np.uint64(44)).astype(np.int64)]
            maybe = np.flatnonzero(out)
            at = np.searchsorted(frequent, h[maybe])
            out[maybe] = frequent[np.minimum(at, len(frequent) - 1)] == h[maybe] if len(frequent) else False
            return out

        pair = self.paired.copy()
        pair[pair] = known(self.two[np.flatnonzero(self.paired)])
        begin, stop = [np.flatnonzero(known(self.one))], []
        stop.append(self.end[begin[0]])
        chain = np.flatnonzero(pair)
        for k in range(2, longest + 1):
            begin.append(chain)
            stop.append(self.end[chain + k - 1])
            chain = chain[pair[chain + k - 1]]  # the pair of the last word and the one after it
        at = np.concatenate(begin)
        first, size = self.start[at].astype(np.int64), (np.concatenate(stop) - self.start[at]).astype(np.int64)
        out, total = [], [np.zeros(0, np.int64)]
        for k in range(0, len(at), 1 << 18):
            n = size[k : k + (1 << 18)]
            cuts = np.append(0, np.cumsum(n))
            places = np.arange(cuts[-1]) + np.repeat(first[k : k + (1 << 18)] - cuts[:-1], n)
            strings, m = _summed(_strings(self.raw[places], cuts), self.weight[at[k : k + (1 << 18)]])
            out.append(strings)
            total.append(m)
        return _summed(pa.concat_arrays(out), np.concatenate(total)) if out else (_strings(self.raw[:0], np.zeros(1, np.int64)), total[0])


def _requests(dealt: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``part``, and the hashes of a part for that bucket (ascending, as differences) with their numbers."""

    def run(table: pa.Table) -> pa.Table:
        found = [_Part(table, lang).hashes() for lang in pc.unique(table.column("lang")).to_pylist()]
        h, m = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h)
        h, m = h[order], m[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, m = h[first], np.add.reduceat(m, first)
        bucket = _range(h, buckets)
        group = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        upto = np.append(group, len(h))
        part = pa.array(np.full(len(group), table.column("part")[0].as_py(), np.int32))
        step = np.diff(h, prepend=np.uint64(0))
        step[group] = h[group]
        return pa.table([pa.array(bucket[group]), part, pa.array(_numbers(step, upto), pa.binary()), pa.array(_numbers(m, upto), pa.binary())], names=["bucket", "part", "h", "m"])

    return dealt.groupBy("part").applyInArrow(trim(run), "bucket int, part int, h binary, m binary")


def _counted(source: pa.RecordBatchReader, sql: str) -> Iterator[pa.RecordBatch]:
    """Rows of a statement over ``r``, a table of the batches; both may be larger than memory."""
    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False}) as c:
        c.register("source", source)
        c.execute("CREATE TABLE r AS SELECT * FROM source")
        yield from c.sql(sql).to_arrow_reader(100_000)


def _frequent(requests: DataFrame, least: int) -> DataFrame:
    """``part`` and those of its hashes whose numbers in all parts reach ``least``."""
    schema = pa.schema([("part", pa.int32()), ("h", pa.int64()), ("m", pa.int64())])
    sql = f"SELECT part, h FROM r SEMI JOIN (SELECT h FROM r GROUP BY h HAVING sum(m) >= {least}) USING (h)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, h, m in zip(*(b.column(c).to_pylist() for c in ("part", "h", "m")), strict=True):
                    own = np.cumsum(_read_numbers(h, np.uint64), dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(own), pa.array(_read_numbers(m))], schema=schema)

        for b in _counted(pa.RecordBatchReader.from_batches(schema, flat()), sql):
            b = b.sort_by("part")
            part = b.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(part)).astype(np.int32)), b.column(1))], names=["part", "h"])
        give_back()

    return requests.groupBy("bucket").applyInArrow(run, "part int, h array<long>")


def _phrases(dealt: DataFrame, frequent: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``bucket``, ``lang``, the phrases of a part for that bucket (lines), and their numbers."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        h = np.sort(known.column("h").combine_chunks().flatten().to_numpy().view(np.uint64)) if len(known) else np.zeros(0, np.uint64)
        out = []
        for lang in pc.unique(table.column("lang")).to_pylist() if len(table) else ():
            strings, m = _Part(table, lang).phrases(h, longest)
            if not len(strings):
                continue
            bucket = _range(mix(_hashes(strings) ^ _of_language(lang)), buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, m = bucket[order], m[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            upto = np.append(first, len(bucket))
            lines = pa.array(_joined(strings.take(pa.array(order)), upto), pa.binary())
            out.append(pa.table([pa.array(bucket[first]), pa.array([lang] * len(first), pa.string()), lines, pa.array(_numbers(m, upto), pa.binary())], names=["bucket", "lang", "lines", "m"]))
        kinds = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("lines", pa.binary()), ("m", pa.binary())])
        return pa.concat_tables(out).cast(kinds) if out else kinds.empty_table()

    return dealt.groupBy("part").cogroup(frequent.groupBy("part")).applyInArrow(trim(run), "bucket int, lang string, lines binary, m binary")


def _sums(phrases: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase`` and ``f``, its number over all parts, if that reaches ``least``."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int64())])
    sql = f"SELECT lang, phrase, sum(m)::BIGINT AS f FROM r GROUP BY lang, phrase HAVING sum(m) >= {least}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    m = _read_numbers(b.column("m")[k].as_py())
                    lang = pa.array([b.column("lang")[k].as_py()], pa.string()).take(pa.array(np.zeros(len(m), np.int32)))
                    yield pa.RecordBatch.from_arrays([lang, _read_lines(b.column("lines").slice(k, 1)).cast(pa.string()), pa.array(m)], schema=schema)

        yield from _counted(pa.RecordBatchReader.from_batches(schema, flat()), sql)
        give_back()

    return phrases.groupBy("bucket").applyInArrow(run, "lang string, phrase string, f long")


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase`` and ``f`` of all phrases of up to ``longest`` words with ``f`` of ``least`` or more, and
    ``lang`` and ``n``, the words of each language. Both are stored."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_PARTS, -(-size // BUCKET_BYTES))
    dealt = stored(_cut(rows, max(LEAST_PARTS, -(-size // PART_BYTES))))
    totals = stored(dealt.groupBy("lang").agg(F.sum("n").alias("n")))
    own = dealt.select("part", "lang", "lines", "m")
    frequent = stored(_frequent(_requests(own, buckets), least))
    return stored(_sums(_phrases(own, frequent, buckets, longest), least)), totals


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The first ``top`` phrases of each language by score, number ``a`` and phrase: ``lang``, ``rank``, ``phrase``,
    ``a``, ``l`` and ``r`` (numbers of the two parts at the cut that scores least, of equal ones the first), ``n``,
    ``score`` (floor of 1000 a n / (l r)). Phrases that lie within a longer one with ``covered`` hundredths of their
    number or more are left out."""
    known, totals = counts(docs, text, lang, least, longest)
    phrases = known.withColumn("k", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).where("k >= 2").withColumnRenamed("f", "a")
    longer = phrases.where("k >= 3").select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left_out = F.coalesce(F.lit(100) * F.col("most") >= F.lit(covered) * F.col("a"), F.lit(False))
    free = stored(phrases.join(most, ["lang", "phrase"], "left").where(~left_out).select("lang", "phrase", "a", "k"))
    cuts = free.select("lang", "phrase", "a", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    asked = cuts.select("lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right"))
    part = lambda side, number: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(number))
    told = asked.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = lambda c: f"cast({c} as decimal(19, 0))"  # noqa: E731  their products have up to 38 digits
    score = F.expr(f"cast(cast(1000 * {whole('a')} as decimal(19, 0)) * {whole('n')} div ({whole('l')} * {whole('r')}) as long)")
    best = told.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(RANGES))], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
