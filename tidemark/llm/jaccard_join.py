"""Documents linked by the Jaccard similarity of their word n-grams: an exact, size-aware heavy-light join.

A document is the set of its distinct runs of ``SHINGLE`` words (all of its words as one, if fewer). Two are linked if
100 |x n y| >= ``PERCENT`` |x u y|, that is, if they share c(s, t) = ceil(PERCENT (s + t) / (100 + PERCENT)) elements,
s and t being their sizes. Equal sets are one from the start. Then

- light sets, of at most b elements: each enumerates, for every size s that a partner may have, its subsets of c(s, t)
  elements. Documents of sizes s and t that have a subset in common are linked, without another look;
- heavy sets, of more: the inverted lists of their elements are scanned. In an order of all elements by their frequency,
  two sets that are linked share one of their first t - ceil(PERCENT t / 100) + 1 elements, so only those are listed.
  Sets that may be partners of heavy ones are in the lists as well;
- the boundary b has the least cost: for each size, the subsets that its sets enumerate against the entries of the
  lists that they meet.

A list has a centre, with which all of it is compared; linked sets form components. Where a list still holds several, the
next centre is compared with the others, for ``ROUNDS`` rounds. What is left of a list then is scanned in blocks of
bounded size: each set outside the list's largest component against all of the list. So a group of near copies costs one
comparison each, and yet any two sets that share a listed element have been compared or are connected.

A comparison looks at counts first: the elements of a set fall into cells by their hashes, some eight a cell, and two sets
share no more than the lesser counts of all cells. Only pairs that this bound lets through are read as whole sets and
compared compared exactly; it rejects no linked pair, and a set's cells are a sixty-fourth of its size. A block of which many pairs
pass (near copies of one text that are not quite alike) is scanned again with cells of one element each, which tell
those apart.

The frequencies are counts of all elements of all documents in a table of ``COUNTERS`` hashes; filters of at most
``filters.BITS`` say early which elements and texts are surely not wanted. So what is broadcast has a fixed size. The counts only
order the elements, and any order gives the same links; what a filter lets through in vain costs time only. Elements are
64-bit hashes of words.

Words are the parts between the ASCII blanks 20 and 09 to 0D, lower-cased by A-Z. Null and empty texts, and those without
words, have an empty set and are linked with nothing; rows without an id are alone and have no component; rows that
share an id are one document, linked with whatever one of its texts is linked with; very long texts are taken whole, as a
piece of their own; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import NOT_BLANK, give_back, grams, mix, pieces, trim, utf8, words
from tidemark.llm.filters import Filter, chunks, merged
from tidemark.llm.minhash import _similar, connected
from tidemark.shared import discard, stored

SHINGLE, PERCENT = 4, 85
#: Sizes above this one are never light: their subsets would be thousands.
MOST_LIGHT = 24
#: Counters of the table of frequencies.
COUNTERS = 1 << 20
#: Rounds of centres; elements of a cell; sets of a block of a list on either side; rows that a task scans, about.
ROUNDS, PER_CELL, OUTSIDE_BLOCK, MEMBER_BLOCK, SCANNED = 3, 8, 256, 1024, 20_000
#: Likely pairs for each set of a block from which on the block is scanned again with cells of one element.
DENSE = 2
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Elements that linked sets of sizes s and t share at least."""
    return -(-percent * (s + t) // (100 + percent))


def partners(t: int, most: int, percent: int = PERCENT) -> range:
    """Sizes up to ``most`` that a set linked with one of size t may have."""
    return range(-(-percent * t // 100), min(most, 100 * t // percent) + 1)


def listed(t: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Elements of a set of size t that are listed: any partner shares ceil(percent t / 100) elements at least."""
    return t + percent * t // -100 + 1


def subset_cost(t: int, most: int, percent: int = PERCENT) -> int:
    """Subsets that a set of size t enumerates if sizes up to ``most`` are light."""
    return sum(comb(t, overlap(s, t, percent)) for s in partners(t, most, percent))


@cache
def _left_out(t: int, k: int) -> np.ndarray:
    """All choices of k of t places, a row each."""
    return np.array(list(combinations(range(t), k)), np.int64).reshape(comb(t, k), k)


def subsets(elements: np.ndarray, most: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the subsets of a light set, each with the two sizes that it stands for."""
    t = len(elements)
    h = mix(elements * _ODD[0])
    keys, small, large = [], [], []
    for s in partners(t, most, percent):
        if (c := overlap(s, t, percent)) <= min(s, t):
            lo, hi = min(s, t), max(s, t)
            keys.append(mix((h.sum() - h[_left_out(t, t - c)].sum(axis=1, dtype=np.uint64)) * _ODD[1] + np.uint64(lo * 1000 + hi)))
            small.append(np.full(len(keys[-1]), lo, np.int32))
            large.append(np.full(len(keys[-1]), hi, np.int32))
    return np.concatenate(keys), np.concatenate(small), np.concatenate(large)


def _elements(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of words of each row."""
    n = np.diff(first)
    g = grams(h, SHINGLE)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(g)) + SHINGLE <= first[1:][row[: len(g)]]
    rows, found = [row[: len(g)][inside]], [g[inside]]
    for m in range(1, SHINGLE):
        if len(few := np.flatnonzero(n == m)):
            rows.append(few)
            found.append(grams(h, m)[first[few]])
    return np.concatenate(rows), np.concatenate(found)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _slabs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows, and the rows and hashes of their elements."""
    raw, at = utf8(column)
    for r0, r1 in pieces(raw, at):
        _, _, h, first = words(raw[at[r0] : at[r1]], at[r0 : r1 + 1] - at[r0], NOT_BLANK)
        yield r0, r1, *_elements(h, first)


def frequencies(rows: DataFrame) -> np.ndarray:
    """Numbers of elements by counter, over all texts; of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, "<i8")
        for b in batches:
            for _, _, _, h in _slabs(b.column(0)):
                np.add.at(total, _counter(h), 1)
            give_back()
        if total.any():
            yield chunks(total)

    return merged(rows.select("t").mapInArrow(run, "chunk int, x binary"), np.add, "<i8", COUNTERS)


def cell_numbers(n: np.ndarray, per: int = PER_CELL) -> np.ndarray:
    """Cells of sets of n elements: a power of two, ``per`` to twice as many elements each."""
    return 1 << np.floor(np.log2(np.maximum(n // per, 1))).astype(np.int64)


def cells(h: np.ndarray, row: np.ndarray, n: np.ndarray, per: int = PER_CELL) -> list[bytes]:
    """Numbers of elements of each row in the cells of its size, by the first bits of their hashes; 255 is 255 or more."""
    number = cell_numbers(n, per)
    first = np.append(0, np.cumsum(number))
    bits = np.log2(number).astype(np.uint64)[row]
    own = np.where(bits > 0, (mix(h) >> np.uint64(1) >> (np.uint64(63) - bits)), 0).astype(np.int64)
    raw = np.minimum(np.bincount(first[row] + own, minlength=first[-1]), 255).astype(np.uint8).tobytes()
    return [raw[i:j] for i, j in zip(first.tolist(), first[1:].tolist(), strict=False)]


def bound(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Elements that a set may share with each of others, by their cells (a row each), which may be half or twice as
    many; without a bound where a cell of both is full."""
    one, many = one.astype(np.int64), many.astype(np.int64)
    while len(one) != many.shape[1]:
        if len(one) > many.shape[1]:
            one = one.reshape(-1, 2).sum(axis=1)
        else:
            many = many.reshape(len(many), -1, 2).sum(axis=2)
    return np.minimum(one, many).sum(axis=1) + ((one >= 255) & (many >= 255)).any(axis=1) * (1 << 40)


def _signed(rows: DataFrame, sent: Broadcast, percent: int) -> DataFrame:
    """``id``, the size ``n`` of each set, two hashes of it, its listed ``tokens``, all elements of a ``small`` one, and the
    counts of its ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for b in batches:
            for r0, r1, row, h in _slabs(b.column(1)):
                order = np.lexsort((h, often[_counter(h)], row))
                row, h = row[order], h[order]
                new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
                row, h = row[new], h[new]
                rows_ = r1 - r0
                n = np.bincount(row, minlength=rows_)
                first = np.append(0, np.cumsum(n))
                a, c = (np.append(np.uint64(0), np.cumsum(mix(h * odd))) for odd in _ODD[:2])
                sums = [mix(x[first[1:]] - x[first[:-1]] + n.astype(np.uint64)).view(np.int64) for x in (a, c)]

                def lists(keep: np.ndarray, n: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h[keep].view(np.int64)))

                own = np.minimum(n, listed(n, percent))
                small = np.where(n <= MOST_LIGHT, n, 0)
                place = np.arange(len(h)) - first[row]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(r0, rows_), pa.array(n), *(pa.array(x) for x in sums), lists(place < own[row], own), lists(place < small[row], small), pa.array(cells(h, row, n), pa.binary())],
                    names=["id", "n", "a", "b", "tokens", "small", "cells"],
                )
            give_back()

    return rows.mapInArrow(run, "id long, n long, a long, b long, tokens array<long>, small array<long>, cells binary")


def _shared_tokens(reps: DataFrame, sent: Broadcast) -> DataFrame:
    """``reps`` with those of its tokens only that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            flat = tokens.flatten().to_numpy()
            keep = sent.value.may_hold(flat)
            at = np.append(0, np.cumsum(keep))[np.append(0, np.cumsum(np.diff(tokens.offsets.to_numpy())))]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat[keep]))], names=["rep", "n", "tokens"])

    return reps.select("rep", "n", "tokens").mapInArrow(run, "rep long, n long, tokens array<long>")


def _sets(rows: DataFrame, ids: DataFrame, several: DataFrame | None, per: int = 0) -> DataFrame:
    """``id`` and ``packed``, its elements sorted (or their cells, ``per`` elements each), of all rows with one of the
    ``ids`` (and some others); texts are read where they lie. Of an id with several rows, each set once."""
    sent = rows.sparkSession.sparkContext.broadcast(Filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(0)))
            b = b.filter(pa.array(sent.value.may_hold(b.column(0).to_numpy())))
            out, size = [], []
            for r0, r1, row, h in _slabs(b.column(1)):
                order = np.argsort(row, kind="stable")
                row, h = row[order], h[order]
                first = np.searchsorted(row, np.arange(r1 - r0 + 1))
                own = [np.unique(h[first[i] : first[i + 1]]) for i in range(r1 - r0)]
                size += [len(x) for x in own]
                out += [cells(x, np.zeros(len(x), np.int64), np.array([len(x)]), per)[0] if per else x.tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(out, pa.binary())], names=["id", "n", "packed"])
            give_back()

    found = rows.mapInArrow(run, "id long, n long, packed binary")
    if several is None:
        return found
    return found.join(several, "id", "left_anti").unionByName(found.join(several, "id", "left_semi").distinct())


def _light_links(light: DataFrame, most: int, percent: int) -> DataFrame:
    """Links of light sets (``rep``, ``small``) by common subsets: each of a subset's sets with the one of the least id,
    if sets of both of its sizes have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [(i, len(x), *subsets(np.array(x, np.int64).view(np.uint64), most, percent)) for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                n = [len(x[2]) for x in found]
                kinds = (np.int64, np.int32)
                own = [np.repeat(np.array([x[j] for x in found], kinds[j]), n) for j in (0, 1)]
                keys = [np.concatenate([x[j] for x in found]) for j in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[0].view(np.int64), keys[1], keys[2], *own)], names=["key", "lo", "hi", "rep", "size"])

    keys = ["key", "lo", "hi"]
    having = light.select("rep", "small").mapInArrow(run, "key long, lo int, hi int, rep long, size int")
    met = having.groupBy(*keys).agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.min("size").alias("s"), F.max("size").alias("t"))
    met = met.where("least < most and s = lo and t = hi").select(*keys, "least")
    return having.join(met, keys).where("rep <> least").select(F.col("least").alias("x"), F.col("rep").alias("y")).distinct()


def boundary(sets: dict[int, int], entries: dict[int, int], percent: int = PERCENT) -> int:
    """The largest light size: by numbers of sets, and of the entries of lists that they meet, for each size."""

    def cost(b: int) -> int:
        return sum(n * subset_cost(t, b, percent) for t, n in sets.items() if t <= b) + sum(n for t, n in entries.items() if t > b)

    return min(range(MOST_LIGHT + 1), key=cost)


def _likely(pairs: DataFrame, cells_: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (``x``, ``y``) those that may be linked by their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = (b.column(i).to_numpy() for i in (2, 3))
            keep = np.minimum(s, t) * 100 >= np.maximum(s, t) * percent
            need = -(-percent * (s + t) // (100 + percent))
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint8) for c in (4, 5))
                keep[i] = bound(x, y[None, :])[0] >= need[i]
            yield b.select(["x", "y"]).filter(pa.array(keep))

    left, right = (cells_.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"cells_{c}")) for c in "xy")
    return pairs.join(left, "x").join(right, "y").select("x", "y", "n_x", "n_y", "cells_x", "cells_y").mapInArrow(run, "x long, y long")


def _blocks(open_: DataFrame) -> DataFrame:
    """Lists of several components (``token, rep, label``) as pieces of work: ``piece, rep, label, outside``.

    Each set outside a list's largest component is to be held against all of the list. Both are dealt into blocks, and
    every block of the one against every block of the other is a piece.
    """
    parts = open_.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("m"), F.max("k").alias("in_main"))
    number = lambda n, most: F.ceil(n / most).cast("int")
    grid = main.withColumns({"us": F.greatest(number(F.col("m") - F.col("in_main"), OUTSIDE_BLOCK), F.lit(1)), "ms": number(F.col("m"), MEMBER_BLOCK)})
    rows = open_.join(grid, "token")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    columns = [F.xxhash64("token", "u", "m").alias("piece"), "rep", "label", "outside"]
    few = rows.where("label <> main").withColumns({"u": own("us"), "outside": F.lit(True)}).withColumn("m", every("ms")).select(*columns)
    all_ = rows.withColumns({"m": own("ms"), "outside": F.lit(False)}).withColumn("u", every("us")).select(*columns)
    return few.unionByName(all_)


def _scan(blocks: DataFrame, cells_: DataFrame, percent: int, per: int, dense: int | None) -> DataFrame:
    """Pairs (``x``, ``y``) of sets in different components that may be linked by their cells, of all pieces; many small
    pieces are one task's. A piece with more than ``dense`` pairs for each set gives its number (``piece``) instead."""
    tasks = max(1, -(-blocks.count() // SCANNED))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece").combine_chunks()
        piece, rep, label, n = (table.column(c).to_numpy() for c in ("piece", "rep", "label", "n"))
        outside, packed = table.column("outside").to_numpy(zero_copy_only=False), table.column("cells").to_pylist()
        edge = np.append(np.flatnonzero(np.append(True, piece[1:] != piece[:-1])), len(piece))
        number = cell_numbers(n, per)
        found: set[tuple[int, int]] = set()
        crowded = []
        for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            asked, others = np.flatnonzero(outside[a:b]) + a, np.flatnonzero(~outside[a:b]) + a
            by_number = {int(k): others[number[others] == k] for k in np.unique(number[others])}
            table_of = {k: np.frombuffer(b"".join(packed[i] for i in at), np.uint8).reshape(len(at), k) for k, at in by_number.items()}
            own: set[tuple[int, int]] = set()
            for q in asked.tolist():
                one = np.frombuffer(packed[q], np.uint8)
                for k, at in by_number.items():
                    fits = (np.minimum(n[at], n[q]) * 100 >= np.maximum(n[at], n[q]) * percent) & (label[at] != label[q])
                    if fits.any():
                        some = at[fits]
                        some = some[bound(one, table_of[k][fits]) >= -(-percent * (n[some] + n[q]) // (100 + percent))]
                        own.update((min(int(rep[q]), i), max(int(rep[q]), i)) for i in rep[some].tolist())
                if dense is not None and len(own) > dense * (b - a):
                    break
            if dense is not None and len(own) > dense * (b - a):
                crowded.append(int(piece[a]))
            else:
                found |= own
        x, y = zip(*found, strict=True) if found else ((), ())
        rows = [pa.array([*x, *[None] * len(crowded)], pa.int64()), pa.array([*y, *[None] * len(crowded)], pa.int64()), pa.array([*[None] * len(x), *crowded], pa.int64())]
        return pa.table(rows, names=["x", "y", "piece"])

    work = blocks.join(cells_, "rep").select("piece", "rep", "label", "n", "cells", "outside", F.pmod("piece", F.lit(tasks)).alias("task"))
    return work.groupBy("task").applyInArrow(trim(run), "x long, y long, piece long")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id``, the size ``n`` of its set and ``component_id``, the least id that links connect it with, of all rows."""
    send, threshold = docs.sparkSession.sparkContext.broadcast, percent / 100
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    signed = stored(_signed(rows, send(frequencies(rows)), percent))
    named = signed.where("id is not null and n > 0")
    copies = stored(named.groupBy("a", "b", "n").agg(F.min("id").alias("rep")))
    of_set = stored(named.select("id", "a", "b", "n").join(copies, ["a", "b", "n"]).select("id", "n", "rep"))
    alone = stored(signed.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id")))
    # Rows of one id may be of several sets, which are linked by it.
    repeated = stored(of_set.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("x")).where("k > 1"))
    by_id = of_set.join(repeated, "id").where("x <> rep").select("x", F.col("rep").alias("y")).distinct()
    several = None if repeated.isEmpty() else repeated.select("id")
    reps = named.join(copies.withColumnRenamed("rep", "id"), ["a", "b", "n", "id"], "left_semi")
    reps = stored((reps.dropDuplicates(["a", "b", "n"]) if several is not None else reps).select(F.col("id").alias("rep"), "n", "tokens", "small", "cells"))
    discard(signed)

    lists = stored(reps.select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("largest")).where("m > 1"))
    entries = _shared_tokens(reps, send(Filter(lists.select("token")))).select("rep", "n", F.explode("tokens").alias("token"))
    shared = stored(entries.join(lists, "token").select("token", "rep", "n", "m", "largest"))
    few = F.col("n") <= MOST_LIGHT
    light = boundary(
        {r.n: r.k for r in reps.where(few).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()},
        {r.n: r.k for r in shared.where(few).groupBy("n").agg(F.sum("m").alias("k")).collect()}, percent,
    )
    light_links = stored(_light_links(reps.where(F.col("n") <= light), light, percent))
    links = [light_links, by_id]

    heavy = shared.where((F.col("largest") > light) & (F.col("n") * 100 >= percent * (light + 1)))
    # The set that meets most others in its lists is the centre: the source of near copies is nearest to all.
    meets = heavy.groupBy("rep").agg(F.sum("m").alias("w"))
    left = stored(heavy.join(meets, "rep").select("token", "rep", "n", "w"))
    cells_ = stored(reps.join(meets.select("rep"), "rep", "left_semi").select("rep", "n", "cells"))
    discard(shared)
    discard(reps)
    seen: list[DataFrame] = []

    def compared(pairs: DataFrame) -> None:
        """Pairs that no earlier round has compared, exactly; links join the others."""
        for old in seen:
            pairs = pairs.join(old, ["x", "y"], "left_anti")
        likely = stored(_likely(pairs, cells_, percent))
        seen.append(likely)
        sets = _sets(rows, likely.select("x").unionByName(likely.select(F.col("y").alias("x"))).distinct(), several)
        one, other = (sets.select(F.col("id").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "xy")
        judged = _similar(likely.join(one, "x").join(other, "y").select("x", "y", "packed_x", "packed_y"), threshold)
        links.append(stored(judged.where("linked").select("x", "y").distinct()))

    def labelled() -> tuple[DataFrame, DataFrame]:
        """The component of each linked set, and what is left of lists that hold several."""
        labels = connected(reduce(DataFrame.unionByName, links))
        told = left.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        several_ = told.groupBy("token").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one < other").select("token")
        return labels, stored(told.join(several_, "token", "left_semi").select("token", "rep", "n", "w", "label"))

    labels = None
    for _ in range(ROUNDS):
        centres = left.groupBy("token").agg(F.max_by(F.struct(*[c for c in left.columns if c != "token"]), F.struct("w", -F.col("rep"))).alias("c"))
        met = left.join(centres, "token").where(F.col("rep") != F.col("c.rep"))
        met = met.where(F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent)
        if labels is not None:
            met = met.where(F.col("label") != F.col("c.label"))
        compared(met.select(F.least("rep", "c.rep").alias("x"), F.greatest("rep", "c.rep").alias("y")).distinct())
        left = stored(left.join(centres.select("token", F.col("c.rep").alias("centre")), "token").where("rep <> centre").select("token", "rep", "n", "w"))
        labels, left = labelled()
        if left.isEmpty():
            break
    else:
        blocks = stored(_blocks(left.select("token", "rep", "label")))
        found = stored(_scan(blocks, cells_, percent, PER_CELL, DENSE))
        crowded = blocks.join(found.where("piece is not null").select("piece"), "piece", "left_semi")
        pairs = found.where("piece is null").select("x", "y")
        if not crowded.isEmpty():
            crowded = stored(crowded)
            fine = _sets(rows, crowded.select("rep").distinct(), several, 1).select(F.col("id").alias("rep"), "n", F.col("packed").alias("cells"))
            pairs = pairs.unionByName(_scan(crowded, fine, percent, 1, None).select("x", "y"))
        compared(pairs.distinct())
        labels = connected(reduce(DataFrame.unionByName, links))
    labels = labels.withColumnRenamed("id", "rep")
    return of_set.join(labels, "rep", "left").select("id", "n", F.coalesce("label", "rep").alias("component_id")).unionByName(alone)


def contract(documents: DataFrame) -> DataFrame:
    return components(documents).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
