"""Benchmark decontamination by winnowing.

The hash of every five words is taken, and of each six such hashes in a row the least is kept as a fingerprint. Any ten
words that a document shares with an item lie over the same six hashes in both, so they share a fingerprint. Equal
fingerprints are extended, word by word, to the whole common span; spans of ten words or more are hits. An item of one
to nine words is a single window: its one hash of all its words is looked up among the document's.

The fingerprints of distinct texts and of items are two tables that Spark joins; a filter of at most ``filters.BITS`` of
the items' fingerprints, the only thing that is broadcast, leaves out most of the texts' before. A text and the items
that it shares a fingerprint with then meet, many texts a task, and the hits are extended there. So neither the driver
nor a task ever holds the benchmark, and the plan is the same whatever its size.

Words are lower-cased by A-Z only and keep every non-ASCII character. Null and empty texts have no words, items without
words or with a null id are never found, equal items all count by their ids, repeated rows and texts are judged alike, a
very long text is matched whole, an empty table gives no rows, and any other columns of the documents are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import give_back, grams, pieces, trim, utf8, words
from tidemark.llm.filters import Filter
from tidemark.shared import stored

#: Words of a window, of a fingerprint's gram, and grams of which one is kept.
SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: Bytes of texts and items that meet in a task, about.
TASK_BYTES = 8 << 20


def _fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of winnowed grams: each the least of some window inside one text (equal ones all count)."""
    g = grams(h, GRAM)
    if len(h) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[: len(g) - WINDOW + 1].copy()
    for i in range(1, WINDOW):
        np.minimum(least, g[i : len(g) - WINDOW + 1 + i], out=least)
    last = np.repeat(first[1:], np.diff(first))[: len(least)]
    inside = np.arange(len(least)) + SPAN <= last
    kept = np.zeros(len(g), dtype=bool)
    for i in range(WINDOW):
        kept[i : len(least) + i] |= inside & (g[i : len(least) + i] == least)
    at = np.flatnonzero(kept)
    return at, g[at]


class Index:
    """Fingerprints of benchmark items."""

    def __init__(self, items: Iterable[tuple[int, str | None]]):
        self.ids, texts = [], []
        for i, t in items:
            if i is not None and t:
                self.ids.append(i)
                texts.append(t)
        raw, at = utf8(pa.array(texts, pa.string()))
        start, end, self.hash, self.first = words(raw, at)
        low = raw.tobytes().lower()
        self.word = [low[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        length = np.diff(self.first)
        places, prints = _fingerprints(self.hash, self.first)
        self.tables = {GRAM: self._table(prints, places)} if len(prints) else {}
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, SPAN):
            if len(rows := np.flatnonzero(length == m)):
                g = grams(self.hash, m)
                self.short[m] = self._table(g[self.first[rows]], self.first[rows])
        self.item_of = np.repeat(np.arange(len(self.ids)), length)

    @staticmethod
    def _table(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        return h[order], place[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Places in ``h`` that the table has, each with the item words it stands for."""
        known, place = table
        low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        for i in np.flatnonzero(high > low):
            yield int(i), place[low[i] : high[i]]

    def match(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """For every text: its number of words, a mask of those hit, and the ids of items with occurring windows."""
        raw, at = utf8(column)
        for r0, r1 in pieces(raw, at):
            part = raw[at[r0] : at[r1]]
            start, end, h, first = words(part, at[r0 : r1 + 1] - at[r0])
            hit = np.zeros(len(h), dtype=bool)
            items: dict[int, set[int]] = {}
            if self.tables or self.short:
                self._match(part, start, end, h, first, hit, items)
            for r in range(r1 - r0):
                yield int(first[r + 1] - first[r]), hit[first[r] : first[r + 1]], items.get(r, set())

    def _match(self, part, start, end, h, first, hit, items) -> None:  # noqa: ANN001
        def same(a: int, b: int, place: int) -> bool:
            return all(part[start[i] : end[i]].tobytes().lower() == self.word[place + i - a] for i in range(a, b))

        def found(a: int, b: int, place: int, row: int) -> None:
            if same(a, b, place):
                hit[a:b] = True
                items.setdefault(row, set()).add(self.ids[self.item_of[place]])

        done: dict[tuple[int, int], int] = {}
        for table in self.tables.values():
            at, prints = _fingerprints(h, first)
            for j, places in self._find(table, prints):
                j = int(at[j])
                row = int(np.searchsorted(first, j, "right")) - 1
                for p in places.tolist():
                    item = int(self.item_of[p])
                    shift = j - p
                    if done.get((shift, item), -1) > j:
                        continue
                    lo, hi = max(first[row], self.first[item] + shift), min(first[row + 1], self.first[item + 1] + shift)
                    unlike = np.flatnonzero(h[lo:hi] != self.hash[lo - shift : hi - shift]) + lo
                    k = int(np.searchsorted(unlike, j))
                    a = int(unlike[k - 1]) + 1 if k else int(lo)
                    b = int(unlike[k]) if k < len(unlike) else int(hi)
                    done[shift, item] = max(b, j + 1)
                    if b - a >= SPAN:
                        found(a, b, a - shift, row)
        last = np.repeat(first[1:], np.diff(first))
        for m, table in self.short.items():
            for j, places in self._find(table, grams(h, m)):
                if j + m <= last[j]:
                    row = int(np.searchsorted(first, j, "right")) - 1
                    for p in places.tolist():
                        found(j, j + m, p, row)


def _prints(h: np.ndarray, first: np.ndarray, sizes: range) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the fingerprints of rows of words, and of the windows of each of the ``sizes``."""
    places, prints = _fingerprints(h, first)
    rows, found = [np.searchsorted(first, places, "right") - 1], [prints]
    last = np.repeat(first[1:], np.diff(first))
    for m in sizes:
        g = grams(h, m)
        inside = np.flatnonzero(np.arange(len(g)) + m <= last[: len(g)])
        rows.append(np.searchsorted(first, inside, "right") - 1)
        found.append(g[inside])
    return np.concatenate(rows), np.concatenate(found)


def _of_items(items: DataFrame) -> DataFrame:
    """``item_id``, ``item_key``, ``print`` and ``size`` (words of a short item, else 0) of each item's fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8(b.column(2))
            _, _, h, first = words(raw, at)
            n = np.diff(first)
            row, found = _prints(h, first, range(0))
            size = np.zeros(len(row), np.int32)
            for m in range(1, SPAN):
                if len(few := np.flatnonzero(n == m)):
                    row, found, size = np.append(row, few), np.append(found, grams(h, m)[first[few]]), np.append(size, np.full(len(few), m, np.int32))
            at_ = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at_), b.column(1).take(at_), pa.array(found.view(np.int64)), pa.array(size.astype(np.int32))], names=["item_id", "item_key", "print", "size"])
            give_back()

    return items.select("item_id", "item_key", "item_text").mapInArrow(run, "item_id long, item_key string, print long, size int").distinct()


def _counted(rows: DataFrame, sizes: list[int], known: Filter | None) -> DataFrame:
    """The columns of ``rows`` but ``_text``, ``_n_words``, and ``_prints``: those of its fingerprints that an item may have."""
    place, own = rows.columns.index("_text"), [c for c in rows.columns if c != "_text"]
    sent = rows.sparkSession.sparkContext.broadcast(known)
    kept = [i for i, c in enumerate(rows.columns) if c != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text"] + ["_n_words long", "_prints array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = utf8(b.column(place))
            n, many, found = [], [], [np.zeros(0, np.int64)]
            for r0, r1 in pieces(raw, at):
                _, _, h, first = words(raw[at[r0] : at[r1]], at[r0 : r1 + 1] - at[r0])
                n.append(np.diff(first))
                counts = np.zeros(r1 - r0, np.int64)
                if sent.value is not None:
                    row, prints = _prints(h, first, sizes)
                    maybe = sent.value.may_hold(prints)
                    order = np.argsort(row[maybe], kind="stable")
                    row, prints = row[maybe][order], prints[maybe][order]
                    counts = np.bincount(row, minlength=r1 - r0)
                    found.append(prints.view(np.int64))
                many.append(counts)
            give_back()
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *many]))).astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(np.concatenate([np.zeros(0, np.int64), *n])), lists], names=[*own, "_n_words", "_prints"])

    return rows.mapInArrow(run, schema)


def _hits(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``_key``, ``n_hit`` and ``items`` of the texts (``_key``, ``_text``) that hold a window of one of their items (``pairs``:
    ``_key``, ``item_id``, ``item_text``)."""
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("item_text") + 16), F.lit(0))).first()[0] + texts.agg(F.coalesce(F.sum(F.octet_length("_text") + 16), F.lit(0))).first()[0]
    task = F.pmod(F.xxhash64("_key"), F.lit(max(1, -(-size // TASK_BYTES)))).alias("task")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items: dict[str, list[tuple[int, str]]] = {}
        for key, i, t in zip(*(right.column(c).to_pylist() for c in ("_key", "item_id", "item_text")), strict=True):
            items.setdefault(key, []).append((i, t))
        keys, n_hit, found = [], [], []
        for row, key in enumerate(left.column("_key").to_pylist()):
            ((_, mask, ids),) = Index(items.get(key, ())).match(left.column("_text").slice(row, 1))
            if ids:
                keys.append(key)
                n_hit.append(int(mask.sum()))
                found.append(sorted(ids))
        return pa.table([pa.array(keys, pa.string()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["_key", "n_hit", "items"])

    right = pairs.select(task, "_key", "item_id", "item_text")
    return texts.select(task, "_key", "_text").groupBy("task").cogroup(right.groupBy("task")).applyInArrow(trim(run), "_key string, n_hit long, items array<long>")


def judged(docs: DataFrame, benchmark: DataFrame, text: str = "text", own: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The columns ``own`` of ``docs`` with ``_key`` (a digest of the text) and ``_n_words`` of all rows, and ``_key``, ``n_hit``
    and ``items`` of the texts that are hit. ``benchmark`` has ``item_id`` and ``text``. Both are stored."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("item_key"), F.col("text").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    prints = stored(_of_items(items))
    sizes = sorted(r[0] for r in prints.where("size > 0").select("size").distinct().collect())  # of nine
    known = None if prints.isEmpty() else Filter(prints.select("print").distinct())
    keyed = docs.select(*own, F.md5(F.col(text).cast("binary")).alias("_key"), F.col(text).alias("_text"))
    rows = stored(_counted(keyed, sizes, known))
    asked = rows.where("size(_prints) > 0").select("_key", F.explode(F.array_distinct("_prints")).alias("print")).distinct()
    met = stored(asked.join(prints, "print").select("_key", "item_id", "item_key").distinct())
    wanted = met.select("_key").distinct()
    # Copies of a text are one; its rows are found by the digest again.
    texts = keyed.select("_key", "_text").where(F.col("_key").isNotNull())
    texts = stored(_only(texts, Filter(wanted.select(F.xxhash64("_key"))) if known else None).join(wanted, "_key", "left_semi").dropDuplicates(["_key"]))
    pairs = met.join(items, ["item_id", "item_key"]).select("_key", "item_id", "item_text")
    return rows.drop("_prints"), stored(_hits(texts, pairs))


def _only(rows: DataFrame, known: Filter | None, held: bool = True) -> DataFrame:
    """Rows whose ``_key`` a filter may hold, or those of which it surely does not; no row moves for that."""
    if known is None:
        return rows.limit(0) if held else rows
    place, sent = rows.columns.index("_key"), rows.sparkSession.sparkContext.broadcast(known)
    hashed = rows.withColumn("_hash", F.xxhash64("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = sent.value.may_hold(b.column(b.num_columns - 1).to_numpy()) & b.column(place).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(maybe == held))

    return hashed.mapInArrow(run, rows.schema)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_hit`` and ``items`` (sorted ids of items with occurring windows)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    rows, hits = judged(plain, benchmark, names[docs.columns.index(text)])
    words_of = rows.where("_key is not null").groupBy("_key").agg(F.max("_n_words").alias("n_words"))
    keyed = plain.withColumn("_key", F.md5(F.col(names[docs.columns.index(text)]).cast("binary")))
    # Texts without a digest have no words, and stay where they are.
    out = keyed.where("_key is not null").join(words_of, "_key").join(hits, "_key", "left").unionByName(keyed.where("_key is null"), allowMissingColumns=True)
    found = [F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items")]
    return out.select(*names, *found).toDF(*docs.columns, "n_words", "n_hit", "items")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def contract(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, hits = judged(documents, benchmark, "text", ("doc_id",))
    found = rows.join(hits, "_key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<long>")))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no window of the benchmark occurs in, with their own columns. Only rows whose digest a filter of
    the hit ones may hold are moved."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = names[docs.columns.index(text)]
    _, hits = judged(plain, benchmark, own)
    known = None if hits.isEmpty() else Filter(hits.select(F.xxhash64("_key")))
    keyed = plain.withColumn("_key", F.md5(F.col(own).cast("binary")))
    kept = _only(keyed, known, held=False).unionByName(_only(keyed, known).join(hits.select("_key"), "_key", "left_anti"))
    return kept.select(*names).toDF(*docs.columns)
