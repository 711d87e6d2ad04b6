"""Near-duplicate classes by DartMinHash and banded joining.

A document is the weighted set of hashes of its runs of five words (all of its words, if fewer); the weight of a run is
the number of times it occurs. Darts are thrown at the plane
of each element's weight and a rank: an element of weight w catches a Poisson number of darts in each region of ranks,
drawn from its hash, so equal elements catch equal darts in all documents. Each dart has a coordinate and the earliest
dart of a coordinate is kept: two documents keep the same one with the probability of their weighted Jaccard
similarity. About k ln k + 2k darts fill k coordinates however long the document is; where one stays empty, the next
region of ranks is thrown. The density of darts follows the size class (the power of two) of a document; one near the
next class is signed there too, so documents that may be similar always meet in a class.

Signatures are cut into bands, and documents that agree in a band are candidates. Each band has a centre, with which all
of the band is compared; those unlike it are then compared with all of the band, in blocks of bounded size that give
back only what spans their links. So no pairs of a band's near copies are made, yet any two classes that share a band
have been compared. Candidates are linked if their exact weighted Jaccard similarity (the sum of the lesser weights over
that of the greater ones) is at least the threshold, and linked documents form classes. Copies (equal sequences of words) are one document from the start.

Null and empty texts are alone; texts without words are copies only if equal; rows without an id are alone and have no
class; rows that share an id are one document of ``classes``, which is in the bands of all of them and is compared by the
least of their weighted sets; ``deduplicate`` loses none of their texts. Very long texts are signed whole, as a piece of their own; an
empty table gives no rows. Other columns are kept by ``deduplicate`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import _power_table, give_back, grams, mix, pieces, utf8, words
from tidemark.shared import stored

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Documents and bytes of a block, about.
UNLIKE_BLOCK, MEMBER_BLOCK, BLOCK_BYTES = 128, 512, 16 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 48-bit hash and count of each distinct run of words of each row (fewer than 2**16), sorted by both."""
    n = np.diff(first)
    g = grams(h, SHINGLE)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(g)) + SHINGLE <= first[1:][row[: len(g)]]
    rows, found = [row[: len(g)][inside]], [g[inside]]
    for m in range(1, SHINGLE):
        if len(few := np.flatnonzero(n == m)):
            rows.append(few)
            found.append(grams(h, m)[first[few]])
    row, g = np.concatenate(rows).astype(np.uint64), np.concatenate(found)
    bits = np.uint64(16)
    key = np.sort((row << (np.uint64(64) - bits)) | (g >> bits))
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> (np.uint64(64) - bits)).astype(np.int64), key << bits >> bits, count


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson number, as 64-bit thresholds."""
    p, total, out, i = exp(-mean), 0.0, [], 0
    while i < mean + 12 * mean**0.5 + 24:
        total += p
        out.append(min(total, 1.0))
        i += 1
        p *= mean / i
    return np.array(out)


def sign(row: np.ndarray, element: np.ndarray, weight: np.ndarray, scale: int, rows: int, coordinates: int) -> np.ndarray:
    """Signatures of ``rows`` weighted sets of the size class ``scale``; each row has an element.

    Weights are whole numbers: a weight w is w unit stretches, each with darts of its own.
    """
    density = coordinates * (log(coordinates) + 2) / 2.0**scale
    stretch = np.arange(int(weight.sum()), dtype=np.int64) - np.repeat(np.cumsum(weight) - weight, weight)
    base = np.repeat(element, weight) * _ODD[0] + stretch.astype(np.uint64) * _ODD[1] + np.array([scale], np.uint64) * _ODD[2]
    row = np.repeat(row, weight)
    out = np.full(rows * coordinates, _EMPTY)
    steps = max(1, ceil(density / 64))  # of at most 64 darts on average
    cdf = _poisson(density / steps)
    region = 0
    while True:
        got = np.full(rows * coordinates, _EMPTY) if region else out
        for step in range(steps):
            seed = mix(base + np.array([region * steps + step + 1], np.uint64) * _ODD[3])
            darts = np.searchsorted(cdf, (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
            number = np.arange(int(darts.sum())) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(np.repeat(seed, darts) + number.astype(np.uint64) * _ODD[0])
            place = ((mix(dart) >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)
            np.minimum.at(got, np.repeat(row, darts) * coordinates + place.astype(np.int64), dart)
        if region:
            out[out == _EMPTY] = got[out == _EMPTY]
        lacking = (out.reshape(rows, coordinates) == _EMPTY).any(axis=1)
        if not lacking.any():
            return out.reshape(rows, coordinates)
        keep = lacking[row]
        row, base = row[keep], base[keep]
        region += 1


def band_keys(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every band of every row that has elements."""
    size = np.bincount(row, weight, minlength=rows)
    own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    out_row, out_key = [], []
    for up in (0, 1):
        may = (size > 0) & ((up == 0) | (size >= threshold * 2.0 ** (own + 1)))
        for scale in np.unique((own + up)[may]):
            some = np.flatnonzero(may & (own + up == scale))
            dense = np.full(rows, -1)
            dense[some] = np.arange(len(some))
            mine = dense[row] >= 0
            s = sign(dense[row[mine]], element[mine], weight[mine], int(scale), len(some), BANDS * ROWS)
            key = np.full((len(some), BANDS), np.uint64(scale)) * _ODD[1] + np.arange(BANDS, dtype=np.uint64)
            for i in range(ROWS):
                key = mix(key * _ODD[2] + s.reshape(len(some), BANDS, ROWS)[:, :, i])
            out_row.append(np.repeat(some, BANDS))
            out_key.append(key.reshape(-1))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows_, keys = np.concatenate(out_row), np.concatenate(out_key)
    order = np.argsort(rows_, kind="stable")
    return rows_[order], keys[order]


def _signed(docs: DataFrame, threshold: float) -> DataFrame:
    """``id``, the copy keys ``a`` and ``b`` (null where nothing is equal to it) and ``bands`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for r0, r1 in pieces(raw, at):
                part, cut = raw[at[r0] : at[r1]], at[r0 : r1 + 1] - at[r0]
                _, _, h, first = words(part, cut)
                n = r1 - r0
                # Two hashes of the whole sequence of words; without words, of the bytes.
                keys = []
                for odd in _ODD[:2]:
                    pair = []
                    for x, edge in ((h, first), (part.astype(np.uint64) + np.uint64(1), cut)):
                        up, down = _power_table(len(x) + 1)
                        total = np.append(np.uint64(0), np.cumsum(mix(x * odd) * up[: len(x)]))
                        pair.append(mix((total[edge[1:]] - total[edge[:-1]]) * down[edge[:-1]] + np.diff(edge).astype(np.uint64)))
                    keys.append(np.where(np.diff(first) > 0, pair[0], pair[1] ^ _ODD[3]).view(np.int64))
                none = np.diff(cut) == 0
                band_row, band = band_keys(*shingles(h, first), n, threshold)
                offsets = np.searchsorted(band_row, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, n), pa.array(keys[0], mask=none), pa.array(keys[1], mask=none), lists], names=["id", "a", "b", "bands"])
            give_back()

    return docs.mapInArrow(run, "id long, a long, b long, bands array<long>")


def weighted_set(g: np.ndarray) -> np.ndarray:
    """Sorted hashes, one for each occurrence of each run of words: the common ones of two documents are the sum of the
    lesser weights, so the weighted similarity is that of these sets."""
    g = np.sort(g)
    if not len(g):
        return g
    new = np.append(True, g[1:] != g[:-1])
    nth = np.arange(len(g)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.unique(np.where(new, g, mix(g + nth.astype(np.uint64) * _ODD[2])))


def _sets(docs: DataFrame) -> DataFrame:
    """``id`` and its packed weighted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                _, _, h, first = words(raw[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
                out.append(weighted_set(grams(h, min(SHINGLE, max(1, len(h))))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "packed"])
            give_back()

    return docs.mapInArrow(run, "id long, packed binary")


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of rows with ``x``, ``y`` and both packed sets, whether each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) or not len(x):
                    linked.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(common >= threshold * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["x", "y", "linked"])

    return pairs.mapInArrow(run, "x long, y long, linked boolean")


def connected(links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the least id that links (``x``, ``y``) connect it with; each round takes the least label of
    all neighbours and then the label's own label."""
    edges = stored(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = stored(edges.groupBy("x").agg(F.min("y").alias("n")).select(F.col("x").alias("id"), F.least("x", "n").alias("label")))
    while True:
        near = edges.join(labels, edges["y"] == labels["id"]).groupBy("x").agg(F.min("label").alias("n"))
        step = labels.join(near, labels["id"] == near["x"]).select("id", F.col("label").alias("was"), F.least("label", "n").alias("label"))
        own = labels.select(F.col("id").alias("o"), F.col("label").alias("next"))
        new = stored(step.join(own, step["label"] == own["o"]).select("id", "was", F.least("label", "next").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def _spanning(queries: pa.Table, members: pa.Table, threshold: float) -> pa.Table:
    """Links of a block of documents (ids and packed sets) with a block of members; one that joins two documents which
    other links of the block connect already is left out."""
    found: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while (j := parent.get(i, i)) != i:
            parent[i] = parent.get(j, j)
            i = j
        return i

    if len(queries) and len(members):
        ids = members.column(0).to_numpy()
        sets = [np.frombuffer(p, np.uint64) for p in members.column(1).to_pylist()]
        size = np.array([len(x) for x in sets])
        order = np.argsort(h := np.concatenate(sets), kind="stable")
        h, of = h[order], np.repeat(np.arange(len(sets)), size)[order]
        for q, packed in zip(queries.column(0).to_pylist(), queries.column(1).to_pylist(), strict=True):
            own = np.frombuffer(packed, np.uint64)
            low = np.searchsorted(h, own, "left")
            n = np.searchsorted(h, own, "right") - low
            common = np.bincount(of[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(sets))
            for m in ids[(common >= threshold * (len(own) + size - common)) & (common > 0)].tolist():
                if (a := top(q)) != (b := top(m)):
                    parent[a] = b
                    found.append((min(q, m), max(q, m)))
    x, y = zip(*found, strict=True) if found else ((), ())
    return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])


def _within(unlike: DataFrame, members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of documents with the members of their bands (``band``, ``rep``, ``size``), except the bands' centres.

    Both are dealt into blocks of bounded numbers and bytes, and each pair of blocks of a band is compared in one
    place, which only says what spans its links.
    """

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1)).cast("int").alias(name))

    grid = stored(blocks(unlike, UNLIKE_BLOCK, "u").join(blocks(members.join(unlike.select("band").distinct(), "band", "left_semi"), MEMBER_BLOCK, "m"), "band"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        block, every = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = df.join(grid, "band").select("band", "rep", block.alias(own), every.alias(other))
        return rows.join(sets.select(F.col("id").alias("rep"), "packed"), "rep").select("band", "u", "m", "rep", "packed")

    few = dealt(unlike, "u", "m").groupBy("band", "u", "m")
    all_ = dealt(members, "m", "u").toDF("band_", "u_", "m_", "rep_", "packed_").groupBy("band_", "u_", "m_")
    return few.cogroup(all_).applyInArrow(lambda a, b: _spanning(a.select(["rep", "packed"]), b.select(["rep_", "packed_"]), threshold), "x long, y long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id`` and ``class_id``, the least id of its class, of all rows; null for a null id."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    signed = stored(_signed(rows, threshold))
    named = signed.where("id is not null")
    copies = named.where("a is not null").groupBy("a", "b").agg(F.min("id").alias("rep"))
    reps = named.join(copies.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "rep"), (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")) & (F.col("id") == F.col("rep")))
    in_bands = reps.select("rep", F.explode("bands").alias("band"))
    full = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(in_bands.join(full, "band").select("band", "rep", "n"))
    # The document that meets most others in its bands is the centre: the source of near copies is nearest to all.
    meets = shared.groupBy("rep").agg(F.sum("n").alias("w"))
    wanted = meets.select(F.col("rep").alias("id"))
    sets = stored(_sets(rows.join(wanted.hint("shuffle_hash"), "id", "left_semi")).groupBy("id").agg(F.min("packed").alias("packed")))
    left, right = (sets.select(F.col("id").alias(n), F.col("packed").alias(f"packed_{n}")) for n in "xy")
    known = meets.join(sets.select(F.col("id").alias("rep"), F.octet_length("packed").alias("size")), "rep")
    bands = stored(shared.join(known, "rep").select("band", "rep", "n", "w", "size"))
    centres = bands.groupBy("band").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("centre"))
    around = stored(bands.join(centres, "band").where("rep <> centre").select("band", "rep", "n", "size", F.least("rep", "centre").alias("x"), F.greatest("rep", "centre").alias("y")))
    pairs = around.select("x", "y").distinct()
    judged = stored(_similar(pairs.join(left, "x").join(right, "y").select("x", "y", "packed_x", "packed_y"), threshold))
    stars = judged.where("linked").select("x", "y")
    unlike = around.where("n > 2").join(stars, ["x", "y"], "left_anti").select("band", "rep", "size")
    labels = connected(stars.unionByName(stored(_within(unlike, around.select("band", "rep", "size"), sets, threshold))))
    by_rep = copies.join(labels, copies["rep"] == labels["id"], "left").select("a", "b", F.coalesce("label", "rep").alias("class_id"))
    # Empty texts and rows without an id are alone; as null keys they would meet in one task.
    alone = signed.where("a is null or id is null").select("id", F.col("id").alias("class_id"))
    return named.where("a is not null").select("id", "a", "b").join(by_rep, ["a", "b"]).select("id", "class_id").unionByName(alone)


def contract(documents: DataFrame) -> DataFrame:
    found = classes(documents)
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class with its own columns: that of the least id, of one id that of the least digest; and all rows
    without an id. Here each distinct text of an id is a document of its own, so unlike texts under one id all stay; of
    rows with the same id and text the one with the least other columns does."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, x = (f"c{docs.columns.index(c)}" for c in (key, text))
    named = docs.toDF(*names).withColumn("_h", F.when(F.col(k).isNotNull(), F.xxhash64(F.col(k).cast("long"), F.col(x))))
    rows = named.where("_h is not null")
    found = classes(rows, "_h", x, threshold).select(F.col("id").alias("_h"), "class_id").distinct()
    own = stored(rows.groupBy("_h").agg(F.min(F.col(k).cast("long")).alias("_k"), F.count(F.lit(1)).alias("_n")))
    first = stored(own.join(found, "_h").groupBy("class_id").agg(F.min(F.struct("_k", "_h", "_n")).alias("r")).select("r._h", "r._n"))
    kept = rows.join(first.where("_n = 1").select("_h").hint("shuffle_hash"), "_h", "left_semi").select(*names)
    again = first.where("_n > 1").select("_h")
    if not again.isEmpty():  # rows repeated as they are: few texts, or copies that all go but one
        repeated = rows.join(again, "_h", "left_semi")
        once = repeated.groupBy("_h").agg(F.min_by(F.struct(*names), F.xxhash64(*[c for c in names if c != x])).alias("_row")).select("_row.*")
        kept = kept.unionByName(once)
    return kept.unionByName(named.where("_h is null").select(*names)).toDF(*docs.columns)
