"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into blocks, and a cell for each pair of blocks keeps, for each term, the postings of
its candidates (places and weights that are not zero). Each query's terms scatter their weighted postings into a dense
array of scores; a partition selection keeps the k best of a cell, and the cells' lists are merged. Both sides of a
cell have bounded sizes and nothing is broadcast or collected.

Vectors that are null, or hold a null or non-finite component, and rows with a null id take no part. Ties go to the
smaller id, a repeated row counts as often as it occurs, a query's own id is no candidate, missing trailing components
count as zero, and an empty table gives no rows. Scores are exact whole numbers: a cell whose largest score may need more
than 62 bits is scored in Python's integers, which have no bound, and a best score that is no 64-bit number raises. Only
the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell at most (as hashing deals them, on average).
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 65_536
#: Queries whose score arrays are held at once.
_AT_ONCE = 32
_OUT = "query_id long, vec_id long, score long"
_NONE = -(1 << 62)


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part. Whole numbers are given as
    doubles, which hold the result exactly however large it is."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * scale
    # Doubles from 2**53 on are whole already; floor() would cut them to 64 bits.
    return F.when(whole, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as a term-major matrix of doubles, zero where a list is shorter."""
    lists = column.combine_chunks()
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((width, len(lists)))
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(flat[at[0] : at[-1]])) - np.repeat(at[:-1] - at[0], n), row] = flat[at[0] : at[-1]]
    return out


def cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of a cell for each of its queries."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(candidates):
        q_id, c_id = queries["id"].to_numpy(), candidates["id"].to_numpy()
        width = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (queries, candidates))
        q, c = _matrix(queries["v"], width), _matrix(candidates["v"], width)
        most = float((np.abs(q).max(axis=1) * np.abs(c).max(axis=1)).sum()) if width else 0.0
        if not most < 2.0**62:
            return _wide(q_id, q, c_id, c, k)
        q, c = q.astype(np.int64), c.astype(np.int64)
        postings = [(np.flatnonzero(t), t[t != 0]) for t in c]
        n = len(c_id)
        for start in range(0, len(q_id), _AT_ONCE):
            own = q[:, start : start + _AT_ONCE]
            ids = q_id[start : start + _AT_ONCE]
            scores = np.zeros((len(ids), n), np.int64)
            for term, (places, weights) in enumerate(postings):
                rows = np.flatnonzero(own[term])
                if not len(rows) or not len(places):
                    continue
                added = np.multiply.outer(own[term, rows], weights)
                if len(rows) == len(ids) and len(places) == n:
                    scores += added
                else:
                    scores[np.ix_(rows, places)] += added
            scores[ids[:, None] == c_id[None, :]] = _NONE
            least = np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(ids), 1), _NONE)
            row, place = np.nonzero((scores >= least) & (scores > _NONE))
            score = scores[row, place]
            order = np.lexsort((c_id[place], -score, row))
            row, place, score = row[order], place[order], score[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < k
            found.append((ids[row[keep]], c_id[place[keep]], score[keep]))
    columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ([], [], []))]
    return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})


def _wide(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> pa.Table:
    """The same by unbounded integers, query by query and term by term."""
    whole = lambda v: np.array([int(x) for x in v], dtype=object)
    terms = [whole(t) for t in c]
    rows: list[tuple[int, int, int]] = []
    for n, i in enumerate(q_id.tolist()):
        scores = whole(np.zeros(len(c_id)))
        for term, weight in zip(terms, q[:, n], strict=True):
            if weight:
                scores += int(weight) * term
        best = sorted((-s, j) for s, j in zip(scores.tolist(), c_id.tolist(), strict=True) if j != i)[:k]
        rows += [(i, j, -s) for s, j in best]
    if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in rows):
        raise OverflowError("a best score is no 64-bit number")
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])


def search(queries: DataFrame, candidates: DataFrame, k: int, vector: str, key: str) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the k best candidates of every query; vectors are
    arrays of whole numbers (integers or doubles)."""

    def side(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")

    q, c = side(queries), side(candidates)
    parts = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_q, n_c = q.count(), c.count()
    size = min(CANDIDATE_BLOCK, max(2048, n_c // (2 * parts)))
    q_blocks, c_blocks = -(-n_q // QUERY_BLOCK) or 1, -(-n_c // size) or 1

    def dealt(df: DataFrame, own: int, other: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "v"), F.lit(own))
        return df.select("*", block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))

    left = dealt(q, q_blocks, c_blocks).select((F.col("own") * c_blocks + F.col("other")).alias("cell"), "id", "v")
    right = dealt(c, c_blocks, q_blocks).select((F.col("other") * c_blocks + F.col("own")).alias("cell"), "id", "v")
    best = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda a, b: cell(a, b, k), _OUT)
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.select("*", F.row_number().over(merged).alias("rank")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def contract(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Each id that is divisible by ``every`` is a query against all rows."""
    rows = embeddings.select("vec_id", quantized(embeddings["embedding"]).alias("v"))
    return search(rows.where(F.col("vec_id") % every == 0), rows, k, "v", "vec_id")
