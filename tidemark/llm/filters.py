"""Arrays of fixed size that are gathered from all tasks, and filters made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import mix

#: Rows that an array is sent in; bits of a filter at most: 32 MB.
CHUNKS, BITS = 64, 1 << 28


def merged(own: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, size: int) -> np.ndarray:
    """An array of fixed size from those that tasks send in chunks (``chunk``, ``x``); merged in two steps, so that no
    chunk's arrays of all tasks meet in one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = None, None
        for b in batches:
            chunk = b.column("chunk")[0].as_py()
            for x in b.column("x"):
                x = np.frombuffer(x.as_buffer(), kind)
                total = x if total is None else add(total, x)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "x"])

    some = own.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(32)))
    out = np.zeros((CHUNKS, size // CHUNKS), kind)
    for r in some.groupBy("chunk", "some").applyInArrow(merge, "chunk int, x binary").groupBy("chunk").applyInArrow(merge, "chunk int, x binary").collect():
        out[r.chunk] = np.frombuffer(r.x, kind)
    return out.reshape(-1)


def chunks(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(total, CHUNKS)], pa.binary())], names=["chunk", "x"])


class Filter:
    """A bit for each value of a column, by its hash: what it does not hold is not among them. At most ``BITS``."""

    def __init__(self, values: DataFrame):
        rows = values.count()
        bits = 1 << min(BITS.bit_length() - 1, max(16, (16 * rows).bit_length()))
        self.shift = np.uint64(64 - bits.bit_length() + 1)
        shift = self.shift

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits, dtype=bool)
            for b in batches:
                own[(mix(b.column(0).to_numpy().view(np.uint64)) >> shift).astype(np.int64)] = True
            if own.any():
                yield chunks(np.packbits(own))

        self.bits = merged(values.mapInArrow(run, "chunk int, x binary"), np.bitwise_or, "u1", bits // 8)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        at = (mix(values.view(np.uint64)) >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
