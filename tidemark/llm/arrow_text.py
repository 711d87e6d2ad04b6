"""Text columns of Arrow batches as bytes.

All kernels work on whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that a worker remembers the ids of, and letters of such a text at most: some 40 MB a dictionary.
CACHE, CACHED_LETTERS = 200_000, 64
#: Byte classes of the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
#: Those of words between ASCII blanks, ``[^\x20\x09-\x0D]+``.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[32] = NOT_BLANK[9:14] = False


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(raw: np.ndarray, at: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, fewer than 2**16 rows; a longer row is alone."""
    row, rows = 0, len(at) - 1
    while row < rows:
        last = min(max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1), row + 65_000)
        yield row, last
        row = last


def give_back() -> None:
    """Hand freed memory back to the system: Spark keeps Python workers, and what they once held, from stage to stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trim(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one or two tables (Spark counts its arguments) that hands back its memory when it is done."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            give_back()

    return one if f.__code__.co_argcount == 1 else two


def remember(known: dict[str, bytes], new: dict[str, bytes], most: int = 0) -> None:
    """Keep the ids of short texts. Of a full dictionary the half that came first stays, as frequent texts come first."""
    most = most or CACHE
    known |= {t: i for t, i in new.items() if len(t) <= CACHED_LETTERS}
    if len(known) > most:
        for old in [*islice(known, most // 2, None)]:
            del known[old]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, so that a span's hash is one subtraction."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def words(raw: np.ndarray, at: np.ndarray, letters: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows of lower-cased text: start, end (byte positions), 64-bit hash, and the first word of each row
    (one more than rows). Rows are cut apart even where no separator stands between them. ``letters`` says of each byte
    whether it belongs to a word."""
    low = _LOWER[raw]
    inside = letters[low]
    n = len(low)
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = _power_table(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return start, end, h, np.searchsorted(start, at)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes; the last k - 1 are left out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _BASE
        out += h[i : i + n]
    return mix(out + np.uint64(k))
