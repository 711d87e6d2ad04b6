"""Periodic runs of words, found by probing a harmonic grid.

A run is a stretch of words with the smallest period q (words q apart are equal) that is at least ``LEAST`` words and
``TIMES`` periods long and that no neighbouring word extends. For each period p the words at jp and (j + 1)p are
compared: a run of three periods covers at least two such grid points, whatever its start, and all grids together have
n/1 + n/2 + n/3 + ... points, about n ln n for n words. Equal pairs are looked at over the few words around them, and
what stands is extended both ways by comparing slices that double in length.

Periods are probed in ascending order. A pair of grid points inside a run whose period divides p shows that run again
(neither end can be passed with period p, or it would be passed with the run's own), so it is skipped; a stretch whose
period is a multiple of a smaller one is none of its own.

Words are the parts between the ASCII blanks 20 and 09 to 0D, compared as they are. A null, empty or short text has no
runs; repeated rows are judged alike; a very long text is searched whole, in blocks of bounded size; an empty table gives
no rows; all other columns are kept, and the new ones take another name (an underscore more) where theirs is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.arrow_text import give_back

#: Words of a run, and its periods, at least.
LEAST, TIMES = 24, 3
#: Grid points probed at once; pairs looked at around their points at once.
BLOCK, SLAB = 1 << 20, 1 << 14

_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _grid(n: int, times: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods that have about ``BLOCK`` grid points together, in ascending order."""
    p, last = 1, n // times
    while p <= last:
        # The points of p to q - 1 are fewer than n (q - p) / p.
        q = min(last + 1, p + max(1, BLOCK * p // n))
        yield p, q
        p = q


def _equal_pairs(ids: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points jp, and their p, whose word is also that of (j + 1)p; for all periods from p to q - 1."""
    if q == p + 1:
        at = np.flatnonzero(ids[: len(ids) - p : p] == ids[p::p]) * p
        return at, np.full(len(at), p)
    periods = np.arange(p, q)
    n = (len(ids) - 1) // periods
    period = np.repeat(periods, n)
    at = (np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)) * period
    same = ids[at] == ids[at + period]
    return at[same], period[same]


def _stretch(ids: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """First and last (exclusive) of the places around ``at`` at which ids equal those p later."""
    n, lo, hi, step = len(ids) - p, at, at + 1, 32
    while hi < n:
        upto = min(n, hi + step)
        unlike = ids[hi:upto] != ids[hi + p : upto + p]
        if (k := int(unlike.argmax())) or unlike[0]:
            hi += k
            break
        hi, step = upto, min(2 * step, 1 << 16)
    step = 32
    while lo > 0:
        down = max(0, lo - step)
        unlike = (ids[down:lo] != ids[down + p : lo + p])[::-1]
        if (k := int(unlike.argmax())) or unlike[0]:
            lo -= k
            break
        lo, step = down, min(2 * step, 1 << 16)
    return lo, hi


def _is_power(ids: np.ndarray, start: int, p: int) -> bool:
    """Whether a proper divisor of p is a period of the stretch of at least two periods from ``start`` on."""
    rest, r = p, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            d = p // r
            if np.array_equal(ids[start : start + p], ids[start + d : start + d + p]):
                return True
            while rest % r == 0:
                rest //= r
        r += 1
    return False


def runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, by start and then period; ``times`` is 3 or more."""
    n = len(ids)
    if n < least:
        return []
    # Equal neighbours that any run has around any of its points, and that many unlike words beyond both ends.
    span = min(max(least - p, (times - 1) * p) for p in range(1, max(2, least)))
    padded = np.concatenate([-1 - np.arange(span), ids, -1 - span - np.arange(span)]).astype(np.int32)
    around = np.arange(1 - span, span)
    found: list[tuple[int, int, int]] = []
    # For each word, the first and the last run found that has it.
    first_run, last_run = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    period_of = np.ones(1, np.int64)

    for p0, p1 in _grid(n, times):
        all_at, all_p = _equal_pairs(ids, p0, p1)
        for k in range(0, len(all_at), SLAB):
            at, p = all_at[k : k + SLAB], all_p[k : k + SLAB]
            for of in (first_run, last_run):
                if found and len(at):
                    run = of[at]
                    fresh = (run < 0) | (run != of[at + p]) | (p % period_of[run] != 0)
                    at, p = at[fresh], p[fresh]
            if not len(at):
                continue
            places = at[:, None] + around + span
            equal = padded[places] == padded[places + p[:, None]]
            right = np.logical_and.accumulate(equal[:, span - 1 :], axis=1).sum(axis=1)
            left = np.logical_and.accumulate(equal[:, span - 1 :: -1], axis=1).sum(axis=1)
            wide = left + right > span
            known = (0, 0, 0)
            for x, q in zip(at[wide].tolist(), p[wide].tolist(), strict=True):
                if known[0] == q and known[1] <= x < known[2]:
                    continue
                if any((r := int(of[x])) >= 0 and r == of[x + q] and q % period_of[r] == 0 for of in (first_run, last_run)):
                    continue
                lo, hi = _stretch(ids, x, q)
                known = (q, lo, hi)
                length = hi - lo + q
                if length >= max(least, times * q) and not _is_power(ids, lo, q):
                    if len(period_of) == len(found):
                        period_of = np.append(period_of, np.ones(len(period_of), np.int64))
                    period_of[len(found)] = q
                    own = first_run[lo : hi + q]
                    own[own < 0] = len(found)
                    last_run[lo : hi + q] = len(found)
                    found.append((lo, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; of equal ones the first, then that of the smaller period."""
    best = None
    for r in found:  # by start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words of which no run has its second or a later period, joined by single blanks."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def find(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All columns of ``docs``, ``runs`` (by start and period), ``strongest`` (null without runs) and ``collapsed``,
    the text without its repeated periods."""
    place, names = docs.columns.index(text), list(docs.columns)
    taken = {c.lower() for c in names}
    for name in ("runs", "strongest", "collapsed"):
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    kinds = [T.ArrayType(_RUN, False), _RUN, T.StringType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names[-3:], kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([pa.field(n, pa.int64(), nullable=False) for n in ("start", "length", "period")])
        one = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
        for b in batches:
            listed, best, rest = [], [], []
            for t in b.column(place):
                words = (t.as_py() or "").encode().split()
                found = runs(word_ids(words), least, times)
                listed.append([one(r) for r in found])
                best.append(one(strongest(found)))
                rest.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(listed, pa.list_(pa.field("element", kind, nullable=False))), pa.array(best, kind), pa.array(rest, pa.string())], names=names)
            give_back()

    return docs.mapInArrow(run, schema)
