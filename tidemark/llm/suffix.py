"""Suffix arrays by induced sorting, on whole arrays at once, and their permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Letters up to which buckets are worked off one by one; with more of them, all buckets go together, round by round.
FEW_LETTERS = 512


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last letter is a unique least sentinel."""
    n = len(t)
    small = np.zeros(n, dtype=bool)
    small[:-1] = t[:-1] < t[1:]
    # In a run of equal letters all suffixes have the type of the run's last.
    last = np.append(t[:-1] != t[1:], True)
    run = np.cumsum(last) - last
    small = small[np.flatnonzero(last)[run]]
    small[-1] = True
    return small


def _induce_by_bucket(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones (``seeds``) in theirs.

    Larger suffixes are induced from left to right, smaller ones from right to left. Buckets are worked off one by
    one, each in waves: what a wave puts into its own bucket is the next wave.
    """
    n = len(t)
    sa = np.full(n, -1, dtype=np.int32)
    counts = np.bincount(t, minlength=letters)
    end = np.cumsum(counts)
    begin = end - counts
    present = np.flatnonzero(counts)
    seed_letter = t[seeds]
    seed_end = np.searchsorted(seed_letter, present, "right")
    seed_begin = np.searchsorted(seed_letter, present, "left")

    def put(pred: np.ndarray, head: np.ndarray, step: int) -> None:
        letter = t[pred]
        order = np.argsort(letter, kind="stable")
        letter = letter[order]
        where = np.flatnonzero(np.append(True, letter[1:] != letter[:-1]))
        size = np.diff(np.append(where, len(letter)))
        rank = np.arange(len(letter)) - np.repeat(where, size)
        sa[head[letter] + step * rank] = pred[order]
        head[letter[where]] += step * size

    head = begin.copy()
    for b, c in enumerate(present):
        done = begin[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            pred = wave[wave > 0] - 1
            if len(pred := pred[~small[pred]]):
                put(pred, head, 1)
        wave = seeds[seed_begin[b] : seed_end[b]]
        if len(pred := wave[wave > 0] - 1):
            put(pred, head, 1)
    large_end = head
    tail = end - 1
    for c in present[::-1]:
        done = end[c] - 1
        while done > tail[c]:
            wave = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            pred = wave[wave > 0] - 1
            if len(pred := pred[small[pred]]):
                put(pred, tail, -1)
        wave = sa[begin[c] : large_end[c]][::-1]
        pred = wave[wave > 0] - 1
        if len(pred := pred[small[pred]]):
            put(pred, tail, -1)
    sa[0] = n - 1
    return sa


def _settle(rank: np.ndarray, open_: np.ndarray) -> None:
    """Give the suffixes ``open_`` their places. Each has the first place of its bucket's part as its rank, and the
    suffix after it is open as well or has its final place; a round orders those that share a rank by the ranks of the
    suffixes after them, in all buckets at once. Every chain of open suffixes ends at a settled one, so as many rounds
    are needed as the longest chain is long, over fewer and fewer suffixes."""
    n = np.int64(len(rank))
    while len(open_):
        key = rank[open_] * n + rank[open_ + 1]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        own = key // n
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        bucket = np.repeat(first, np.diff(np.append(first, len(key))))
        size = np.diff(np.append(starts, len(key)))
        place = own[starts] + starts - bucket[starts]
        rank[open_] = np.repeat(place, size)
        open_ = open_[np.repeat(size > 1, size)]


def _induce_by_round(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """The same for many letters: most buckets are tiny, so all of them take a step together."""
    n = len(t)
    counts = np.bincount(t, minlength=letters)
    begin = np.cumsum(counts) - counts
    large = np.flatnonzero(~small)
    middle = begin + np.bincount(t[large], minlength=letters)
    rank = np.empty(n, np.int64)
    rank[large] = begin[t[large]]
    letter = t[seeds]
    rank[seeds] = middle[letter] + np.arange(len(seeds)) - np.searchsorted(letter, letter, "left")
    _settle(rank, large)
    less = np.flatnonzero(small[:-1])
    rank[less] = middle[t[less]]
    rank[n - 1] = 0
    _settle(rank, less)
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    return sa


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array of ``t``, integers below ``letters`` that end with a single 0."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    induce = _induce_by_bucket if letters <= FEW_LETTERS else _induce_by_round
    small = _types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    sa = induce(t, small, lms[np.argsort(t[lms], kind="stable")], letters)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    sorted_lms = sa[is_lms[sa]]
    # A substring runs to the next leftmost-smaller place, both included.
    size = np.zeros(n, dtype=np.int32)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = sorted_lms[:-1], sorted_lms[1:]
    unlike = size[a] != size[b]
    open_ = np.flatnonzero(~unlike)
    at = 0
    while len(open_):
        bad = t[a[open_] + at] != t[b[open_] + at]
        unlike[open_[bad]] = True
        at += 1
        open_ = open_[~bad & (at < size[a[open_]])]
    name = np.empty(n, dtype=np.int32)
    name[sorted_lms] = np.cumsum(np.append(0, unlike))
    reduced = name[lms]
    del sa, is_lms, size, name, a, b
    if len(lms) and (most := int(reduced.max())) < len(lms) - 1:
        sorted_lms = lms[suffix_array(reduced, most + 1)]
    return induce(t, small, sorted_lms, letters)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it in ``sa`` order, up to ``most``, by text position.

    Along the text a common prefix is one less than the one before it where the letters before both are equal, so only
    the other (irreducible) places are compared.
    """
    n = len(t)
    phi = np.full(n, -1, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    reducible = np.zeros(n, dtype=bool)
    if n > 1:
        p = phi[1:]
        # phi[i] is the place after phi[i - 1] exactly where the letters before are equal and the order carries over.
        reducible[1:] = (p > 0) & (phi[:-1] >= 0) & (p == phi[:-1] + 1) & (t[np.maximum(p, 1) - 1] == t[: n - 1])
    starts = np.flatnonzero(~reducible).astype(np.int32)
    length = np.zeros(len(starts), dtype=np.int32)
    open_ = np.flatnonzero(phi[starts] >= 0)
    # A prefix must be known as far as the reducible places after it reach.
    full = most + np.diff(np.append(starts, n)) - 1
    at = 0
    while len(open_):
        x, y = starts[open_] + at, phi[starts[open_]] + at
        inside = (x < n) & (y < n) & (at < full[open_])
        open_ = open_[inside & (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)])]
        length[open_] += 1
        at += 1
    source = np.cumsum(~reducible) - 1
    return np.clip(length[source] - (np.arange(n) - starts[source]), 0, most)
