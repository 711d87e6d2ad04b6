"""Document quality by a linear-chain conditional random field over lines.

Each line that is not empty has features of its form and of the lines before and after it; a chain with the labels bad
and good is fitted to at most ``SAMPLE`` whole labelled documents (each of a document's lines has its label). The tasks
sum the likelihood and its gradient over the sample, and the driver gets one short row from each for a step. The score
of a document is the mean of its lines' marginal probabilities of good, by forward and backward passes, weighted by
their lengths.

Labels, language, source and id are no features. A text without lines (null, empty, only white space) scores the
sample's share of label 1, as does every text if the sample lacks a label (0.5 without rows). All lines of a very long
text count, in the fit and in its score. Rows that share an id all take part in the fit (an id has one label); repeated
rows score alike; an empty table gives no rows; other columns than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import give_back, pieces, utf8, words
from tidemark.llm.labelled import remainder, sample
from tidemark.shared import stored

#: Labelled documents used at most, and the tasks that they are dealt to.
SAMPLE, TASKS = 4000, 8
THRESHOLD = 0.3
#: Steps of the fit at most, the gradients it remembers, and the weight of the penalty.
STEPS, MEMORY, RIDGE = 40, 8, 1e-3


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_CLASSES = {
    "upper": _table(bytes(range(65, 91))), "lower": _table(bytes(range(97, 123))), "digit": _table(b"0123456789"), "signs": _table(b"#$%&*~^+"), "pipe": _table(b"|"),
    "loud": _table(b"!?"), "stops": _table(b".,;:"), "code": _table(b"{}<>=/\\_@[]()\"'"), "high": _table(bytes(range(128, 256))), "space": _table(b" \t"),
}


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of a column: features of their lines, the lines' lengths, and each text's first line (one more)."""
    raw, at = utf8(column)
    rows, sizes, counts = [], [], []
    for r0, r1 in pieces(raw, at):
        part, cut = raw[at[r0] : at[r1]], at[r0 : r1 + 1] - at[r0]
        n = len(part)
        edges = np.unique(np.concatenate([cut, np.flatnonzero(part == 10), np.flatnonzero(part == 10) + 1]))
        begin, end = edges[:-1], edges[1:]
        blank = np.concatenate([[0], np.cumsum((part > 32).astype(np.int64))])
        real = blank[end] > blank[begin]
        begin, end = begin[real], end[real]
        size = (end - begin).astype(np.float64)
        start, stop, h, _ = words(part, cut)
        w0, w1 = np.searchsorted(start, begin), np.searchsorted(start, end)
        nw = (w1 - w0).astype(np.float64)
        some = np.maximum(nw, 1)
        share = {}
        for name, table in _CLASSES.items():
            total = np.concatenate([[0], np.cumsum(table[part], dtype=np.int64)])
            share[name] = (total[end] - total[begin]).astype(np.float64)
        again = np.concatenate([[0], np.cumsum(np.append(False, h[1:] == h[:-1]).astype(np.int64))]) if len(h) else np.zeros(1, np.int64)
        repeated = np.where(nw > 1, again[w1] - again[np.minimum(w0 + 1, len(h))], 0) / np.maximum(nw - 1, 1)
        line_of = np.repeat(np.arange(len(begin)), w1 - w0)
        key = np.sort((line_of.astype(np.uint64) << np.uint64(44)) | (h[: len(line_of)] >> np.uint64(20))) if len(line_of) == len(h) else np.zeros(0, np.uint64)
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        distinct = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=len(begin))
        letters = np.maximum(share["upper"] + share["lower"], 1)
        own = np.stack([
            np.log1p(nw) / 4, np.minimum(size / some, 30) / 10, share["upper"] / letters, np.minimum(share["signs"] / some, 4), np.minimum(share["pipe"] / some, 2), np.minimum(share["loud"] / some, 4),
            np.minimum(share["stops"] / some, 2), share["digit"] / size, repeated, 1 - distinct / some, np.minimum(share["code"] / some, 4), share["high"] / size, share["space"] / size,
        ], axis=1)
        row = np.searchsorted(cut, begin, "right") - 1
        counts.append(np.bincount(row, minlength=r1 - r0))
        first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
        last = np.append(row[1:] != row[:-1], True) if len(row) else first
        before = np.where(first[:, None], 0.0, np.roll(own, 1, axis=0))
        after = np.where(last[:, None], 0.0, np.roll(own, -1, axis=0))
        rows.append(np.concatenate([own, before[:, 2:10], after[:, 2:10], first[:, None], last[:, None]], axis=1).astype(np.float32))
        sizes.append(size)
    if not rows:
        return np.zeros((0, 31), np.float32), np.zeros(0), np.zeros(len(at), np.int64)
    return np.concatenate(rows), np.concatenate(sizes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good for every line, expected transitions, and the log partition over all documents.

    ``emission``: log weight of good against bad. Documents go together, step by step, longest first.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")  # documents longer than t
    score = np.zeros((len(emission), 2))
    score[:, 1] = emission
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    for t, a in enumerate(active):
        i = begin[:a] + t
        alpha[i] = score[i] if not t else score[i] + np.logaddexp(alpha[i - 1, :1] + transition[0], alpha[i - 1, 1:] + transition[1])
    for t in range(len(active) - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        ahead = score[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
    has = n > 0
    z_doc = np.logaddexp(*alpha[begin[has] + n[has] - 1].T)
    z = np.zeros(len(n))
    z[has] = z_doc
    z_line = np.empty(len(emission))
    back = np.empty(len(n))
    back[order] = z
    z_line[:] = np.repeat(back, np.diff(first))
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z_line, 0))
    inner = np.ones(len(emission), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    j = np.flatnonzero(inner)
    pair = alpha[j - 1][:, :, None] + transition[None] + (score[j] + beta[j])[:, None, :] - z_line[j][:, None, None]
    return good, np.exp(np.minimum(pair, 0)).sum(axis=0) if len(j) else np.zeros((2, 2)), float(z_doc.sum())


@dataclass
class Crf:
    """A chain's weights; small enough to go with the tasks."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    transition: np.ndarray

    def emission(self, f: np.ndarray) -> np.ndarray:
        return ((f - self.mean) / self.scale).astype(np.float64) @ self.w[:-1] + self.w[-1]

    def lines(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(self.emission(f), first, self.transition)[0]

    def likelihood(self, y: np.ndarray, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log likelihood of documents whose lines have the labels ``y``, and its gradient."""
        line_y = np.repeat(y, np.diff(first)).astype(np.float64)
        inner = np.ones(len(f), dtype=bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        observed = np.diag([(line_y[inner] == label).sum() for label in (0, 1)]).astype(np.float64)
        emission = self.emission(f)
        good, pairs, z = marginals(emission, first, self.transition)
        value = emission @ line_y + (observed * self.transition).sum() - z
        x = (f - self.mean) / self.scale
        return np.concatenate([[value], x.T @ (line_y - good), [(line_y - good).sum()], (observed - pairs).ravel()])

    def at(self, theta: np.ndarray) -> Crf:
        return Crf(self.mean, self.scale, theta[:-4], theta[-4:].reshape(2, 2))


def maximum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray) -> np.ndarray:
    """The maximum of a concave function from its values and gradients (limited-memory quasi-Newton steps)."""
    x = start
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        q, back = g.copy(), []
        for s, y in reversed(past):
            back.append((s @ q) / (s @ y))
            q -= back[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).max()))
        for (s, y), a in zip(past, reversed(back), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        while True:
            new, its = f(x + step * q)
            if new >= value + 1e-4 * step * (g @ q) or step < 1e-4:
                break
            step /= 4
        if new <= value:
            break
        s, y = step * q, g - its
        if s @ y > 1e-12:
            past = [*past, (s, y)][-MEMORY:]
        x, gain, value, g = x + s, new - value, new, its
        if gain < 1e-7 * abs(value) or np.abs(g).max() < 1e-5:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most: int = SAMPLE) -> tuple[Crf | None, float]:
    """A chain and the sample's share of label 1; no chain if it lacks a label. ``docs`` has ``id`` and ``t``."""
    rows = stored(sample(docs, labels, label, usable, most).select("id", "y", "t").repartition(TASKS, "id").sortWithinPartitions("id", "t"))
    n, ones = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return None, ones / n if n else 0.5

    def summed(of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f, _, first = line_features(b.column(2))
                yield pa.RecordBatch.from_arrays([pa.array([of(b.column(1).to_numpy(), f, first).tobytes()], pa.binary())], names=["v"])

        return np.sum([np.frombuffer(r.v) for r in rows.mapInArrow(run, "v binary").collect()], axis=0)

    moments = summed(lambda _, f, __: np.stack([np.full(f.shape[1], float(len(f))), f.sum(axis=0, dtype=np.float64), (f.astype(np.float64) ** 2).sum(axis=0)]))
    lines, total, squares = moments.reshape(3, -1)
    mean = total / np.maximum(lines, 1)
    plain = Crf(mean, np.sqrt(np.maximum(squares / np.maximum(lines, 1) - mean**2, 0)) + 1e-3, np.zeros(0), np.zeros((2, 2)))

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        got = summed(plain.at(theta).likelihood) / n
        return float(got[0] - RIDGE / 2 * theta @ theta), got[1:] - RIDGE * theta

    return plain.at(maximum(value, np.zeros(len(mean) + 5))), ones / n


def score(docs: DataFrame, model: Crf | None, share: float) -> DataFrame:
    """``id`` and ``score`` of rows with ``id`` and ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, share)
            if model is not None:
                f, size, first = line_features(b.column(1))
                good = np.concatenate([[0.0], np.cumsum(model.lines(f, first) * size)])
                total = np.concatenate([[0.0], np.cumsum(size)])
                weight = total[first[1:]] - total[first[:-1]]
                has = weight > 0
                out[has] = np.clip((good[first[1:]] - good[first[:-1]])[has] / weight[has], 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["id", "score"])
            give_back()

    return docs.select("id", "t").mapInArrow(run, "id long, score double")


def contract(documents: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"))
    model, share = fit(docs, labels, remainder(F.col("id"), modulus) != held_out)
    return score(docs, model, share).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), modulus) == held_out).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
