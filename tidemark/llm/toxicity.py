"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of words of a fixed lexicon and of one learned from labelled rows (all words
far more frequent in toxic texts), how close such words stand to a second-person word, capitals, punctuation, and words
disguised by digits or signs. The labelled sample has at most ``SAMPLE`` rows; a hash of the id gives half of it to the
lexicon, three tenths to the trees and a fifth to the calibration, so that none judges what another has learned by heart.

Labels, language, source and id are no features. Null and empty texts have all features 0 and get a score like others;
of a very long text every word counts. Without both labels in the sample every score is the share of label 1 (0 without
rows). Repeated rows score alike; an empty table gives no rows; other columns are kept by ``reject`` whatever their
names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import give_back
from tidemark.llm.labelled import remainder, sample
from tidemark.shared import stored

#: Labelled rows used at most. A word of the learned lexicon is in three toxic texts of the sample at least, and in one
#: of 200, so the sample bounds the lexicon.
SAMPLE, LEAST_TEXTS, LEAST_SHARE = 20_000, 3, 200
THRESHOLD = 0.3
#: Insults in general use in English, German, French and Spanish; the learned lexicon adds those of the corpus.
INSULTS = frozenset((
    "idiot idiots moron morons stupid dumb trash garbage scum loser losers clown pathetic worthless disgusting fool imbecile cretin bastard jerk creep vermin filth filthy "
    "dumm dummkopf trottel idioten abschaum versager dreck dreckig widerlich erbärmlich wertlos nichtsnutz "
    "imbécile crétin débile ordure salaud connard minable pathétique dégoûtant "
    "tonto estúpido estúpida imbécil basura escoria payaso patético asqueroso inútil"
).split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus".split())
_NEAR = 5
_WORD = re.compile(r"\w+")
_DISGUISED = re.compile(r"[^\W\d_]+(?:[@$*!|0-9.\-_]+[^\W\d_]+)+|[@$][^\W\d_]{2,}")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "*": None, ".": None, "-": None, "_": None})
_MARKS = re.compile(r"[!?]{2,}")
N_FEATURES = 17
#: Which code points are capitals, up to Cyrillic; letters beyond count as small.
_CAPITAL = np.array([chr(i).isupper() for i in range(0x600)] + [False])


def capitals(text: str) -> int:
    return int(_CAPITAL[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 0x600)].sum())


def features(text: str, learned: dict[str, float]) -> list[float]:
    """The dense features of one whole text."""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    own = [i for i, w in enumerate(words) if w in learned]
    weights = [learned[words[i]] for i in own]
    close = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - _NEAR) : i + _NEAR + 1]) for i in {*fixed, *own})
    disguised = hidden = 0
    if not low.isalnum():
        for m in _DISGUISED.findall(low):
            disguised += any(c in "@$*!|0123456789" for c in m)
            plain = m.translate(_PLAIN)
            hidden += m not in INSULTS and (plain in INSULTS or plain in learned)
    letters = max(1, sum(map(len, words)))
    marks = text.count("!") + text.count("?")
    return [
        len(fixed), len(fixed) / n, len(own), len(own) / n, sum(weights), max(weights, default=0.0), sum(weights) / n, float(len({words[i] for i in own})),
        close, close / n, capitals(text) / letters, marks / n, len(_MARKS.findall(text)) / n, (text.count(".") + text.count(",")) / n, disguised / n, hidden, log1p(n),
    ]


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """Words of the rows ``t``, ``y`` that are at least eight times as frequent among toxic texts, with the log of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, other = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y else other).update(set(_WORD.findall((t or "").lower())))
            words = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([other[w] for w in words], pa.int64())], names=["w", "p", "q"])

    size = rows.groupBy().agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).first()
    if not size.p or not size.q:
        return {}
    words = rows.select("t", "y").mapInArrow(run, "w string, p long, q long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    odds = F.ln((F.col("p") / size.p) / ((F.col("q") + 0.5) / (size.q + 1)))
    found = words.where(F.col("p") >= max(LEAST_TEXTS, size.p // LEAST_SHARE)).withColumn("odds", odds).where(F.col("odds") > log(8.0))
    return {r.w: float(r.odds) for r in found.collect()}


def featured(text: Column, learned: dict[str, float]) -> Column:
    """The features of a text column. Only the text goes to Python, and only the features come back."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([features(t.as_py() or "", learned) for t in b], pa.list_(pa.float64()))
            give_back()

    return F.arrow_udf(run, "array<double>").asNondeterministic()(text)  # so that no plan evaluates it twice


@dataclass
class Toxicity:
    """A fitted scorer; without both labels in the sample, its share of label 1 is every score."""

    share: float
    learned: dict[str, float]
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None

    def probability(self, df: DataFrame) -> DataFrame:
        """``p``, the trees' probability, in place of the features ``f``."""
        made = self.trees.transform(df.withColumn("x", array_to_vector("f")).drop("f"))
        return made.withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")

    def score(self, df: DataFrame) -> DataFrame:
        """Rows with a text ``t``, with ``score`` in its place."""
        if self.trees is None:
            return df.drop("t").withColumn("score", F.lit(self.share))
        made = self.curve.transform(self.probability(df.withColumn("f", featured(F.col("t"), self.learned)).drop("t")))
        # A thousandth of the trees' own probability keeps their order on the calibration's steps.
        calibrated = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("prediction") + 0.001 * F.col("p")))
        return made.withColumn("score", calibrated).drop("p", "prediction")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = SAMPLE) -> Toxicity:
    """``docs`` has ``id`` and ``t``; only labels of rows for which ``usable`` (a condition on ``id``) holds are read."""
    rows = stored(sample(docs, labels, label, usable, most).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("id")), F.lit(10))))
    learned = _lexicon(rows.where("fold < 5"))
    known = stored(rows.select("y", "fold", featured(F.col("t"), learned).alias("f"))).withColumn("y", F.col("y").cast("double"))
    seen = {r.y for r in known.where("fold between 5 and 7").select("y").distinct().collect()}
    model = Toxicity(float(rows.agg(F.avg("y")).first()[0] or 0.0), learned)
    if len(seen) == 2 and known.where("fold >= 8").limit(1).count():
        grower = GBTClassifier(featuresCol="x", labelCol="y", maxDepth=4, maxIter=15, stepSize=0.3, subsamplingRate=1.0, seed=7, cacheNodeIds=False)
        model.trees = grower.fit(known.where("fold between 5 and 7").withColumn("x", array_to_vector("f")).coalesce(4))
        model.curve = IsotonicRegression(featuresCol="p", labelCol="y").fit(model.probability(known.where("fold >= 8").coalesce(1)).select("p", "y"))
    return model


def contract(documents: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"))
    model = train(docs, labels, remainder(F.col("id"), modulus) != held_out)
    return model.score(docs).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), modulus) == held_out).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*names)
    k, x = (names[docs.columns.index(c)] for c in (key, text))
    model = train(named.select(F.col(k).cast("long").alias("id"), F.col(x).alias("t")), labels, usable)
    return model.score(named.withColumn("t", F.col(x))).where(F.col("score") < threshold).select(*names).toDF(*docs.columns)
