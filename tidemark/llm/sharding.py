"""Rendezvous hashing over weighted shards; DataFrame functions only.

Every shard draws a number for every key, ``-ln(u) / weight`` with a uniform ``u`` hashed from the key and the shard's
name; the least number wins. A shard that is added takes only the keys it wins, all others stay, and each shard gets a
share in proportion to its weight. Equal keys (repeated rows) share a shard; equal texts under different keys are
spread, so no group of copies makes a shard hot. A null key is a key like any other. The text only gives the size, however
long it is, and a null one has none. An empty table gives no rows; ``assign`` keeps all columns, and ``contract`` reads
only the key and the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """A shard's number for a key: exponential with the weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The least ``draw`` for a key, and its ``shard`` (an index of ``weights``)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return F.array_min(F.array(*[F.struct(draw(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return winner(key, weights)["shard"]


def grown(best: Column, key: Column, shards: int, weight: float = 1.0) -> Column:
    """The shard of a key once one more stands beside ``shards``, from its ``winner`` among them: only the new one draws."""
    return F.when(draw(key, shards, weight) < best["draw"], shards).otherwise(best["shard"])


def assign(df: DataFrame, weights: Sequence[float], key: str, out: str = "shard") -> DataFrame:
    """All columns of ``df`` and the row's shard; no shuffle."""
    return df.withColumn(out, shard_of(df[key], weights))


def slots(df: DataFrame, shard: str, key: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    A shard is cut into as many buckets of keys as there are shuffle partitions; rows are numbered within a bucket and
    counts of the buckets before are added, so no task holds a whole shard.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(parts)))
    counts = df.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(key, *order)
    numbered = df.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, [shard, "_bucket"]).withColumn(out, F.col("_start") + F.col("_at")).drop("_bucket", "_start", "_at")


def contract(documents: DataFrame, shards: int = 40) -> DataFrame:
    """The ``key`` law over ``shards`` equal shards, and each row's shard if there were one more."""
    key, text = documents["doc_id"], documents["text"]
    octets = F.octet_length(text)
    rows = documents.select(
        key,
        (F.coalesce(octets, F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        winner(key, [1.0] * shards).alias("_best"),
    )
    best = rows["_best"]
    rows = rows.withColumns({"shard": best["shard"].cast("int"), "grown_shard": grown(best, F.col("doc_id"), shards).cast("int")}).drop("_best")
    return slots(rows, "shard", "doc_id", ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
