"""Bounded, reproducible samples of labelled rows for models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo a number."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """``id``, ``t`` (text) and ``y`` of at most ``most`` labelled documents, chosen by a hash of the id.

    ``docs`` has ``id`` and ``t``; ``usable`` is a condition on ``id``. The chosen labels have a proven bound
    (``most`` rows of two numbers), so they are broadcast. Null labels and ids are left out.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(usable)
    chosen = marked.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.join(F.broadcast(chosen), "id")
