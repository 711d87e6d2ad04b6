"""The corpus pipeline: five operators over all documents, each on what the one before it kept.

1. toxicity: documents that the calibrated trees score at the threshold or above go;
2. near-duplicates: one document of each class stays (the one with the least id);
3. suffix arrays: bytes of 50-byte strings that also start in a document with a smaller id are cut out;
4. decontamination: documents that hold a window of the benchmark go;
5. byte-pair encoding: each text gets its token ids, and the text that they decode to.

Null texts stay null through the filters and have no tokens; an empty table gives no rows; a document whose text was
cut to nothing stays, with an empty text. There is no SQL for the trees and the suffix arrays' parts, so the tests hold
the result against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, minhash, suffix_dedup, toxicity
from tidemark.llm.labelled import remainder
from tidemark.llm.queries import table, vocabulary
from tidemark.shared import stored
from tidemark.shipping import ship

#: No SQL expresses boosted trees.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), remainder(F.col("id"), 4) != 2)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.clean(docs).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, ``ids`` and ``decoded``."""
    ship(spark)
    path = vocabulary("word_bpe_49k.json")
    return bpe.encode(docs, path, decoded="decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
