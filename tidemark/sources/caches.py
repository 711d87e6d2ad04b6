"""Landed copies of fetched documents: which ones are due, what is kept of a fetch, and what serves meanwhile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.resolve import first_by
from tidemark.shared import stored
from tidemark.sources.landing import exists

COPY = "name string, body string, landed timestamp"
#: Hours for which a copy is fresh.
FRESH = 20


def is_json(body: Column) -> Column:
    """The reason why a body is no JSON document; null if it is one."""
    return F.when(body.isNull() | (F.trim(body) == ""), "an empty answer").when(F.try_parse_json(body).isNull(), "no JSON")


def land(fetched: DataFrame, folder: str, at: Column, fault: Callable[[Column], Column] = is_json) -> DataFrame:
    """Keep the sound ones of fetched bodies (``name, body``) as copies landed ``at`` a time, and give the others back with
    ``reason``. A body is checked before it is written, so a broken answer never takes a good copy's place; of several
    bodies of a name all are kept, and one serves (``serving``)."""
    read = stored(fetched.select("name", "body").withColumn("reason", fault(F.col("body"))))
    read.where("reason is null").select("name", "body", at.cast("timestamp").alias("landed")).write.mode("append").parquet(folder)
    return read.where("reason is not null").select("name", "reason")


def copies(spark: SparkSession, folder: str) -> DataFrame:
    """All landed copies; none before the first."""
    return spark.read.schema(COPY).parquet(folder) if exists(spark, f"{folder}/*.parquet") else spark.createDataFrame([], COPY)


def serving(landed: DataFrame, now: Column, hours: int = FRESH) -> DataFrame:
    """The copy of each name that serves: the newest one, however old, since a stale copy is better than none; ``fresh``
    says whether it still is."""
    newest = first_by(landed, ["name"], [F.desc("landed"), F.col("body")])
    return newest.withColumn("fresh", F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("landed") <= hours * 3600)


def due(wanted: DataFrame, landed: DataFrame, now: Column, hours: int = FRESH) -> DataFrame:
    """The distinct names of ``wanted`` (``name``) that have no fresh copy: what a run fetches, each once, however many
    rows ask for it. Rows without a name ask for nothing."""
    fresh = serving(landed, now, hours).where("fresh").select("name")
    return wanted.where("name is not null").select("name").distinct().join(fresh, "name", "left_anti")


def charts_due(buys: DataFrame, landed: DataFrame, now: Column, benchmark: str = "SPY", hours: int = FRESH) -> DataFrame:
    """The price charts that a run needs: one for each distinct symbol of the purchases (``ticker``; options have none,
    ``options``), and the benchmark's, if any purchase needs one."""
    symbols = buys.where(~F.coalesce("options", F.lit(False)) & F.col("ticker").isNotNull()).select(F.upper(F.trim("ticker")).alias("name")).where("name <> ''").distinct()
    market = symbols.limit(1).select(F.lit(benchmark).alias("name"))
    return due(symbols.unionByName(market), landed, now, hours)


def both(recent: DataFrame, histories: DataFrame, key: str = "id") -> DataFrame:
    """The third party's recent rows and its per-filer histories as one input, in that order: ``ord`` counts on from one
    to the other, so of a row that both have the recent one is first. Columns that only one of them has are null."""
    one = recent.withColumns({"_from": F.lit(0), "ord": F.monotonically_increasing_id()})
    other = histories.withColumns({"_from": F.lit(1), "ord": F.monotonically_increasing_id()})
    rows = one.unionByName(other, allowMissingColumns=True)
    # 2^60 rows of the one come before the first of the other.
    return rows.withColumn("ord", F.col("ord") + F.shiftleft(F.col("_from").cast("long"), 60)).drop("_from").where(F.col(key).isNotNull())
