"""Prices as of a date, returns against a benchmark, and weighted means."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import simple_return_pct


def asof_forward(left: DataFrame, prices: DataFrame, on: str | None, date: str) -> DataFrame:
    """All rows of ``left`` with ``entry_date`` and ``entry``: the first close on or after the row's date, or nulls.

    ``prices``: ``on, date, close`` (without ``on``, one series for all rows). The distinct days that are asked for and
    the prices go, month by month, through one ordered pass; where a month has no later price, the first price of the
    next month that has one is carried back. So no window spans a symbol's whole history, however many rows it has.
    """
    key = [on] if on else []
    price = F.struct(F.col("date").alias("p_date"), F.col("close").alias("p_close"))
    p = prices.where("date is not null").select(*key, F.col("date").alias("_day"), price.alias("_price"))
    asked = left.where(F.col(date).isNotNull()).select(*key, F.col(date).alias("_day")).distinct()
    both = asked.withColumn("_price", F.lit(None).cast(p.schema["_price"].dataType)).unionByName(p).withColumn("_month", F.trunc("_day", "month"))
    back = Window.partitionBy(*key, "_month").orderBy(F.desc("_day"), F.col("_price").isNull())
    near = both.withColumn("_near", F.last("_price", ignorenulls=True).over(back)).where("_price is null").select(*key, "_month", "_day", "_near")
    months = both.groupBy(*key, "_month").agg(F.min("_price").alias("_first"))
    later = Window.partitionBy(*key).orderBy("_month").rowsBetween(1, Window.unboundedFollowing)
    carried = months.select(*key, "_month", F.first("_first", ignorenulls=True).over(later).alias("_next"))
    found = near.join(carried, [*key, "_month"]).select(*key, F.col("_day").alias(date), F.coalesce("_near", "_next").alias("_hit"))
    return left.join(found, [*key, date], "left").select(*left.columns, F.col("_hit.p_date").alias("entry_date"), F.col("_hit.p_close").alias("entry"))


def exact_snapshot(left: DataFrame, snapshots: Sequence[DataFrame], on: str, date: str) -> DataFrame:
    """All rows of ``left`` with ``entry``: the close of the very date in the first of the snapshots (each ``on, date,
    close``) that has one, else null."""
    ranked = [s.select(on, F.col("date").alias(date), F.col("close").alias("_close"), F.lit(i).alias("_nth")) for i, s in enumerate(snapshots)]
    known = reduce(DataFrame.unionByName, ranked).where("_close is not null")
    return left.join(known.groupBy(on, date).agg(F.min_by("_close", "_nth").alias("entry")), [on, date], "left")


def price_chain(providers: dict[str, Column]) -> Column:
    """``close`` and ``source`` of the first provider (a column of closes by name) that answers; ``failure`` names all of
    them if none does."""
    source = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in providers.items()])
    failure = F.when(source.isNull(), "no price from " + ", ".join(providers))
    return F.struct(F.coalesce(*providers.values()).alias("close"), source.alias("source"), failure.alias("failure"))


def latest_close(prices: DataFrame, on: str) -> DataFrame:
    return prices.groupBy(on).agg(F.max_by("close", "date").alias("latest"))


def returns(buys: DataFrame, prices: DataFrame, benchmark: DataFrame, on: str, date: str) -> DataFrame:
    """All buys with ``ret`` and ``excess`` over the benchmark in the same window (null where a price lacks). The
    benchmark's return is made once for each day and joined by it; there are as many days as the calendar has."""
    rows = asof_forward(buys, prices, on, date).join(latest_close(prices, on), on, "left").withColumn("ret", simple_return_pct(F.col("entry"), F.col("latest"))).drop("entry", "entry_date", "latest")
    days = asof_forward(buys.select(date).distinct(), benchmark, None, date)
    last = benchmark.groupBy().agg(F.max_by("close", "date").alias("latest"))
    gains = days.join(F.broadcast(last), how="cross").select(date, simple_return_pct(F.col("entry"), F.col("latest")).alias("_market"))
    return rows.join(gains, date, "left").withColumn("excess", F.col("ret") - F.col("_market")).drop("_market")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over the rows that have a value, with their own weight; null without weight."""
    return F.try_divide(F.sum(F.when(value.isNotNull(), weight * value)), F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0)))
