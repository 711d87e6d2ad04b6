"""Contract checks, quarantine, and the gate that lets outputs be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules whose condition does not hold (null counts as broken)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that is broken; null if none is."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])


def split(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with ``reason``."""
    marked = df.withColumn("reason", first_reason(rules))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def holder_count(positions: DataFrame, members: DataFrame, tiers: DataFrame) -> DataFrame:
    """One row: distinct members with a current position of tier 1; a member that the roster lacks counts as active."""
    rows = positions.where("status <> 'sold'").join(tiers.where("tier = 1"), "security", "left_semi")
    rows = rows.join(members.select("member", "active"), "member", "left").where(F.coalesce("active", F.lit(True)))
    return rows.select("member").distinct().groupBy().agg(F.count(F.lit(1)).alias("holders"))


def within_bound(counted: DataFrame, least: int, most: int) -> DataFrame:
    return counted.withColumn("failure", F.when(F.col("holders") < least, "too few").when(F.col("holders") > most, "too many"))


def check_pins(pins: DataFrame, positions: DataFrame) -> DataFrame:
    """``pin``, ``member``, ``security``, ``expected`` and ``ok``: whether a pinned position is held, or absent, as
    expected, and its band meets the pinned one."""
    live = positions.where("status <> 'sold'").groupBy("member", "security").agg(F.min_by(F.struct("lo", "hi"), "owner").alias("p"))
    found = pins.join(live, ["member", "security"], "left")
    meets = (F.col("p.lo") <= F.col("pin_hi")) & (F.col("p.hi") >= F.col("pin_lo"))
    ok = F.when(F.col("expected"), F.col("p").isNotNull() & F.coalesce(meets, F.lit(False))).otherwise(F.col("p").isNull())
    return found.select("pin", "member", "security", "expected", ok.alias("ok"))


def check_owners(pins: DataFrame, positions: DataFrame) -> DataFrame:
    """``pin`` and ``ok``: whether the first current position (by owner) of a pinned security has the pinned owner."""
    live = positions.where("status <> 'sold'").groupBy("member", "security").agg(F.min("owner").alias("_owner"))
    return pins.join(live, ["member", "security"], "left").select("pin", F.coalesce(F.col("_owner") == F.col("pin_owner"), F.lit(False)).alias("ok"))


def check_inactive(pins: DataFrame, members: DataFrame) -> DataFrame:
    """``pin`` and ``ok``: whether a member has left; one that the roster lacks counts as gone."""
    return pins.join(members.select("member", "active"), "member", "left").select("pin", (~F.coalesce("active", F.lit(False))).alias("ok"))
