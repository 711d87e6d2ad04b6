"""Aggregates over positions and trades: common holdings, directories, attribution, ranks and the views' figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.views import owners_in_order
from tidemark.shared import stored

PARTIES = ("R", "D", "I")


def owners(positions: DataFrame) -> DataFrame:
    """One row for each security and member: sums over current rows, or over all if none is current."""
    current = F.col("status") != "sold"
    some = F.count_if(current) > 0
    pick = lambda c: F.when(some, F.sum(F.when(current, F.col(c)))).otherwise(F.sum(c))
    status = F.when(~some, "sold").when(F.bool_or(F.col("status") == "holds"), "holds").otherwise("stale")
    return positions.groupBy("security", "member").agg(pick("lo").alias("lo"), pick("hi").alias("hi"), status.alias("status"))


def common_holdings(positions: DataFrame, members: DataFrame, buys: DataFrame, least: int = 2) -> DataFrame:
    """Securities that at least ``least`` members hold now: owners, party split and the latest purchase of any owner,
    those that have sold among them.

    ``members``: ``member, party``; ``buys``: ``member, security, traded``. Sums are made per security and member
    first, so a security that everyone holds reaches the last step as one row for each member.
    """
    bought = buys.groupBy("security", "member").agg(F.max("traded").alias("bought"))
    each = owners(positions).join(members.select("member", "party"), "member").join(bought, ["security", "member"], "left")
    now = F.col("status") != "sold"
    split = [F.count_if(now & (F.col("party") == p)).alias(f"party_{p.lower()}") for p in PARTIES]
    out = each.groupBy("security").agg(F.count_if(now).alias("owners"), *split, F.max("bought").alias("latest_buy"), F.sum(F.when(now, F.col("lo"))).alias("lo"), F.sum(F.when(now, F.col("hi"))).alias("hi"))
    return out.where(F.col("owners") >= least)


def common_documents(positions: DataFrame, members: DataFrame, buys: DataFrame, least: int = 2, names: DataFrame | None = None) -> DataFrame:
    """The same with all owners inside: ``security, name, owners_count``, the party split, ``latest_buy`` and ``owners``
    (``member, name, party, chamber, state, active, buy_dates, lo, hi, status``, the current ones first, then by the
    latest purchase, then by name). A security's owners are members, so the array is bounded by the roster."""
    each = owners(positions).join(members.select("member", "name", "party", "chamber", "state", "active"), "member").join(newest_dates(buys), ["security", "member"], "left")
    dates = F.coalesce("dates", F.array().cast("array<date>"))
    owner = F.struct("member", "name", "party", "chamber", "state", "active", dates.alias("buy_dates"), "lo", "hi", "status", F.get(dates, F.lit(0)).alias("latest_buy"))
    split = [F.count_if((F.col("status") != "sold") & (F.col("party") == p)).alias(f"party_{p.lower()}") for p in PARTIES]
    out = each.groupBy("security").agg(F.count_if(F.col("status") != "sold").alias("owners_count"), *split, F.max(F.get(dates, F.lit(0))).alias("latest_buy"), owners_in_order(F.collect_list(owner)).alias("owners"))
    out = out.where(F.col("owners_count") >= least).withColumn("owners", F.transform("owners", lambda o: o.dropFields("latest_buy")))
    return out.join(names.select("security", "name"), "security", "left") if names is not None else out


def documents(trades: DataFrame, positions: DataFrame, members: DataFrame, measured: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A document for each member with trades: the member, its positions, its trades (the newest first), their series and
    its measured return; and the members of trades that the roster lacks, with their number of trades. A document holds
    one member's trades, so it is a row; members are dealt to tasks.

    ``trades``: ``member, asset, security, side, owner, lo, hi, traded, filed, ord``."""
    row = F.struct((-F.unix_date("traded")).alias("_a"), (-F.unix_date("filed")).alias("_b"), "ord", "asset", "security", "side", "owner", "lo", "hi", "traded", "filed")
    own = trades.groupBy("member").agg(F.array_sort(F.collect_list(row)).alias("trades"), F.count(F.lit(1)).alias("trade_count"), F.max("traded").alias("last_trade"))
    own = own.withColumn("trades", F.transform("trades", lambda t: t.dropFields("_a", "_b")))
    by_date = F.array_sort(F.transform("trades", lambda t: F.struct(t["traded"].alias("date"), t["ord"].alias("ord"), ((t["lo"] + t["hi"]) / 2).alias("value"))))
    held = positions.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("security", "owner", "status", "lo", "hi", "as_of"))).alias("positions"))
    none = F.array().cast(held.schema["positions"].dataType)
    out = own.join(members, "member").join(held, "member", "left").withColumns({"positions": F.coalesce("positions", none), "series": F.transform(by_date, lambda p: F.struct(p["date"].alias("date"), p["value"].alias("value")))})
    out = out.join(measured, "member", "left") if measured is not None else out
    return out, own.join(members.select("member"), "member", "left_anti").select("member", "trade_count")


def newest_dates(buys: DataFrame, most: int = 10) -> DataFrame:
    """The newest purchase dates of each security and member, repeated ones kept."""
    days = buys.groupBy("security", "member", "traded").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("security", "member").orderBy(F.desc("traded"))
    near = days.withColumn("_before", F.sum("n").over(w) - F.col("n")).where(F.col("_before") < most)
    kept = near.select("security", "member", "traded", F.explode(F.array_repeat(F.lit(0), F.least(F.col("n"), most - F.col("_before")).cast("int"))))
    return kept.groupBy("security", "member").agg(F.sort_array(F.collect_list("traded"), asc=False).alias("dates"))


def attribution(trades: DataFrame, unknown: str = "self (owner not stated in filings)") -> DataFrame:
    """Who traded for each member: owners by count, then name, joined by " + "; a fixed text where no filing says."""
    counts = trades.groupBy("member", "owner").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.col("owner").isNotNull(), F.struct((-F.col("n")).alias("n"), "owner"))))
    joined = F.array_join(F.transform(listed, lambda x: x["owner"]), " + ")
    return counts.groupBy("member").agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(unknown)).alias("attribution"))


def directory(trades: DataFrame, members: DataFrame, traders: DataFrame | None = None) -> DataFrame:
    """Members with trades: count and last date; whether each is among the traders that are followed, if these are given."""
    rows = trades.groupBy("member").agg(F.count(F.lit(1)).alias("trades"), F.max("traded").alias("last_trade")).join(members, "member")
    if traders is None:
        return rows
    return rows.join(traders.select("member", F.lit(True).alias("_followed")).distinct(), "member", "left").withColumn("on_roster", F.coalesce("_followed", F.lit(False))).drop("_followed")


def filter_directory(entries: DataFrame, parties: tuple[str, ...] = (), active_only: bool = False, query: str = "") -> DataFrame:
    """Any party if none is named; the query is part of a name or a whole state, whatever the case."""
    if parties:
        entries = entries.where(F.col("party").isin(*parties))
    if active_only:
        entries = entries.where("active")
    if query := query.strip().lower():
        entries = entries.where(F.contains(F.lower("name"), F.lit(query)) | (F.lower("state") == query))
    return entries


def ranked(df: DataFrame, order: list[Column], out: str = "rank", key: list[str] | None = None) -> DataFrame:
    """Positions without shared ranks. Without a key, rows are ranked by range partitions: each counts its own rows and
    adds the counts of the partitions before, so no task sees them all. The numbered partitions are stored first, since
    ranges are sampled anew whenever they are computed."""
    if key:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    local = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return local.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def newest_distinct(items: DataFrame, key: str, date: str, ord: str, most: int = 6) -> DataFrame:
    """The first row of each key; of those the newest, at most ``most``."""
    first = items.groupBy(key).agg(F.min_by(F.struct(*items.columns), ord).alias("r")).select("r.*")
    return first.orderBy(F.desc(date), ord).limit(most)


def stage_strip(done: DataFrame, key: str, stages: tuple[str, ...]) -> DataFrame:
    """``key, position, stage, date, state`` for each stage: done, the first other one is current, the rest pending.
    ``done`` has a date column for each stage."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("stage"), F.col(s).alias("date")) for i, s in enumerate(stages)])
    first = F.coalesce(*[F.when(F.col(s).isNull(), i + 1) for i, s in enumerate(stages)], F.lit(0))
    rows = done.select(key, first.alias("_first"), F.explode(cells).alias("c")).select(key, "_first", "c.*")
    return rows.withColumn("state", F.when(F.col("date").isNotNull(), "done").when(F.col("position") == F.col("_first"), "current").otherwise("pending")).drop("_first")
