"""What the site shows: holdings with their members and tiers, columns by party, votes, and the orders of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENT = "status <> 'sold'"


def model(holdings: DataFrame, members: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings whose member is on the roster and that have a filing, with the member's columns, ``tier`` (2 if the
    universe lacks the security) and ``filing_url``; and the others, to be counted."""
    filing = F.get(F.filter("sources", lambda s: s["kind"] == "filing"), F.lit(0))["url"]
    rows = holdings.withColumn("filing_url", filing).join(members.withColumn("_known", F.lit(True)), "member", "left").join(universe.select("security", F.col("tier").alias("_tier")), "security", "left")
    sound = F.coalesce("_known", F.lit(False)) & F.col("filing_url").isNotNull()
    rows = rows.withColumn("tier", F.coalesce("_tier", F.lit(2))).withColumn("_sound", sound).drop("_tier", "_known")
    return rows.where("_sound").drop("_sound"), rows.where("not _sound").drop("_sound")


def tier_columns(rows: DataFrame) -> DataFrame:
    """Of tier 1, a row for each party and member: ``max_hi`` of what is held now (0 if nothing is), the member's rows by
    their upper bound, and ``place`` in the party's column: by ``max_hi``, then name."""
    own = rows.where("tier = 1").groupBy("party", "member", "name").agg(
        F.coalesce(F.max(F.when(F.expr(CURRENT), F.col("hi"))), F.lit(0)).alias("max_hi"), F.array_sort(F.collect_list(F.struct((-F.col("hi")).alias("order"), "security", "owner", "lo", "hi", "status"))).alias("rows")
    )
    return own.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("security", "owner", "lo", "hi", "status")]))).orderBy("party", F.desc("max_hi"), "name")


def exposure(positions: DataFrame, tier_1: Column) -> DataFrame:
    """What each member holds now: ``top`` (anything of tier 1), the sums ``lo`` and ``hi`` of all bands, and ``max_hi``, the
    largest upper bound of tier 1 (null without any). One row a member, however many its positions are."""
    held = positions.where(CURRENT)
    return held.groupBy("member").agg(F.bool_or(tier_1).alias("top"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.max(F.when(tier_1, F.col("hi"))).alias("max_hi"))


def site_stats(positions: DataFrame, members: DataFrame, tier_1: Column) -> DataFrame:
    """By party: active ``holders``, those of them with a position of tier 1, the combined exposure of all members (``lo``,
    ``hi``), and ``max_hi`` of tier 1 (0 without any). Members that the roster lacks belong to no party."""
    rows = exposure(positions, tier_1).join(members.select("member", "party", "active"), "member")
    return rows.groupBy("party").agg(F.count_if("active").alias("holders"), F.count_if(F.col("active") & F.col("top")).alias("tier_1_holders"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.coalesce(F.max("max_hi"), F.lit(0)).alias("max_hi"))


def shown(rows: DataFrame, tiers: tuple[int, ...] = (1, 2), parties: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the tiers that are not hidden; those of tier 2 of the parties alone, if any is named."""
    rows = rows.where(F.col("tier").isin(*tiers))
    return rows.where((F.col("tier") != 2) | F.col("party").isin(*parties)) if parties else rows


def votes_of(members: DataFrame, votes: DataFrame) -> DataFrame:
    """Members with ``vote_kind`` (recorded, senate-pending or unrecorded) and ``vote`` of their chamber's last vote of
    passage; the Senate's own ids are never looked up. ``votes``: ``type, chamber, ord, votes``."""
    last = votes.where("type = 'passage'").groupBy("chamber").agg(F.max_by("votes", "ord").alias("votes"))
    cast = last.select("chamber", F.explode_outer("votes").alias("v")).select("chamber", F.col("v.member").alias("member"), F.col("v.vote").alias("vote"))
    held = last.select("chamber", F.lit(True).alias("_held"))
    rows = members.join(held, "chamber", "left").join(cast.where("member is not null"), ["chamber", "member"], "left")
    kind = F.when(F.col("vote").isNotNull(), "recorded").when(F.col("_held").isNull() & (F.col("chamber") == "senate"), "senate-pending").otherwise("unrecorded")
    return rows.withColumn("vote_kind", kind).drop("_held")


def ordered(df: DataFrame, by: str, down: bool = False) -> DataFrame:
    """A table in one of the orders of the sources and the site; of ``tier_2``'s, the whole order turns with ``down``."""
    asc, desc = F.asc, F.desc
    orders: dict[str, list[Column]] = {
        "traders": [desc("trade_count"), asc("ord")], "merged": [desc("traded"), asc("member"), asc("asset")], "newest": [desc("traded"), desc("filed")], "holdings": [asc("member"), asc("security"), asc("owner")],
        "common": [desc("owners_count"), asc("ticker"), asc("kind")], "common_latest_buy": [F.desc_nulls_last("latest_buy"), desc("owners_count"), asc("ticker"), asc("kind")],
        "directory_trades": [desc("trades"), asc("name")], "directory_last_trade": [desc("last_trade"), asc("name")], "directory_name": [asc("name")],
        "votes": [asc("date"), asc("chamber")], "roster": [F.when(F.col("chamber") == "senate", 0).otherwise(1).asc(), asc("state"), asc("district"), asc("name")],
    }
    turns = {"tier_2_range": ["hi", "name"], "tier_2_name": ["name"], "tier_2_party": ["party", "name"]}
    return df.orderBy(*orders[by]) if by in orders else df.orderBy(*[(desc if down else asc)(c) for c in turns[by]])


def owners_in_order(owners: Column) -> Column:
    """Owners of a security (``status, latest_buy, name``): sold ones last, then the latest purchase first (none last),
    then the name."""

    def before(a: Column, b: Column) -> Column:
        sold = lambda o: (o["status"] == "sold").cast("int")
        day = lambda o: F.coalesce(o["latest_buy"].cast("string"), F.lit(""))
        sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
        return F.when(sold(a) != sold(b), sign(sold(a), sold(b))).when(day(a) != day(b), sign(day(b), day(a))).otherwise(sign(a["name"], b["name"]))

    return F.array_sort(owners, before)


def sums_hold(common: DataFrame) -> DataFrame:
    """Securities whose party split or whose owners that did not sell do not add up to the count of owners."""
    split = F.col("party_r") + F.col("party_d") + F.col("party_i")
    now = F.size(F.filter("owners", lambda o: o["status"] != "sold"))
    return common.where((split != F.col("owners_count")) | (now != F.col("owners_count")))


def window_label(date: Column) -> Column:
    """An aggregate: what a measured return is of, with its first and last day, one day alone."""
    first, last = F.min(date).cast("string"), F.max(date).cast("string")
    span = F.when(first == last, first).otherwise(F.concat(first, F.lit(" to "), last))
    return F.concat(F.lit("disclosed buys "), span, F.lit(", since-trade, midpoint-weighted"))


def measured_stats(traders: DataFrame) -> DataFrame:
    """One row: traders, those with a measured return, and their unpriceable purchases."""
    return traders.groupBy().agg(F.count(F.lit(1)).alias("traders"), F.count("measured").alias("measured"), F.coalesce(F.sum("unpriceable"), F.lit(0)).alias("unpriceable"))


def provenance_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("provenance").agg(F.count(F.lit(1)).alias("trades"))
