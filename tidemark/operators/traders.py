"""The rows of the traders that are followed: how much each trades, what its purchases have returned, and what it claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import claims_supported, round_tenth
from tidemark.operators.portfolio import attribution, ranked
from tidemark.operators.pricing import weighted_mean
from tidemark.operators.views import window_label

#: Texts that are shown with a return, and why there is none.
ESTIMATE = "Estimate: position sizes are disclosed-range midpoints, never exact amounts."
EXCLUDED = " %d unpriceable position(s) excluded (options or no resolvable price)."
NO_TRADES, NO_BUYS = "no merged trades for this member yet", "no disclosed buys in the merged filings (sells only)"
ALL_OUT, OPTIONS, UNMEASURED = "all %d disclosed buy(s) are unpriceable", " (%d options position(s))", "Not measured: %s."
NOT_STATED, BENCHMARK, METHOD = "self (owner not stated in filings)", "SPY", "midpoint"


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def measured(buys: DataFrame, as_of: Column) -> DataFrame:
    """One row for each member with purchases: ``member``, ``buys``, ``unpriceable``, ``options`` (of these), and
    ``measured`` (``return, excess, method, benchmark, window, as_of, note``; null if no purchase has a price).

    ``buys``: ``member, traded, midpoint, ret`` (per cent; null without a price), ``excess`` (over the benchmark, may be
    null) and ``options``. Both returns are means weighted by midpoints; a purchase without an excess leaves only that
    one's mean."""
    priced = F.col("ret").isNotNull()
    own = buys.groupBy("member").agg(
        F.count(F.lit(1)).alias("buys"), _count(~priced).alias("unpriceable"), _count(~priced & F.col("options")).alias("options"), weighted_mean(F.col("ret"), F.col("midpoint")).alias("_return"),
        weighted_mean(F.when(priced, F.col("excess")), F.col("midpoint")).alias("_excess"), window_label(F.when(priced, F.col("traded"))).alias("_window"),
    )
    note = F.concat(F.lit(ESTIMATE), F.when(F.col("unpriceable") > 0, F.format_string(EXCLUDED, "unpriceable")).otherwise(""))
    struct = F.struct(round_tenth(F.col("_return")).alias("return"), round_tenth(F.col("_excess")).alias("excess"), F.lit(METHOD).alias("method"), F.lit(BENCHMARK).alias("benchmark"), F.col("_window").alias("window"), as_of.alias("as_of"), note.alias("note"))
    return own.select("member", "buys", "unpriceable", "options", F.when(F.col("_return").isNotNull(), struct).alias("measured"))


def rows(entries: DataFrame, trades: DataFrame, buys: DataFrame, as_of: Column) -> DataFrame:
    """One row for each entry of the roster of traders, the busiest first (``rank``), of equally busy ones in the roster's
    order: ``member``, ``trade_count``, ``claims``, ``measured``, ``attribution``, ``claims_supported``, ``note`` (the
    entry's own, and why there is no return) and ``unpriceable``.

    ``entries``: ``member, ord, claims`` (an array of numbers) and ``note``; ``trades``: ``member, owner``; ``buys``: as
    ``measured`` takes them. Trades of members that are no entry do not count."""
    own = trades.join(entries.select("member"), "member", "left_semi")
    counts = own.groupBy("member").agg(F.count(F.lit(1)).alias("trade_count"))
    out = entries.join(counts, "member", "left").join(attribution(own, NOT_STATED), "member", "left").join(measured(buys, as_of), "member", "left")
    some = F.when(F.col("options") > 0, F.format_string(OPTIONS, "options")).otherwise("")
    reason = F.when(F.col("trade_count").isNull(), NO_TRADES).when(F.col("buys").isNull(), NO_BUYS).otherwise(F.concat(F.format_string(ALL_OUT, "buys"), some))
    why = F.when(F.col("measured").isNull(), F.format_string(UNMEASURED, reason))
    out = out.select(
        "member", "ord", F.coalesce("trade_count", F.lit(0)).alias("trade_count"), "claims", "measured", F.coalesce("attribution", F.lit(NOT_STATED)).alias("attribution"),
        claims_supported(F.col("claims"), F.col("measured.return")).alias("claims_supported"), F.nullif(F.concat_ws(" ", "note", why), F.lit("")).alias("note"), F.coalesce("unpriceable", F.lit(0)).alias("unpriceable"),
    )
    return ranked(out, [F.desc("trade_count"), F.col("ord")]).drop("ord")


def meta(traders: DataFrame, spent: DataFrame, as_of: Column, version: str, warnings: list[str]) -> DataFrame:
    """The one row of a run: when it was, its traders and how many of them are measured, what is unpriceable, the searches
    it used and skipped, and its warnings in order."""
    own = traders.groupBy().agg(F.count(F.lit(1)).alias("traders"), F.count("measured").alias("measured"), F.coalesce(F.sum("unpriceable"), F.lit(0)).cast("long").alias("unpriceable"))
    return own.join(F.broadcast(spent.select("queries_used", "queries_skipped", "skipped_holdings")), how="cross").withColumns({"as_of": as_of, "version": F.lit(version), "warnings": F.array(*map(F.lit, warnings)).cast("array<string>")})
