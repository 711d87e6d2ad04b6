"""News about holdings: a budget of searches, what their results say, and how a holding's state follows.

A result counts only if it names the member and the security; no result is no evidence, and a conflict stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import given, host_of, iso_date
from tidemark.functions.labels import holding_queries, news_class, news_last_name, security_tokens
from tidemark.operators.prefix import sum_before

#: Evidence that a holding gets at most.
MOST_SOURCES = 2
_SOURCE = "array<struct<kind: string, url: string, title: string>>"


def _known(holdings: DataFrame, members: DataFrame, universe: DataFrame) -> DataFrame:
    """Holdings whose member is on the roster, with the member's name and the security's (else its ticker)."""
    named = holdings.join(members.select("member", F.col("name").alias("_member")), "member")
    return named.join(universe.select("ticker", "kind", F.col("name").alias("_name")), ["ticker", "kind"], "left").withColumn("_security", F.coalesce("_name", "ticker")).drop("_name")


def _each(each: int) -> int:
    return max(1, min(2, each))


def searches(holdings: DataFrame, members: DataFrame, universe: DataFrame, each: int = 2) -> DataFrame:
    """The searches that a holding may need, in their order: ``holding, ord, nth, query``. ``holdings``: ``holding, ord,
    member, ticker, kind, status``; a holding whose member is not on the roster is not searched."""
    queries = F.slice(holding_queries(F.col("_member"), F.col("ticker"), F.col("_security"), F.col("kind")), 1, _each(each))
    return _known(holdings, members, universe).select("holding", "ord", F.posexplode(queries).alias("nth", "query"))


def judged(results: DataFrame, holdings: DataFrame, members: DataFrame, universe: DataFrame) -> DataFrame:
    """Results with ``class``: conflict, supporting or none. ``results``: ``holding, nth, pos, title, url, text``."""
    known = _known(holdings, members, universe).select("holding", "status", news_last_name(F.col("_member")).alias("_last"), security_tokens(F.col("ticker"), F.col("_security")).alias("_tokens"))
    found = news_class(F.col("title"), F.col("text"), F.col("_last"), F.col("_tokens"), F.col("status"))
    return results.join(known, "holding").withColumn("class", found).drop("status", "_last", "_tokens")


def spent(holdings: DataFrame, members: DataFrame, universe: DataFrame, decisive: DataFrame, budget: int, each: int = 2, failed: DataFrame | None = None) -> DataFrame:
    """What the budget of a run buys, holding by holding in their order (``ord``): ``holding``, ``ord``, ``searched`` (0 to
    ``each``), ``dropped`` (1 where a search that was due is not made) and ``passed_over`` (no search at all for want of
    budget).

    A holding's searches end at its first decisive one (``decisive``: ``holding, nth``), so what it costs follows from
    results; how much is left for it is a running sum of the costs before it, and the budget may end within a holding.
    Searches that ``failed`` (``holding, nth``) cost one as well and decide nothing. News are searched first: the budget is
    what they leave. A holding whose member is not on the roster costs nothing.
    """
    lost = failed.select("holding", "nth").distinct() if failed is not None else None
    deciding = decisive.select("holding", "nth") if lost is None else decisive.select("holding", "nth").join(lost, ["holding", "nth"], "left_anti")
    first = deciding.where(F.col("nth") < _each(each)).groupBy("holding").agg((F.min("nth") + 1).alias("_cost"))
    known = holdings.join(members.select("member").distinct(), "member", "left_semi").select("holding", "ord").join(first, "holding", "left")
    costs = known.withColumn("_cost", F.coalesce("_cost", F.lit(_each(each))).cast("long"))
    left = F.greatest(F.lit(budget) - F.col("_spent"), F.lit(0))
    out = sum_before(costs, [F.col("ord"), F.col("holding")], "_cost", "_spent").withColumn("searched", F.least("_cost", left))
    out = out.withColumn("dropped", (F.col("searched") < F.col("_cost")).cast("long"))
    without = F.col("searched") == 0
    if lost is not None:  # searches that all failed, the last of the budget, are none
        faults = lost.groupBy("holding").agg(F.sort_array(F.collect_set("nth")).alias("_lost"))
        out = out.join(faults, "holding", "left")
        all_lost = F.size(F.filter(F.coalesce("_lost", F.array().cast("array<int>")), lambda n: n < F.col("searched"))) == F.col("searched")
        without = without | (all_lost & (left - F.col("searched") <= 0))
    return out.select("holding", "ord", "searched", "dropped", without.alias("passed_over"))


def told(spent_: DataFrame) -> DataFrame:
    """One row of a run's counts: ``queries_used``, ``queries_skipped`` and ``skipped_holdings``."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return spent_.agg(count("searched").alias("queries_used"), count("dropped").alias("queries_skipped"), count(F.col("passed_over").cast("int")).alias("skipped_holdings"))


def outcomes(results: DataFrame, holdings: DataFrame, members: DataFrame, universe: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """``holding``, ``outcome`` (conflict or corroborated) and ``evidence`` (at most two results, in their order) of the
    first search of a holding that says something. Of searches that ``spent`` did not make (``made``), results do not
    count."""
    said = judged(results, holdings, members, universe).where("class <> 'none'")
    if made is not None:
        said = said.join(made.select("holding", "searched"), "holding").where("nth < searched").drop("searched")
    best = Window.partitionBy("holding").orderBy("nth", F.col("class"), "pos")  # a conflict stands before support
    said = said.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= MOST_SOURCES)
    lead = F.min_by(F.struct("nth", "class"), "_place")
    own = said.groupBy("holding").agg(lead.alias("_lead"), F.array_sort(F.collect_list(F.struct("_place", "nth", "class", "url", "title"))).alias("_all"))
    same = F.filter("_all", lambda r: (r["nth"] == F.col("_lead.nth")) & (r["class"] == F.col("_lead.class")))
    return own.select("holding", F.when(F.col("_lead.class") == "conflict", "conflict").otherwise("corroborated").alias("outcome"), F.transform(same, lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"))).alias("evidence"))


def with_news(sources: Column, evidence: Column) -> Column:
    """Sources with the evidence whose address is a web address and not among them, as news."""
    fresh = F.filter(evidence, lambda e: e["url"].rlike("^https?://") & ~F.exists(sources, lambda s: s["url"] == e["url"]))
    return F.concat(sources, F.transform(fresh, lambda e: F.struct(F.lit("news").alias("kind"), e["url"].alias("url"), given(e["title"]).alias("title"))))


def applied(holdings: DataFrame, found: DataFrame) -> DataFrame:
    """Holdings (with ``verification`` and ``sources``) after the searches: without an outcome nothing changes, and a
    conflict is never taken back."""
    rows = holdings.join(found, "holding", "left")
    keeps = F.col("outcome").isNull() | ((F.col("outcome") == "corroborated") & (F.col("verification") == "conflict"))
    sources = F.when(keeps, F.col("sources")).otherwise(with_news(F.col("sources").cast(_SOURCE), F.col("evidence")))
    return rows.withColumns({"sources": sources, "verification": F.when(keeps, F.col("verification")).otherwise(F.col("outcome"))}).drop("outcome", "evidence")


def news_items(results: DataFrame) -> DataFrame:
    """Results with a title, a sound date and a host: ``title, url, source, published, ord``; others are dropped."""
    rows = results.select(given(F.col("title")).alias("title"), "url", host_of(F.col("url")).alias("source"), iso_date(F.left("publishedDate", F.lit(10))).alias("published"), "ord")
    return rows.where("title is not null and published is not null and source is not null")
