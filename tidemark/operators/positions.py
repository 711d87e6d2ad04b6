"""Positions from a reported baseline and chronological trades, in value bands.

Bounds are added and subtracted as intervals; nothing is guessed. A position is folded in the JVM by ``aggregate`` over
its own trades in order, so a task holds the trades of one position at a time and all positions run in parallel. The
state that goes from trade to trade has a fixed size but for rejected sales: which trades a position rests on follows
from where it was opened and closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import once, EXTRACTIONS

KEY = ("member", "security", "owner")
#: The notes of a position, and why a sale is none.
SOLD_UNSEEN = "sale reported by PTR with no annual baseline in our coverage"
NO_POSITION = ("partial sale on ", " without a known position - remaining holdings unknown (missed annual baseline?)")
EXHAUSTED = ("partial sales through ", " exhausted the disclosed range")
NO_FILING = "no official filing source URL - a row without one does not ship"
_STATE = "struct<status:string,lo:bigint,hi:bigint,as_of:date,level:int,start:int,stop:int,rejects:array<date>>"
_SOURCES = "array<struct<kind:string,url:string,title:string>>"
_ORDER = list(EXTRACTIONS)


def _level(extraction: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _ORDER)), extraction).cast("int")


def _named(level: Column) -> Column:
    return F.get(F.array(*map(F.lit, _ORDER)), level - 1)


def _by_url(sources: Column) -> Column:
    """The first source of each address, in order."""
    placed = F.array_sort(F.transform(sources, lambda s, i: F.struct(s["url"].alias("url"), i.alias("i"), s.alias("s"))))
    # Sorted by address, the first of a run is the first of its address.
    first = lambda p: F.transform(p, lambda x, i: F.when((i == 0) | ~F.get(p, i - 1)["url"].eqNullSafe(x["url"]), F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    kept = F.array_sort(F.array_compact(once(placed, first)))
    return F.transform(kept, lambda x: x["s"])


def latest_baseline(reports: DataFrame) -> DataFrame:
    """Of ``member, security, owner, lo, hi, as_of``: the sums of the rows of each key's latest date. If ``reports`` has
    ``sold``, whether all of them are sold; if it has ``extraction``, the worst of them; if it has ``sources``, the first
    of each address, in the order of ``ord``; if it has ``note``, the distinct notes."""
    place = F.struct("ord") if "ord" in reports.columns else F.struct("lo", "hi")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col(c).alias("v")))), lambda x: x["v"])
    more = {
        "sold": lambda: F.bool_and(F.coalesce("sold", F.lit(False))), "extraction": lambda: _named(F.max(_level(F.col("extraction")))),
        "sources": lambda: _by_url(F.flatten(in_order("sources"))), "note": lambda: F.array_distinct(F.array_compact(in_order("note"))),
    }
    more = {c: make().alias(c) for c, make in more.items() if c in reports.columns}
    # The latest day first: only its rows are gathered.
    last = reports.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.max("as_of").alias("_as_of"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    newest = reports.join(last, [*same, F.col("as_of") == F.col("_as_of")]) if more.keys() & {"sources", "note"} else reports
    by_day = newest.groupBy(*KEY, "as_of").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.count(F.lit(1)).alias("n"), *more.values())
    best = F.max_by(F.struct("lo", "hi", "n", *more), "as_of")
    out = by_day.groupBy(*KEY).agg(F.max("as_of").alias("as_of"), best.alias("s")).select(*KEY, "s.lo", "s.hi", "as_of", F.col("s.n").alias("n_reports"), *[f"s.{c}" for c in more])
    return out.withColumnRenamed("note", "notes") if "note" in more else out


def _step(base: Column):  # noqa: ANN202
    def step(p: Column, t: Column) -> Column:
        holds, buy, partial = p["status"] == "holds", t["side"] == 0, t["partial"]
        hi_left = p["hi"] - t["lo"]
        lo_left = F.least(F.greatest(p["lo"] - t["hi"], F.lit(0)), hi_left)
        as_of, level = F.greatest(p["as_of"], t["traded"]), F.greatest(p["level"], t["level"])
        open_ = F.lit(-1)

        def state(status: str | Column, lo: Column, hi: Column, as_of: Column, level: Column, start: Column, stop: Column, rejects: Column) -> Column:
            status = F.lit(status) if isinstance(status, str) else status
            values = dict(status=status, lo=lo, hi=hi, as_of=as_of, level=level, start=start, stop=stop, rejects=rejects)
            return F.struct(*[v.alias(k) for k, v in values.items()]).cast(_STATE)

        return (
            F.when(base.isNotNull() & (t["traded"] <= base), p)
            .when(buy & ~holds, state("holds", t["lo"], t["hi"], t["traded"], t["level"], t["i"], open_, p["rejects"]))
            .when(buy, state("holds", p["lo"] + t["lo"], p["hi"] + t["hi"], as_of, level, p["start"], open_, p["rejects"]))
            .when(~holds & partial, state(p["status"], p["lo"], p["hi"], p["as_of"], p["level"], p["start"], p["stop"], F.concat(p["rejects"], F.array(t["traded"]))))
            .when(~holds, state("sold", t["lo"], t["hi"], t["traded"], t["level"], t["i"], t["i"], p["rejects"]))
            .when(partial & (hi_left > 0), state("holds", lo_left, hi_left, as_of, level, p["start"], open_, p["rejects"]))
            .otherwise(state("sold", p["lo"], p["hi"], as_of, level, p["start"], t["i"], p["rejects"]))
        )

    return step


def fold(trades: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Positions of ``member, security, owner``: ``status`` (holds, sold or none), ``lo``, ``hi``, ``as_of``,
    ``extraction`` (the worst), ``sources`` (by address), ``n_sources``, ``notes``, ``rejects`` and ``reject_reasons``
    (partial sales of nothing).

    ``trades``: ``member, security, owner, side`` (buy or sell), ``partial, lo, hi, traded, filed, ord``, and maybe
    ``url`` (without it each trade is a source of its own) and ``extraction``; a null owner is self and a null security
    is left out. A baseline that is ``sold`` starts as sold; it may have ``extraction``, ``sources`` and ``notes``.
    Trades go by date, purchases first, then filing date, then ``ord``; those up to the baseline's date are in it.
    """
    own = lambda df, c, other: F.col(c) if c in df.columns else other
    event = F.struct(
        "traded", F.when(F.col("side") == "buy", 0).otherwise(1).alias("side"), "filed", "ord", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.coalesce("partial", F.lit(False)).alias("partial"),
        own(trades, "url", F.col("ord").cast("string")).alias("url"), _level(own(trades, "extraction", F.lit(_ORDER[0]))).alias("level"),
    )
    rows = trades.where("security is not null").withColumn("owner", F.coalesce("owner", F.lit("self")))
    folded = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(event)).alias("events"))
    if baseline is None:
        baseline = rows.select(*KEY, "lo", "hi", F.col("traded").alias("as_of")).limit(0)
    base = baseline.select(
        *KEY, F.col("lo").cast("long").alias("b_lo"), F.col("hi").cast("long").alias("b_hi"), F.col("as_of").alias("b_as_of"), own(baseline, "sold", F.lit(False)).alias("b_sold"),
        _level(own(baseline, "extraction", F.lit(_ORDER[0]))).alias("b_level"), own(baseline, "sources", F.array(F.struct(F.lit("filing").alias("kind"), F.lit("baseline").alias("url"), F.lit(None).alias("title")))).cast(_SOURCES).alias("b_sources"),
        own(baseline, "notes", F.array()).cast("array<string>").alias("b_notes"),
    )
    folded = folded.join(base, list(KEY), "full")
    none = F.array().cast(folded.schema["events"].dataType)
    folded = folded.withColumn("events", F.transform(F.coalesce("events", none), lambda e, i: e.withField("i", i)))
    has, at = F.col("b_as_of").isNotNull(), F.col("b_as_of")
    start = F.struct(
        F.when(has & F.col("b_sold"), "sold").when(has, "holds").otherwise("none").alias("status"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), at.alias("as_of"), F.col("b_level").alias("level"),
        F.lit(-1).alias("start"), F.when(has & F.col("b_sold"), -2).otherwise(-1).alias("stop"), F.array().cast("array<date>").alias("rejects"),
    ).cast(_STATE)
    done = folded.withColumn("p", F.aggregate("events", start, _step(at)))
    # The trades of the position as it is: from the one that opened it (after the baseline, if that did) to its end.
    from_base = F.col("p.start") < 0
    inside = lambda e: (e["i"] >= F.col("p.start")) & ((F.col("p.stop") == -1) | (e["i"] <= F.col("p.stop"))) & (at.isNull() | (e["traded"] > at))
    done = done.withColumn("own", F.when(F.col("p.status") == "none", F.filter("events", lambda e: F.lit(False))).otherwise(F.filter("events", inside)))
    before = F.when(from_base, F.coalesce("b_sources", F.array().cast(_SOURCES))).otherwise(F.array().cast(_SOURCES))
    fresh = F.array_except(F.transform("own", lambda e: e["url"]), F.transform(before, lambda b: b["url"]))  # distinct, in order
    sources = F.concat(before, F.transform(fresh, lambda u: F.struct(F.lit("filing").alias("kind"), u.alias("url"), F.lit(None).cast("string").alias("title"))))
    # A position that a partial sale has ended was exhausted by it.
    ended = lambda e: (F.col("p.status") == "sold") & (e["i"] == F.col("p.stop"))
    day = lambda e: e["traded"].cast("string")
    note = lambda e: F.when(ended(e), F.concat(F.lit(EXHAUSTED[0]), day(e), F.lit(EXHAUSTED[1]))).otherwise(F.concat(F.lit("partial sale "), day(e)))
    sales = F.transform(F.filter("own", lambda e: (e["side"] == 1) & e["partial"]), note)
    unseen = F.when((F.col("p.start") >= 0) & (F.col("p.start") == F.col("p.stop")), F.array(F.lit(SOLD_UNSEEN))).otherwise(F.array().cast("array<string>"))
    notes = F.array_distinct(F.concat(F.when(from_base, F.coalesce("b_notes", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), unseen, sales))
    reasons = F.transform("p.rejects", lambda d: F.concat(F.lit(NO_POSITION[0]), d.cast("string"), F.lit(NO_POSITION[1])))
    return done.select(
        *KEY, "p.status", "p.lo", "p.hi", "p.as_of", _named(F.col("p.level")).alias("extraction"), sources.alias("sources"), F.size(sources).alias("n_sources"), notes.alias("notes"), F.size("p.rejects").alias("rejects"), reasons.alias("reject_reasons")
    )


def mark_stale(positions: DataFrame, today: Column, days: int = 365) -> DataFrame:
    """Positions that hold and whose report is older than ``days`` become stale; sold ones never do."""
    old = (F.col("status") == "holds") & (F.datediff(today, "as_of") > days)
    return positions.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


def derived(trades: DataFrame, baseline: DataFrame | None, today: Column, universe: DataFrame | None = None, stale_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Holdings that may ship, and what may not, with the reason: rejected sales, positions without a filing among their
    sources, and those that break the contract of a band. With a universe, only its securities count."""
    if universe is not None:
        keep = universe.select("security")
        trades, baseline = trades.join(keep, "security", "left_semi"), baseline.join(keep, "security", "left_semi") if baseline is not None else None
    rows = mark_stale(fold(trades, baseline), today, stale_days)
    sales = rows.select(*KEY, F.explode("reject_reasons").alias("reason"))
    rows = rows.where("status <> 'none'")
    broken = F.when(~F.exists("sources", lambda s: s["kind"] == "filing"), NO_FILING).when((F.col("lo") < 0) | (F.col("hi") < F.col("lo")), "derived row failed the contract: range")
    rows = rows.withColumn("reason", broken).drop("reject_reasons", "rejects")
    good = rows.where("reason is null").drop("reason").withColumns({"verification": F.lit("unverified"), "note": F.nullif(F.array_join("notes", "; "), F.lit(""))}).drop("notes")
    return good, sales.unionByName(rows.where("reason is not null").select(*KEY, "reason"))


def carry_forward(previous: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows of ``derived`` with ``verification`` of the previous run where range and status are unchanged, else
    unverified, and ``changed``. If both have ``sources``, an unchanged row keeps the previous run's news too."""
    both = {"sources"} <= set(previous.columns) & set(derived.columns)
    more = [F.col("sources").alias("_sources")] if both else []
    old = previous.select(*KEY, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("status").alias("_status"), F.col("verification").alias("_v"), *more)
    same = F.col("lo").eqNullSafe(F.col("_lo")) & F.col("hi").eqNullSafe(F.col("_hi")) & F.col("status").eqNullSafe(F.col("_status"))
    rows = derived.drop("verification").join(old, list(KEY), "left").withColumns({"verification": F.when(same, F.col("_v")).otherwise("unverified"), "changed": ~same})
    if both:
        news = F.filter("_sources", lambda s: (s["kind"] == "news") & ~F.exists("sources", lambda r: r["url"] == s["url"]))
        rows = rows.withColumn("sources", F.when(same, F.concat("sources", news)).otherwise(F.col("sources")))
    return rows.drop("_lo", "_hi", "_status", "_v", "_sources")


def overlaid(holdings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Holdings with the reviewed rows in place of their own (by member, security and owner)."""
    return reviewed.select(*holdings.columns).unionByName(holdings.join(reviewed.select(*KEY), list(KEY), "left_anti"))
