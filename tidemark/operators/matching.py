"""Two sources of the same trades: one-to-one matching, differences, coverage, and lookups by tiers of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ("member", "traded", "side")


def key_pass(official: DataFrame, other: DataFrame) -> DataFrame:
    """``rid`` and ``official_rid``: the n-th row of a key matches the n-th official row of it. Rows of both are moved
    once, by their key, numbered in one pass and paired where they are; a key with a null matches none."""
    key = [*TRIPLE, "asset"]
    side = lambda rows, own: rows.dropna(subset=key).select(*key, "ord", "rid", F.lit(own).alias("_own"))
    so_far = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda own: F.count(F.when(F.col("_own") == own, 1)).over(so_far)
    rows = side(official, True).unionByName(side(other, False)).withColumn("_nth", F.when(F.col("_own"), count(True)).otherwise(count(False)))
    rid = lambda own: F.max(F.when(F.col("_own") == own, F.col("rid")))
    return rows.groupBy(*key, "_nth").agg(rid(False).alias("rid"), rid(True).alias("official_rid")).where("rid is not null and official_rid is not null").select("rid", "official_rid")


def one_to_one(official: DataFrame, other: DataFrame, shortest: int = 4, carry: Sequence[str] = ()) -> DataFrame:
    """``rid``, ``official_rid`` (null: no match) and ``how`` (key, text or none) of every row of ``other``, and the
    columns of ``carry``: its own, and with ``official_`` before the name those of its match, which so need no joins.

    Each official row absorbs one other row at most. Rows of the same member, date and side are independent of all
    others; inside such a group the other rows go in order: the first official row with an equal ``asset`` that is
    left, else by ``text``: equal, or one begins with the other, which has ``shortest`` characters at least, with an
    equal range if there is one. Groups are days of one member, folded in the JVM.
    """
    row = F.struct("ord", "rid", "asset", "text", "lo", "hi", *[c for c in carry if c not in ("asset", "text", "lo", "hi")])
    own = official.groupBy(*TRIPLE).agg(F.sort_array(F.collect_list(row)).alias("o"))
    rows = other.groupBy(*TRIPLE).agg(F.sort_array(F.collect_list(row)).alias("k"))
    both = rows.join(own, list(TRIPLE), "left").withColumn("o", F.coalesce("o", F.array().cast(own.schema["o"].dataType)))
    places = F.when(F.size("o") > 0, F.sequence(F.lit(0), F.size("o") - 1)).otherwise(F.array().cast("array<int>"))

    def begins(a: Column, b: Column) -> Column:
        return (F.least(F.length(a), F.length(b)) >= shortest) & (a.startswith(b) | b.startswith(a))

    def step(acc: Column, k: Column) -> Column:
        def first(cond) -> Column:  # noqa: ANN001
            return F.get(F.filter(acc["free"], lambda i: cond(F.get("o", i))), F.lit(0))

        by_key = first(lambda o: o["asset"] == k["asset"])
        alike = lambda o: (o["text"] == k["text"]) | begins(o["text"], k["text"])
        by_text = F.coalesce(first(lambda o: alike(o) & (o["lo"] == k["lo"]) & (o["hi"] == k["hi"])), first(alike))
        hit = F.coalesce(by_key, by_text, F.lit(-1))
        return F.struct(F.when(hit < 0, acc["free"]).otherwise(F.array_remove(acc["free"], hit)).alias("free"), F.concat(acc["at"], F.array(hit)).alias("at"))

    # The places that are still free get fewer; none is looked at again once it is taken.
    claimed = F.aggregate("k", F.struct(places.alias("free"), F.array().cast("array<int>").alias("at")), step, lambda acc: acc["at"])
    found = both.select("o", F.explode(F.arrays_zip(F.col("k").alias("k"), claimed.alias("at"))).alias("m"))
    hit = F.when(F.col("m.at") >= 0, F.get("o", F.col("m.at")))
    how = F.when(hit.isNull(), "none").when(hit["asset"] == F.col("m.k.asset"), "key").otherwise("text")
    carried = [x for c in carry for x in (F.col(f"m.k.{c}").alias(c), hit[c].alias(f"official_{c}"))]
    return found.select(F.col("m.k.rid").alias("rid"), hit["rid"].alias("official_rid"), how.alias("how"), *carried)


def differences(pairs: DataFrame, fields: Sequence[str], both_known: Sequence[str] = ()) -> Column:
    """Names of ``fields`` whose official value (``official_`` before the name) differs; those of ``both_known`` only
    where both are known."""
    unlike = [F.when(~pairs[f].eqNullSafe(pairs[f"official_{f}"]), f) for f in fields] + [F.when(pairs[f] != pairs[f"official_{f}"], f) for f in both_known]
    return F.array_compact(F.array(*unlike))


def coverage(filed: Column, start: Column) -> Column:
    """Rows that only the other source has: missed if filed when official coverage had begun, else backfill."""
    return F.when(start.isNotNull() & (filed >= start), "missed").otherwise("backfill")


def coverage_start(chamber: Column, by_chamber: dict[str, str] | None, option: str | None, first_filed: Column) -> Column:
    """When official coverage began: for the chamber, else as the option says, else the first official filing."""
    own = F.create_map(*[F.lit(x) for kv in by_chamber.items() for x in kv])[chamber] if by_chamber else F.lit(None)
    return F.coalesce(own.cast("date"), F.lit(option).cast("date"), first_filed)


def chamber_of(url: Column) -> Column:
    """The chamber whose site a filing's address is of."""
    return F.when(url.contains("efdsearch.senate.gov"), "senate").otherwise("house")


def merged(official: DataFrame, other: DataFrame, matches: DataFrame) -> DataFrame:
    """Official rows (``provenance`` official, or both where a row of the other source matched) and the other source's
    rows without a match."""
    hit = matches.where("official_rid is not null").select(F.col("official_rid").alias("rid")).withColumn("_hit", F.lit(True))
    own = official.join(hit, "rid", "left").withColumn("provenance", F.when(F.col("_hit"), "both").otherwise("official")).drop("_hit")
    rest = other.join(matches.where("official_rid is null").select("rid"), "rid", "left_semi").withColumn("provenance", F.lit("third-party"))
    return own.unionByName(rest, allowMissingColumns=True)


def unambiguous(rows: DataFrame, key: Sequence[str], value: Sequence[str], order: str) -> DataFrame:
    """One row for each key whose rows agree on ``value``; keys that disagree are left out."""
    known = rows.dropna(subset=list(key))
    picked = known.groupBy(*key).agg(F.count_distinct(F.struct(*value)).alias("_n"), F.min_by(F.struct(*value), order).alias("_v"))
    return picked.where("_n = 1").select(*key, "_v")


def tiered_lookup(rows: DataFrame, table: DataFrame, tiers: Sequence[Sequence[str]], value: Sequence[str], order: str) -> DataFrame:
    """All rows with ``value`` and ``tier`` (from 1) of the first tier of keys that answers; nulls if none does."""
    out = rows
    for i, key in enumerate(tiers, 1):
        out = out.join(unambiguous(table, key, value, order).withColumnRenamed("_v", f"_v{i}"), list(key), "left")
    answers = [F.col(f"_v{i}") for i in range(1, len(tiers) + 1)]
    tier = F.coalesce(*[F.when(a.isNotNull(), i) for i, a in enumerate(answers, 1)])
    best = F.coalesce(*answers)
    return out.select(*rows.columns, *[best[v].alias(f"found_{v}") for v in value], tier.alias("tier"))
