"""The disclosure tables as views of the test tables, in DataFrames and in SQL.

Members are suppliers, securities are brand and type of a part, trades are line items: returned ones are sales, and
every seventh line of an order is a reported baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ((1, 1000), (1001, 15000), (15001, 50000), (50001, 100000), (100001, 250000))
TIER_1 = ("ECONOMY", "PROMO", "STANDARD")
TODAY = "2000-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """All trades. ``by_order``: orders are joined last, so that rows lie by ``orderkey`` and a grouping by it moves none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("traded"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_brand").alias("ticker"), F.col("p_type").alias("kind"))
    with_orders = lambda rows: rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    with_parts = lambda rows: rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rows = with_orders(with_parts(lines)) if by_order else with_parts(with_orders(lines))
    price = F.col("l_extendedprice")
    band = lambda side: F.coalesce(*[F.when(price <= hi, (lo, hi)[side]) for lo, hi in BANDS[:-1]], F.lit(BANDS[-1][side])).cast("long")
    cents = F.round(price * 100).cast("long")
    return rows.select(
        F.col("l_suppkey").alias("member"), F.concat_ws(":", "ticker", "kind").alias("security"), "ticker", "kind", "text",
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.when(F.col("l_linenumber") % 3 == 1, "self").when(F.col("l_linenumber") % 3 == 2, "spouse").alias("owner"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("partial"),
        band(0).alias("lo"), band(1).alias("hi"), "traded", F.col("l_shipdate").cast("date").alias("filed"), (F.col("l_linenumber") == 7).alias("reported"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_partkey", "l_suppkey", cents.cast("string")).alias("rid"),
        cents.alias("cents"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    party = F.element_at(F.array(F.lit("R"), F.lit("D"), F.lit("I")), F.col("s_nationkey") % 3 + 1)
    return rows.select(F.col("s_suppkey").alias("member"), F.col("s_name").alias("name"), party.alias("party"), F.when(F.col("s_nationkey") % 2 == 0, "house").otherwise("senate").alias("chamber"), "state", (F.col("s_acctbal") >= 0).alias("active"))


def _band_sql(side: int) -> str:
    return "(CASE " + " ".join(f"WHEN l_extendedprice <= {b[1]} THEN {b[side]}" for b in BANDS[:-1]) + f" ELSE {BANDS[-1][side]} END)::BIGINT"


TRADES_SQL = f"""t AS (
  SELECT l_suppkey AS member, p_brand || ':' || p_type AS security, p_brand AS ticker, p_type AS kind, p_name AS text,
    CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CASE l_linenumber % 3 WHEN 1 THEN 'self' WHEN 2 THEN 'spouse' END AS owner,
    l_returnflag = 'R' AND l_linestatus = 'F' AS partial, {_band_sql(0)} AS lo, {_band_sql(1)} AS hi,
    o_orderdate::DATE AS traded, l_shipdate::DATE AS filed, l_linenumber = 7 AS reported, round(l_extendedprice * 100)::BIGINT AS cents,
    concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS rid,
    l_quantity::BIGINT AS quantity, l_partkey AS part, l_orderkey AS orderkey, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""
MEMBERS_SQL = """m AS (
  SELECT s_suppkey AS member, s_name AS name, CASE s_nationkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'D' ELSE 'I' END AS party,
    CASE WHEN s_nationkey % 2 = 0 THEN 'house' ELSE 'senate' END AS chamber, n_name AS state, s_acctbal >= 0 AS active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""
#: Positions (``p``) by a recursive walk along each position's events.
FOLD_SQL = f"""{TRADES_SQL}, {MEMBERS_SQL}, b0 AS (
  SELECT member, security, coalesce(owner, 'self') AS owner, traded, sum(lo)::BIGINT AS lo, sum(hi)::BIGINT AS hi, count(*) AS n FROM t WHERE reported AND side = 'buy' GROUP BY ALL
), b AS (
  SELECT member, security, owner, max(traded) AS as_of, arg_max(lo, traded) AS lo, arg_max(hi, traded) AS hi, arg_max(n, traded) AS n_reports FROM b0 GROUP BY ALL
), ev AS (
  SELECT member, security, coalesce(owner, 'self') AS owner, side, partial, lo AS tlo, hi AS thi, traded, row_number() OVER (PARTITION BY member, security, coalesce(owner, 'self') ORDER BY traded, side, filed, rid) AS rn FROM t WHERE NOT reported
), k AS (SELECT member, security, owner FROM ev UNION SELECT member, security, owner FROM b), f AS (
  SELECT k.member, k.security, k.owner, 0::BIGINT AS rn, CASE WHEN as_of IS NULL THEN 'none' ELSE 'holds' END AS status, lo, hi, as_of, as_of AS base, CASE WHEN as_of IS NULL THEN 0 ELSE 1 END AS n, 0 AS rejects
  FROM k LEFT JOIN b ON k.member = b.member AND k.security = b.security AND k.owner = b.owner
  UNION ALL
  SELECT member, security, owner, rn,
    CASE WHEN act IN ('skip', 'reject') THEN status WHEN act IN ('open', 'add', 'part') THEN 'holds' ELSE 'sold' END,
    CASE act WHEN 'open' THEN tlo WHEN 'ghost' THEN tlo WHEN 'add' THEN lo + tlo WHEN 'part' THEN least(greatest(lo - thi, 0), hi - tlo) ELSE lo END,
    CASE act WHEN 'open' THEN thi WHEN 'ghost' THEN thi WHEN 'add' THEN hi + thi WHEN 'part' THEN hi - tlo ELSE hi END,
    CASE WHEN act IN ('skip', 'reject') THEN as_of WHEN act IN ('open', 'ghost') THEN traded ELSE greatest(as_of, traded) END, base,
    CASE WHEN act IN ('skip', 'reject') THEN n WHEN act IN ('open', 'ghost') THEN 1 ELSE n + 1 END, rejects + CASE WHEN act = 'reject' THEN 1 ELSE 0 END
  FROM (
    SELECT f.member, f.security, f.owner, ev.rn, status, lo, hi, as_of, base, n, rejects, tlo, thi, traded,
      CASE WHEN base IS NOT NULL AND traded <= base THEN 'skip' WHEN side = 'buy' AND status <> 'holds' THEN 'open' WHEN side = 'buy' THEN 'add'
        WHEN status <> 'holds' AND partial THEN 'reject' WHEN status <> 'holds' THEN 'ghost' WHEN partial AND hi - tlo > 0 THEN 'part' ELSE 'close' END AS act
    FROM f JOIN ev ON f.member = ev.member AND f.security = ev.security AND f.owner = ev.owner AND ev.rn = f.rn + 1
  )
), p0 AS (
  SELECT member, security, owner, arg_max({{'status': status, 'lo': lo, 'hi': hi, 'as_of': as_of, 'n': n, 'rejects': rejects}}, rn) AS s FROM f GROUP BY ALL
), p AS (
  SELECT member, security, owner, CASE WHEN s.status = 'holds' AND date_diff('day', s.as_of, DATE '{TODAY}') > 365 THEN 'stale' ELSE s.status END AS status, s.lo AS lo, s.hi AS hi, s.as_of AS as_of, s.n AS n_sources, s.rejects AS rejects FROM p0
)"""
