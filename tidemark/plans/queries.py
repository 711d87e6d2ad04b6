"""The registered queries of the disclosure operators over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as K
from tidemark.functions import labels as L
from tidemark.operators import gate, matching, portfolio, positions, pricing, resolve, views
from tidemark.plans.model import FOLD_SQL, MEMBERS_SQL, TIER_1, TODAY, TRADES_SQL, members, table, trades
from tidemark.shared import stored
from tidemark.sources import landing, markup
from tidemark.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _text(c: str):  # noqa: ANN202
    return F.col(c).cast("string").alias(c)


def _baseline(t: DataFrame) -> DataFrame:
    reports = t.where("reported and side = 'buy'").select("member", "security", F.coalesce("owner", F.lit("self")).alias("owner"), "lo", "hi", F.col("traded").alias("as_of"))
    return positions.latest_baseline(reports)


def _once(spark: SparkSession, d: str, *columns: str, where: str = "true") -> DataFrame:
    """Trades, for queries that use them more than once: joined and written once. Only the columns named here are moved
    and written (all without any), and only the rows that a query reads."""
    t = trades(spark, d).where(where)
    return stored(t.select(*columns) if columns else t)


#: What positions are folded from.
_FOLDED = ("member", "security", "owner", "side", "partial", "lo", "hi", "traded", "filed", "reported", "rid")


def _held(t: DataFrame) -> DataFrame:
    folded = positions.fold(t.where("not reported").withColumn("ord", F.col("rid")), _baseline(t))
    return positions.mark_stale(folded, F.lit(TODAY).cast("date"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return _held(_once(spark, d, *_FOLDED))


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT member, security, owner, lo, hi, as_of::VARCHAR AS as_of, n_reports::BIGINT AS n_reports FROM b")
def g1_latest_baseline(spark: SparkSession, d: str) -> DataFrame:
    return _baseline(trades(spark, d)).withColumn("as_of", _text("as_of"))


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT member, security, owner, status, lo, hi, as_of::VARCHAR AS as_of, n_sources::INT AS n_sources, rejects::INT AS rejects FROM p")
def g2_position_fold(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d).select(*positions.KEY, "status", "lo", "hi", _text("as_of"), "n_sources", "rejects")


_OWNERS_SQL = """e AS (
  SELECT security, member, bool_or(status <> 'sold') AS cur, CASE WHEN bool_or(status <> 'sold') THEN sum(lo) FILTER (WHERE status <> 'sold') ELSE sum(lo) END AS lo,
    CASE WHEN bool_or(status <> 'sold') THEN sum(hi) FILTER (WHERE status <> 'sold') ELSE sum(hi) END AS hi,
    CASE WHEN NOT bool_or(status <> 'sold') THEN 'sold' WHEN bool_or(status = 'holds') THEN 'holds' ELSE 'stale' END AS status
  FROM p WHERE status <> 'none' GROUP BY ALL
)"""


@query(f"WITH RECURSIVE {FOLD_SQL}, {_OWNERS_SQL} SELECT security, member, lo::BIGINT AS lo, hi::BIGINT AS hi, status FROM e")
def g9_common_owner(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.owners(_positions(spark, d).where("status <> 'none'"))


@query(f"""WITH RECURSIVE {FOLD_SQL}, {_OWNERS_SQL}, y AS (SELECT security, member, max(traded) AS bought FROM t WHERE side = 'buy' GROUP BY ALL)
SELECT security, count(*) FILTER (WHERE cur) AS owners_count, count(*) FILTER (WHERE cur AND party = 'R') AS party_r, count(*) FILTER (WHERE cur AND party = 'D') AS party_d,
  count(*) FILTER (WHERE cur AND party = 'I') AS party_i, max(bought)::VARCHAR AS latest_buy, (sum(lo) FILTER (WHERE cur))::BIGINT AS lo, (sum(hi) FILTER (WHERE cur))::BIGINT AS hi,
  string_agg(name || ' ' || status || ' ' || lo || '-' || hi || coalesce(' ' || bought, ''), ', ' ORDER BY NOT cur, coalesce(bought::VARCHAR, '') DESC, name) AS owners
FROM e JOIN m USING (member) LEFT JOIN y USING (security, member) GROUP BY security HAVING owners_count >= 2""")
def g10_common_holdings(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d, *_FOLDED)
    found = portfolio.common_documents(_held(t).where("status <> 'none'"), members(spark, d), t.where("side = 'buy'"))
    now = F.filter("owners", lambda o: o["status"] != "sold")
    total = lambda c: F.aggregate(F.transform(now, lambda o: o[c]), F.lit(0).cast("long"), lambda a, x: a + x).alias(c)
    bought = lambda o: F.coalesce(F.concat(F.lit(" "), F.get(o["buy_dates"], F.lit(0)).cast("string")), F.lit(""))
    row = lambda o: F.concat(o["name"], F.lit(" "), o["status"], F.lit(" "), o["lo"].cast("string"), F.lit("-"), o["hi"].cast("string"), bought(o))
    return found.select("security", "owners_count", "party_r", "party_d", "party_i", _text("latest_buy"), total("lo"), total("hi"), F.array_join(F.transform("owners", row), ", ").alias("owners"))


@query(f"""WITH {TRADES_SQL}, r AS (SELECT security, member, traded, row_number() OVER (PARTITION BY security, member ORDER BY traded DESC) AS n FROM t WHERE side = 'buy')
SELECT security, member, string_agg(traded::VARCHAR, ',' ORDER BY traded DESC) AS dates FROM r WHERE n <= 10 GROUP BY ALL""")
def g11_buy_dates_topk(spark: SparkSession, d: str) -> DataFrame:
    newest = portfolio.newest_dates(trades(spark, d).where("side = 'buy'"))
    return newest.withColumn("dates", F.array_join(F.transform("dates", lambda x: x.cast("string")), ","))


@query(f"""WITH {TRADES_SQL}, c AS (SELECT member, owner, count(*) AS n FROM t GROUP BY ALL)
SELECT member, coalesce(string_agg(owner, ' + ' ORDER BY n DESC, owner) FILTER (WHERE owner IS NOT NULL), 'self (owner not stated in filings)') AS attribution FROM c GROUP BY member""")
def g8_attribution(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.attribution(trades(spark, d))


@query(f"""WITH {TRADES_SQL}, {MEMBERS_SQL}, v AS (SELECT t.*, party FROM t JOIN m USING (member))
SELECT party, count(*) FILTER (WHERE side = 'buy') AS yea, count(*) FILTER (WHERE side = 'sell' AND partial) AS present, count(*) FILTER (WHERE side = 'sell' AND NOT partial) AS nay FROM v GROUP BY party""")
def g12_party_tally(spark: SparkSession, d: str) -> DataFrame:
    vote = F.when(F.col("side") == "buy", "yea").when(F.col("partial"), "present").otherwise("nay")
    per_member = trades(spark, d).groupBy("member", vote.alias("vote")).count()
    return per_member.join(members(spark, d).select("member", "party"), "member").groupBy("party").pivot("vote", ["yea", "nay", "present"]).agg(F.sum("count")).na.fill(0)


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT count(DISTINCT member) AS holders, CASE WHEN count(DISTINCT member) < 9 THEN 'too few' WHEN count(DISTINCT member) > 25 THEN 'too many' END AS failure FROM p LEFT JOIN m USING (member) WHERE status NOT IN ('sold', 'none') AND split_part(security, ':', 2) IN {TIER_1} AND coalesce(active, true)")
def v2_holder_bound(spark: SparkSession, d: str) -> DataFrame:
    tiers = table(spark, d, "part").select(F.concat_ws(":", "p_brand", "p_type").alias("security"), F.when(F.col("p_type").isin(*TIER_1), 1).otherwise(2).alias("tier")).distinct()
    return gate.within_bound(gate.holder_count(_positions(spark, d).where("status <> 'none'"), members(spark, d), tiers), 9, 25)


_PINS = "SELECT member, security, 'pin-' || member || '-' || security AS pin, member % 2 = 0 AS expected, 15001 AS pin_lo, 100000 AS pin_hi FROM"


@query(f"""WITH RECURSIVE {FOLD_SQL}, w AS ({_PINS} (SELECT DISTINCT member, security FROM t)), l AS (
  SELECT member, security, arg_min({{'lo': lo, 'hi': hi}}, owner) AS x FROM p WHERE status NOT IN ('sold', 'none') GROUP BY ALL)
SELECT pin, w.member, w.security, expected, CASE WHEN expected THEN x IS NOT NULL AND coalesce(x.lo <= pin_hi AND x.hi >= pin_lo, false) ELSE x IS NULL END AS ok
FROM w LEFT JOIN l ON w.member = l.member AND w.security = l.security""")
def v3_v4_pins(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d)
    keys = t.select("member", "security").distinct()
    pins = keys.select("member", "security", F.concat_ws("-", F.lit("pin"), F.col("member").cast("string"), "security").alias("pin"), (F.col("member") % 2 == 0).alias("expected"), F.lit(15001).alias("pin_lo"), F.lit(100000).alias("pin_hi"))
    return gate.check_pins(pins, _held(t).where("status <> 'none'"))


@query(f"""WITH RECURSIVE {FOLD_SQL}, w AS (SELECT DISTINCT member, security FROM t), l AS (SELECT member, security, min(owner) AS x FROM p WHERE status NOT IN ('sold', 'none') GROUP BY ALL)
SELECT 'owner-' || member || '-' || security AS pin, coalesce(x = CASE WHEN member % 2 = 0 THEN 'self' ELSE 'spouse' END, false) AS ok FROM w LEFT JOIN l USING (member, security)
UNION ALL SELECT 'gone-' || w.member, NOT coalesce(active, false) FROM (SELECT DISTINCT member FROM t UNION SELECT -1) w LEFT JOIN m USING (member)""")
def v5_v6_pins(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d)
    keys = t.select("member", "security").distinct()
    owners = keys.select("member", "security", F.concat_ws("-", F.lit("owner"), F.col("member").cast("string"), "security").alias("pin"), F.when(F.col("member") % 2 == 0, "self").otherwise("spouse").alias("pin_owner"))
    gone = keys.select("member").union(spark.range(1).select(F.lit(-1).cast("long"))).distinct().select("member", F.concat_ws("-", F.lit("gone"), F.col("member").cast("string")).alias("pin"))
    held = _held(t).where("status <> 'none'")
    return gate.check_owners(owners, held).unionByName(gate.check_inactive(gone, members(spark, d)))


_SOURCES_SQL = f"""{TRADES_SQL}, o AS (
  SELECT rid, member, traded, side, CASE WHEN kind = 'SMALL' THEN 'raw:' || text ELSE security END AS asset, text, lo, hi, filed, owner, filed > traded + 45 AS late FROM t WHERE part % 2 = 0
), c AS (
  SELECT 'x' || rid AS rid, member, traded, side, CASE WHEN line % 4 = 0 THEN 'raw:' || left(text, 5) WHEN kind = 'SMALL' THEN 'raw:' || text ELSE security END AS asset,
    CASE WHEN line % 4 = 0 THEN left(text, 5) ELSE text END AS text, lo, CASE WHEN line % 2 = 0 THEN hi + 50000 ELSE hi END AS hi, filed + CASE WHEN orderkey % 2 = 0 THEN 5 ELSE 0 END AS filed, owner,
    filed > traded + 45 AS late FROM t WHERE part % 2 = 1 OR orderkey % 3 = 0
)"""


def _sources(spark: SparkSession, d: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """The official rows and the other source's, with the fields that are asked for besides the key and the text."""
    t = _once(spark, d, "rid", "member", "traded", "side", "security", "kind", "text", "part", "orderkey", "line", *[f for f in fields if f != "late"])
    t = t.withColumn("asset", F.when(F.col("kind") == "SMALL", F.concat(F.lit("raw:"), "text")).otherwise(F.col("security")))
    if "late" in fields:
        t = t.withColumn("late", K.is_late(F.col("traded"), F.col("filed")))
    names = ["rid", "member", "traded", "side", "asset", "text", *fields]
    own = t.where("part % 2 = 0").select(*names).withColumn("ord", F.col("rid"))
    short = F.col("line") % 4 == 0
    cut = F.left("text", F.lit(5))
    changed = {
        "rid": F.concat(F.lit("x"), "rid"), "asset": F.when(short, F.concat(F.lit("raw:"), cut)).otherwise(F.col("asset")), "text": F.when(short, cut).otherwise(F.col("text")),
        "hi": F.when(F.col("line") % 2 == 0, F.col("hi") + 50000).otherwise(F.col("hi")), "filed": F.expr("date_add(filed, if(orderkey % 2 = 0, 5, 0))"),
    }
    other = t.where("part % 2 = 1 or orderkey % 3 = 0").withColumns({c: v for c, v in changed.items() if c in names})
    return own, other.select(*names).withColumn("ord", F.col("rid"))


@query(f"""WITH {_SOURCES_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY member, traded, side, asset ORDER BY rid) AS n FROM o), z AS (SELECT *, row_number() OVER (PARTITION BY member, traded, side, asset ORDER BY rid) AS n FROM c)
SELECT z.rid, a.rid AS official_rid FROM z JOIN a USING (member, traded, side, asset, n)""")
def j8_key_pass(spark: SparkSession, d: str) -> DataFrame:
    return matching.key_pass(*_sources(spark, d))


_MATCH_SQL = f"""{_SOURCES_SQL}, oo AS (SELECT member, traded, side, list({{'rid': rid, 'asset': asset, 'text': text, 'lo': lo, 'hi': hi}} ORDER BY rid) AS o FROM o GROUP BY ALL),
q AS (SELECT c.rid, member, traded, side, asset, text, lo, hi, row_number() OVER (PARTITION BY member, traded, side ORDER BY c.rid) AS n FROM c SEMI JOIN oo USING (member, traded, side)),
w AS (
  SELECT member, traded, side, o, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS hit, NULL::VARCHAR AS rid, NULL::VARCHAR AS asset FROM oo SEMI JOIN q USING (member, traded, side)
  UNION ALL
  SELECT member, traded, side, o, n, list_append(used, coalesce(hit, -1)), hit, rid, asset FROM (
    SELECT w.member, w.traded, w.side, w.o, q.n, w.used, q.rid, q.asset, coalesce(
      list_min(list_filter(range(1, len(o) + 1), lambda i: NOT list_contains(used, i) AND o[i].asset = q.asset)),
      list_min(list_filter(range(1, len(o) + 1), lambda i: NOT list_contains(used, i) AND o[i].lo = q.lo AND o[i].hi = q.hi AND (o[i].text = q.text OR (least(length(o[i].text), length(q.text)) >= 4 AND (starts_with(o[i].text, q.text) OR starts_with(q.text, o[i].text)))))),
      list_min(list_filter(range(1, len(o) + 1), lambda i: NOT list_contains(used, i) AND (o[i].text = q.text OR (least(length(o[i].text), length(q.text)) >= 4 AND (starts_with(o[i].text, q.text) OR starts_with(q.text, o[i].text))))))) AS hit
    FROM w JOIN q ON w.member = q.member AND w.traded = q.traded AND w.side = q.side AND q.n = w.n + 1)
), x AS (
  SELECT rid, o[hit].rid AS official_rid, CASE WHEN hit IS NULL THEN 'none' WHEN o[hit].asset = asset THEN 'key' ELSE 'text' END AS how FROM w WHERE n > 0
  UNION ALL SELECT rid, NULL, 'none' FROM c ANTI JOIN oo USING (member, traded, side)
)"""


@query(f"WITH RECURSIVE {_MATCH_SQL} SELECT rid, official_rid, how FROM x")
def j8_merge_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return matching.one_to_one(*_sources(spark, d, "lo", "hi"))


@query(f"""WITH RECURSIVE {_MATCH_SQL}, g AS (SELECT min(filed) AS start FROM o)
SELECT x.rid, how, CASE WHEN x.official_rid IS NOT NULL THEN 'both' WHEN c.filed >= start THEN 'missed' ELSE 'backfill' END AS provenance,
  concat_ws(',', CASE WHEN o.lo <> c.lo THEN 'lo' END, CASE WHEN o.hi <> c.hi THEN 'hi' END, CASE WHEN o.filed <> c.filed THEN 'filed' END, CASE WHEN o.late <> c.late THEN 'late' END, CASE WHEN o.owner <> c.owner THEN 'owner' END) AS conflicts
FROM x JOIN c ON x.rid = c.rid LEFT JOIN o ON o.rid = x.official_rid CROSS JOIN g""".replace("FROM c ANTI", "FROM c ANTI"))
def j10_j11_conflicts(spark: SparkSession, d: str) -> DataFrame:
    fields = ["lo", "hi", "filed", "late"]
    own, other = _sources(spark, d, *fields, "owner")
    pairs = matching.one_to_one(own, other, carry=[*fields, "owner"])
    pairs = pairs.join(F.broadcast(own.groupBy().agg(F.min("filed").alias("start"))), how="cross")
    unlike = F.when(F.col("official_rid").isNotNull(), F.array_join(matching.differences(pairs, fields, ["owner"]), ","))
    only = matching.coverage(F.col("filed"), matching.coverage_start(F.lit(None).cast("string"), None, None, F.col("start")))
    return pairs.select("rid", "how", F.when(F.col("official_rid").isNotNull(), "both").otherwise(only).alias("provenance"), F.coalesce(unlike, F.lit("")).alias("conflicts"))


def _tier_sql(name: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, min(lo) AS v FROM y GROUP BY ALL HAVING count(DISTINCT lo) = 1)"


@query(f"""WITH {TRADES_SQL}, y AS (SELECT * FROM t WHERE part % 2 = 1 AND side = 'buy'), {_tier_sql("a", "member, text, traded")}, {_tier_sql("b", "member, ticker, traded")}, {_tier_sql("c", "member, traded")}
SELECT rid, coalesce(a.v, b.v, c.v) AS found_lo, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS tier
FROM t LEFT JOIN a USING (member, text, traded) LEFT JOIN b USING (member, ticker, traded) LEFT JOIN c USING (member, traded) WHERE t.part % 2 = 0 AND t.side = 'buy'""")
def j12_return_lookup(spark: SparkSession, d: str) -> DataFrame:
    buys = _once(spark, d, "rid", "member", "text", "ticker", "traded", "lo", "part", where="side = 'buy'")
    found = matching.tiered_lookup(buys.where("part % 2 = 0").drop("part", "lo"), buys.where("part % 2 = 1"), [["member", "text", "traded"], ["member", "ticker", "traded"], ["member", "traded"]], ["lo"], "rid")
    return found.select("rid", "found_lo", "tier")


_PRICE_SQL = f"""{TRADES_SQL}, pr AS (SELECT ticker, traded AS date, sum(cents) / sum(quantity) AS close FROM t GROUP BY ALL),
be AS (SELECT traded AS date, sum(cents) / sum(quantity) AS close FROM t GROUP BY ALL)"""


def _prices(t: DataFrame, *key: str) -> DataFrame:
    return t.groupBy(*key, F.col("traded").alias("date")).agg((F.sum("cents") / F.sum("quantity")).alias("close"))


@query(f"WITH {_PRICE_SQL}, b AS (SELECT DISTINCT ticker, filed - 3 AS traded FROM t) SELECT b.ticker, b.traded::VARCHAR AS traded, pr.date::VARCHAR AS entry_date, floor(close + 0.5)::BIGINT AS entry FROM b ASOF LEFT JOIN pr ON b.ticker = pr.ticker AND b.traded <= pr.date")
def j13_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    # The as-of pass reads both sides more than once: each is made once, and the trades are joined once for both.
    t = _once(spark, d, "ticker", "traded", "filed", "cents", "quantity")
    asked = stored(t.select("ticker", F.date_sub("filed", 3).alias("traded")).distinct())
    found = pricing.asof_forward(asked, stored(_prices(t, "ticker")), "ticker", "traded")
    return found.select("ticker", _text("traded"), _text("entry_date"), F.floor(F.col("entry") + 0.5).cast("long").alias("entry"))


@query(f"""WITH {_PRICE_SQL}, l AS (SELECT ticker, arg_max(close, date) AS latest FROM pr GROUP BY ticker), bl AS (SELECT arg_max(close, date) AS latest FROM be), b AS (SELECT * FROM t WHERE side = 'buy'),
s AS (SELECT b.member, b.traded, (lo + hi) / 2 AS w, (l.latest / pr.close - 1) * 100 AS ret FROM b ASOF LEFT JOIN pr ON b.ticker = pr.ticker AND b.traded <= pr.date LEFT JOIN l ON b.ticker = l.ticker),
x AS (SELECT member, w, ret, ret - (bl.latest / be.close - 1) * 100 AS excess FROM s ASOF LEFT JOIN be ON s.traded <= be.date CROSS JOIN bl)
SELECT member, count(*) AS buys, count(ret) AS priced, floor(sum(w * ret) / sum(w) FILTER (WHERE ret IS NOT NULL) * 10 + 0.5) / 10 AS ret, floor(sum(w * excess) / sum(w) FILTER (WHERE excess IS NOT NULL) * 10 + 0.5) / 10 AS excess FROM x GROUP BY member""")
def g7_weighted_returns(spark: SparkSession, d: str) -> DataFrame:
    t = _once(spark, d)
    buys = t.where("side = 'buy'").select("member", "ticker", "traded", K.midpoint(F.col("lo"), F.col("hi")).alias("w"))
    rows = pricing.returns(buys, stored(_prices(t, "ticker")), _prices(t), "ticker", "traded")
    mean = lambda c: K.round_tenth(pricing.weighted_mean(F.col(c), F.col("w"))).alias(c)
    return rows.groupBy("member").agg(F.count(F.lit(1)).alias("buys"), F.count("ret").alias("priced"), mean("ret"), mean("excess"))


@query(f"""WITH {TRADES_SQL}, {MEMBERS_SQL}, c AS (SELECT member, count(*) AS trades, max(traded)::VARCHAR AS last_trade FROM t GROUP BY member)
SELECT member, name, party, state, active, trades, last_trade, row_number() OVER (ORDER BY trades DESC, name) AS rank FROM c JOIN m USING (member)""")
def g15_w2_directory(spark: SparkSession, d: str) -> DataFrame:
    rows = portfolio.directory(trades(spark, d), members(spark, d)).select("member", "name", "party", "state", "active", "trades", _text("last_trade"))
    return portfolio.ranked(rows, [F.desc("trades"), F.col("name")]).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TRADES_SQL}, {MEMBERS_SQL} SELECT DISTINCT member, name, party, state FROM t JOIN m USING (member) WHERE party IN ('R', 'D') AND active AND (contains(lower(name), 'nation_1') OR lower(state) = 'nation_1')")
def f13_directory_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = portfolio.directory(trades(spark, d).select("member", "traded"), members(spark, d))
    return portfolio.filter_directory(rows, ("R", "D"), True, " Nation_1 ").select("member", "name", "party", "state")


@query(f"""WITH RECURSIVE {FOLD_SQL}, j AS (SELECT p.*, party, active, split_part(security, ':', 2) IN {TIER_1} AS top FROM p JOIN m USING (member) WHERE status NOT IN ('sold', 'none'))
SELECT party, count(DISTINCT member) FILTER (WHERE active) AS holders, count(DISTINCT member) FILTER (WHERE active AND top) AS tier_1_holders, sum(lo)::BIGINT AS lo, sum(hi)::BIGINT AS hi, coalesce(max(hi) FILTER (WHERE top), 0) AS max_hi FROM j GROUP BY party""")
def g17_g21_site_stats(spark: SparkSession, d: str) -> DataFrame:
    top = F.split("security", ":")[1].isin(*TIER_1)
    return views.site_stats(_positions(spark, d).where("status <> 'none'"), members(spark, d), top)


@query(f"WITH {TRADES_SQL} SELECT rid, concat_ws(',', CASE WHEN filed < traded THEN 'filed before traded' END, CASE WHEN owner IS NULL THEN 'no owner' END, CASE WHEN hi > 100000 THEN 'too large' END) AS violations FROM t WHERE filed < traded OR owner IS NULL OR hi > 100000")
def v1_contract_check(spark: SparkSession, d: str) -> DataFrame:
    rules = [("filed before traded", F.col("filed") >= F.col("traded")), ("no owner", F.col("owner").isNotNull()), ("too large", F.col("hi") <= 100000)]
    marked = trades(spark, d).select("rid", gate.reasons(rules).alias("v"))
    return marked.where(F.size("v") > 0).select("rid", F.array_join("v", ",").alias("violations"))


@query(f"""WITH RECURSIVE {FOLD_SQL} SELECT member, security, owner, status, CASE WHEN member % 3 <> 0 AND coalesce(lo, -1) % 2 = 1 THEN 'corroborated' ELSE 'unverified' END AS verification, NOT (member % 3 <> 0 AND coalesce(lo, -1) % 2 = 1) AS changed
FROM p WHERE status <> 'none'""")
def j18_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    now = _positions(spark, d).where("status <> 'none'").select(*positions.KEY, "lo", "hi", "status")
    before = now.where("member % 3 <> 0").withColumn("hi", F.when(F.col("lo") % 2 == 1, F.col("hi")).otherwise(F.col("hi") + 1)).withColumn("verification", F.lit("corroborated"))
    return positions.carry_forward(before, now).select(*positions.KEY, "status", "verification", "changed")


_NAMES = "SELECT p_name AS name, min(p_brand) AS ticker FROM part GROUP BY p_name"


@query(f"""WITH u AS (SELECT upper(replace(ticker, '#', '')) AS ticker, name, ticker || '/' || name AS security, row_number() OVER (ORDER BY name) AS ord FROM ({_NAMES})),
a AS (SELECT DISTINCT 'The ' || p_name || 's Fund' || CASE WHEN p_partkey % 3 = 0 THEN ' (' || upper(replace(p_brand, '#', '')) || ')' ELSE '' END AS text FROM part),
k AS (SELECT ticker, arg_min(security, ord) AS s FROM u GROUP BY ticker),
h AS (SELECT text, arg_max(security, length(name) * 1000000 - ord) AS s FROM a JOIN u ON contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), name) WHERE length(name) >= 6 GROUP BY text)
SELECT a.text, coalesce(k.s, h.s) AS security FROM a LEFT JOIN k ON k.ticker = nullif(regexp_extract(text, '\\(([A-Z][A-Z0-9.-]{{0,9}})\\)', 1), '') LEFT JOIN h ON a.text = h.text""")
def j5_resolve_security(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    ticker = F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("p_brand"))
    universe = portfolio.ranked(names, [F.col("name")], "ord").select(ticker.alias("ticker"), "name", F.concat_ws("/", "p_brand", "name").alias("security"), "ord")
    suffix = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), ticker, F.lit(")"))).otherwise("")
    return resolve.resolve_texts(part.select(F.concat(F.lit("The "), "p_name", F.lit("s Fund"), suffix).alias("text")), universe)


_EVENT = "SELECT event_id, ts, user_id, event_type FROM events"


@query("""WITH f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS signup, min(ts) FILTER (WHERE event_type = 'view' AND value > 40) AS view, min(ts) FILTER (WHERE event_type = 'click' AND value > 50) AS click, min(ts) FILTER (WHERE event_type = 'purchase' AND value > 60) AS purchase FROM events GROUP BY user_id),
s AS (SELECT user_id, unnest([{'position': 1, 'stage': 'signup', 'd': signup}, {'position': 2, 'stage': 'view', 'd': view}, {'position': 3, 'stage': 'click', 'd': click}, {'position': 4, 'stage': 'purchase', 'd': purchase}], recursive := true) FROM f)
SELECT user_id, position, stage, strftime(d, '%Y-%m-%d') AS date, CASE WHEN d IS NOT NULL THEN 'done' WHEN position = min(position) FILTER (WHERE d IS NULL) OVER (PARTITION BY user_id) THEN 'current' ELSE 'pending' END AS state FROM s""")
def g24_w13_stage_strip(spark: SparkSession, d: str) -> DataFrame:
    least = {"signup": None, "view": 40, "click": 50, "purchase": 60}
    first = [F.min(F.when((F.col("event_type") == s) & (F.lit(True) if v is None else F.col("value") > v), F.col("ts"))).cast("date").cast("string").alias(s) for s, v in least.items()]
    return portfolio.stage_strip(table(spark, d, "events").groupBy("user_id").agg(*first), "user_id", tuple(least))


@query(f"WITH l AS ({_EVENT} WHERE event_id % 4 = 0), n AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 4 <> 0 GROUP BY ALL) SELECT event_id, user_id, event_type FROM l UNION ALL SELECT event_id, user_id, event_type FROM n ANTI JOIN l USING (user_id, event_type)")
def b3_append_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return landing.append_ledger(rows.where("event_id % 4 = 0"), rows.where("event_id % 4 <> 0"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, max(ts)::DATE::VARCHAR AS last_seen, count(*) AS events FROM events ANTI JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 95) USING (user_id) GROUP BY user_id")
def s1_f2_unseen(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    seen = rows.where("event_type = 'error' and value > 95").select("user_id").distinct()
    return landing.unseen(rows, seen, "user_id").groupBy("user_id").agg(F.max("ts").cast("date").cast("string").alias("last_seen"), F.count(F.lit(1)).alias("events"))


@query("WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 2 ELSE 1 END) AS l, count(*) AS seen FROM events GROUP BY user_id) SELECT user_id, CASE l WHEN 3 THEN 'conflict' WHEN 2 THEN 'corroborated' ELSE 'unverified' END AS state, seen FROM s")
def s5_verification_state(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "conflict").when(F.col("event_type") == "purchase", "corroborated").otherwise("unverified")
    return feed.verification(table(spark, d, "events").select("user_id", state.alias("state")), "user_id")


@query("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host, len(list_distinct(regexp_extract_all(html, '(?i)\\shref=\"([^\"]*)\"', 1)))::INT AS n_links FROM pages")
def c5_c17_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", K.host_of(F.col("url")).alias("host"), F.size(markup.links(F.col("html"))).alias("n_links"))


@query("""WITH f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents)
SELECT source, doc_id, n_chars FROM f WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 6""")
def w12_news_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return portfolio.newest_distinct(rows, "h", "n_chars", "doc_id").select("source", "doc_id", "n_chars")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 10000000 THEN '$' || floor(o_totalprice / 1000000 + 0.5)::BIGINT || 'M'
    WHEN o_totalprice >= 1000000 THEN '$' || floor(o_totalprice / 100000 + 0.5)::BIGINT // 10 || CASE WHEN floor(o_totalprice / 100000 + 0.5)::BIGINT % 10 = 0 THEN '' ELSE '.' || floor(o_totalprice / 100000 + 0.5)::BIGINT % 10 END || 'M' WHEN o_totalprice >= 1000 THEN '$' || floor(o_totalprice / 1000 + 0.5)::BIGINT || 'K' ELSE '$' || floor(o_totalprice + 0.5)::BIGINT END AS total,
  o_orderkey || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth, floor(o_totalprice / 7 * 10 + 0.5) / 10 AS tenth FROM orders""")
def k5_k35_k42_labels(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", L.usd(total).alias("total"), L.ordinal(F.col("o_orderkey")).alias("nth"), K.round_tenth(total / 7).alias("tenth"))


@query("""SELECT doc_id, md5(trim(regexp_replace(lower(translate(coalesce(text, ''), 'äöüßéèêçñóí', 'äöüßéèêçñóí')), '[^a-z0-9]+', ' ', 'g'))) AS plain, CASE WHEN length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]', '', 'g')) < 40 THEN true ELSE false END AS scanned,
  CASE WHEN length(coalesce(text, '')) > 200 THEN regexp_replace(left(text, 199), '[ \\t\\n\\r\\f\\v]+$', '') || '…' ELSE coalesce(text, '') END AS short FROM documents""")
def k10_k36_f4_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.md5(K.plain_words(text).cast("binary")).alias("plain"), K.looks_scanned(text).alias("scanned"), K.truncated(text, 200).alias("short"))
