"""Small cases of the disclosure operators with values worked out by hand."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as K
from tidemark.functions import labels as L
from tidemark.operators import gate, matching, portfolio, positions, pricing, resolve
from tidemark.sources import landing, markup
from tidemark.streaming import feed

DAY = dt.date.fromisoformat
TRADE = "member string, security string, owner string, side string, partial boolean, lo long, hi long, traded date, filed date, ord long"
BASE = "member string, security string, owner string, lo long, hi long, as_of date"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def folded(spark, events, base=()):
    rows = [("m", "BTC:direct", None, side, partial, lo, hi, DAY(day), DAY(day), i) for i, (side, partial, lo, hi, day) in enumerate(events)]
    baseline = positions.latest_baseline(spark.createDataFrame([("m", "BTC:direct", "self", *b[:2], DAY(b[2])) for b in base], BASE)) if base else None
    r = positions.fold(spark.createDataFrame(rows, TRADE), baseline).collect()
    return [(x.status, x.lo, x.hi, x.n_sources, x.rejects) for x in r]


BOUGHT = (100001, 250000, "2024-12-31")


@pytest.mark.parametrize(
    ("base", "events", "want"),
    [
        ([BOUGHT], [("buy", False, 50001, 100000, "2025-02-01")], ("holds", 150002, 350000, 2, 0)),
        ([BOUGHT], [("sell", True, 15001, 50000, "2025-02-01")], ("holds", 50001, 234999, 2, 0)),
        ([BOUGHT], [("buy", False, 1, 2, "2024-12-31")], ("holds", 100001, 250000, 1, 0)),  # the report counts it already
        ([BOUGHT, BOUGHT], [], ("holds", 200002, 500000, 1, 0)),
        ([], [("buy", False, 1, 10, "2025-01-01"), ("sell", False, 1, 10, "2025-01-02"), ("buy", False, 15001, 50000, "2025-01-03")], ("holds", 15001, 50000, 1, 0)),
        ([], [("sell", True, 1, 10, "2025-01-01")], ("none", None, None, 0, 1)),
        ([], [("sell", False, 5, 10, "2025-01-01")], ("sold", 5, 10, 1, 0)),
        ([], [("buy", False, 1, 10, "2025-01-01"), ("sell", True, 10, 20, "2025-01-02")], ("sold", 1, 10, 2, 0)),
        ([], [("sell", False, 1, 10, "2025-01-01"), ("buy", False, 1, 10, "2025-01-01")], ("sold", 1, 10, 2, 0)),  # purchases first
    ],
)
def test_position_fold(spark, base, events, want):
    assert folded(spark, events, base) == [want]


def test_stale_and_carry_forward(spark):
    rows = [("m", "A:x", "self", "holds", 1, 2, DAY("2020-01-01")), ("m", "B:x", "self", "sold", 1, 2, DAY("2020-01-01"))]
    df = spark.createDataFrame(rows, "member string, security string, owner string, status string, lo long, hi long, as_of date")
    marked = positions.mark_stale(df, F.lit("2022-01-01").cast("date"))
    assert [r.status for r in marked.orderBy("security").collect()] == ["stale", "sold"]
    old = df.withColumn("verification", F.lit("conflict"))
    now = df.withColumn("hi", F.when(F.col("security") == "B:x", 9).otherwise(F.col("hi")))
    got = {r.security: (r.verification, r.changed) for r in positions.carry_forward(old, now).collect()}
    assert got == {"A:x": ("conflict", False), "B:x": ("unverified", True)}


SIDE = "rid string, member string, traded string, side string, asset string, text string, lo long, hi long, ord long"


def test_one_to_one_is_greedy_in_order(spark):
    row = lambda rid, asset, text, lo=1, hi=2, ord=0: (rid, "m", "d", "buy", asset, text, lo, hi, ord)
    own = spark.createDataFrame([row("o1", "A", "alpha corp", 1, 2, 1), row("o2", "B", "alpha corp", 5, 9, 2)], SIDE)
    other = spark.createDataFrame([row("k1", "raw", "alpha", 5, 9, 1), row("k2", "B", "beta", 1, 2, 2), row("k3", "A", "x", 1, 2, 3), row("k4", "A", "x", 1, 2, 4)], SIDE)
    got = {r.rid: (r.official_rid, r.how) for r in matching.one_to_one(own, other).collect()}
    # k1 takes o2 by its text and equal range before k2 could have it by key.
    assert got == {"k1": ("o2", "text"), "k2": (None, "none"), "k3": ("o1", "key"), "k4": (None, "none")}
    assert matching.one_to_one(own.limit(0), other).where("how = 'none'").count() == 4


def test_tiers_skip_ambiguous_keys(spark):
    table = spark.createDataFrame([("m", "a", 1.0, 1), ("m", "a", 1.0, 2), ("m", "b", 2.0, 3)], "member string, text string, ret double, ord long")
    asked = spark.createDataFrame([("m", "a"), ("m", "c"), ("n", "a")], "member string, text string")
    got = {(r.member, r.text): (r.found_ret, r.tier) for r in matching.tiered_lookup(asked, table, [["member", "text"], ["member"]], ["ret"], "ord").collect()}
    assert got == {("m", "a"): (1.0, 1), ("m", "c"): (None, None), ("n", "a"): (None, None)}


def test_names(spark):
    roster = spark.createDataFrame([("A", "José María Núñez Jr.", "house"), ("B", "William Smith", "senate"), ("C", "Bob Smith", "house"), ("D", "Robert Smith", "senate")], "member string, name string, chamber string")
    asked = [("Jose Nunez", "house"), ("Bill Smith", None), ("Smith, X", None), ("Robert Smith", None), ("Jose Nunez", "senate")]
    got = resolve.match_names(spark.createDataFrame(asked, "name string, chamber string"), roster, {"bill": "william", "bob": "robert"})
    assert {(r.name, r.chamber): r.member for r in got.collect()} == {("Jose Nunez", "house"): "A", ("Bill Smith", None): "B"}


def test_security_texts(spark):
    universe = spark.createDataFrame([("s1", "BTC", "Bitcoin", 1), ("s2", "IBIT", "iShares Bitcoin Trust", 2), ("s3", "X", "Coin", 3)], "security string, ticker string, name string, ord long")
    texts = ["iShares Bitcoin Trust ETF", "Bitcoins", "Coinbase", "a Coin b", "Something (X)", "nothing"]
    got = {r.text: r.security for r in resolve.resolve_texts(spark.createDataFrame([(t,) for t in texts], "text string"), universe).collect()}
    assert got == dict(zip(texts, ["s2", "s1", None, "s3", "s3", None], strict=True))


def test_asof_and_weighted_mean(spark):
    prices = spark.createDataFrame([("A", DAY(d), c) for d, c in (("2024-01-05", 10.0), ("2024-01-20", 11.0), ("2024-04-02", 12.0))], "s string, date date, close double")
    asked = spark.createDataFrame([("A", DAY(d)) for d in ("2023-11-01", "2024-01-05", "2024-01-06", "2024-01-21", "2024-02-02", "2024-04-03")] + [("B", DAY("2024-01-01"))], "s string, d date")
    got = {(r.s, str(r.d)): r.entry for r in pricing.asof_forward(asked, prices, "s", "d").collect()}
    assert [got["A", d] for d in ("2023-11-01", "2024-01-05", "2024-01-06", "2024-01-21", "2024-02-02", "2024-04-03")] == [10, 10, 11, 12, 12, None] and got["B", "2024-01-01"] is None
    points = spark.createDataFrame([(1000.0, 10.0, 2.0), (3000.0, 20.0, 6.0), (5.0, None, None)], "w double, ret double, excess double")
    r = points.agg(pricing.weighted_mean(F.col("ret"), F.col("w")).alias("a"), pricing.weighted_mean(F.col("excess"), F.col("w")).alias("b")).first()
    assert (r.a, r.b) == (17.5, 5.0)
    assert points.limit(0).agg(pricing.weighted_mean(F.col("ret"), F.col("w")).alias("a")).first().a is None


def test_portfolio(spark):
    held = [("m", "A", "self", "holds", 1, 15000), ("m", "A", "spouse", "stale", 15001, 50000), ("m", "A", "trust", "sold", 9, 9), ("n", "A", "self", "holds", 1, 2), ("n", "B", "self", "holds", 1, 2)]
    df = spark.createDataFrame(held, "member string, security string, owner string, status string, lo long, hi long")
    r = portfolio.owners(df).where("member = 'm'").first()
    assert (r.lo, r.hi, r.status) == (15002, 65000, "holds")
    roster = spark.createDataFrame([("m", "R", True), ("n", "D", True)], "member string, party string, active boolean")
    buys = spark.createDataFrame([("m", "A", DAY(f"2024-01-{d:02}")) for d in range(1, 15)] + [("m", "A", DAY("2024-01-14"))], "member string, security string, traded date")
    c = portfolio.common_holdings(df, roster, buys).collect()
    assert [(x.security, x.owners, x.party_r, x.party_d, x.party_i, str(x.latest_buy)) for x in c] == [("A", 2, 1, 1, 0, "2024-01-14")]
    # The latest purchase is that of any owner, one that has sold among them.
    more = df.union(spark.createDataFrame([("o", "A", "self", "sold", 1, 2)], df.schema))
    people = spark.createDataFrame([("m", "Mo", "R", "house", "TX", True), ("n", "Al", "D", "house", "TX", True), ("o", "Ed", "D", "house", "TX", True)], "member string, name string, party string, chamber string, state string, active boolean")
    late = buys.union(spark.createDataFrame([("o", "A", DAY("2024-02-01"))], buys.schema))
    assert [str(x.latest_buy) for x in portfolio.common_holdings(more, people, late).collect()] == ["2024-02-01"]
    doc = portfolio.common_documents(more, people, late).first()
    assert (str(doc.latest_buy), doc.owners_count, [(o.name, o.status, len(o.buy_dates)) for o in doc.owners]) == ("2024-02-01", 2, [("Mo", "holds", 10), ("Al", "holds", 0), ("Ed", "sold", 1)])
    days = portfolio.newest_dates(buys).first().dates
    assert [d.day for d in days] == [14, 14, 13, 12, 11, 10, 9, 8, 7, 6]
    strip = portfolio.stage_strip(spark.createDataFrame([(1, "a", None, "c")], "k int, x string, y string, z string"), "k", ("x", "y", "z"))
    assert [r.state for r in strip.orderBy("position").collect()] == ["done", "current", "done"]
    numbers = spark.range(100).select((F.col("id") * 7 % 10).alias("v"), "id")
    ranks = {r.id: r.rank for r in portfolio.ranked(numbers, [F.desc("v"), F.col("id")]).collect()}
    assert ranks == {i: n for n, i in enumerate(sorted(range(100), key=lambda i: (-(i * 7 % 10), i)), 1)}


def test_gate(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (5, None)], "x int, y string")
    good, bad = gate.split(df, [("no x", F.col("x") < 4), ("no y", F.col("y").isNotNull())])
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no x", "no x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: K.round_tenth(F.lit(-0.25)), -0.2), (lambda: K.round_tenth(F.lit(-27.79)), -27.8), (lambda: L.usd(F.lit(1_600_000)), "$1.6M"), (lambda: L.usd(F.lit(12_400_000)), "$12M"), (lambda: L.usd(F.lit(50_000)), "$50K"), (lambda: L.usd(F.lit(800)), "$800"),
        (lambda: L.usd(F.lit(1_000_000)), "$1M"), (lambda: L.usd_range(F.lit(15_001), F.lit(50_000)), "$15K–$50K"), (lambda: L.ordinal(F.lit(112)), "112th"), (lambda: L.ordinal(F.lit(23)), "23rd"), (lambda: K.ticker_in(F.lit("Apple (AAPL) [ST]")), "AAPL"), (lambda: K.ticker_in(F.lit("none")), None),
        (lambda: K.clean_asset(F.lit("Marathon &amp; Co. (MPC) [ST]")), "marathon co"), (lambda: K.without_marks(F.lit("Núñez Žák")), "Nunez Zak"), (lambda: K.is_options(F.lit("Putnam callable fund")), False), (lambda: K.is_options(F.lit("NVDA call option")), True), (lambda: K.is_options(F.lit("x"), F.lit("OPT")), True),
        (lambda: K.claimed_return(F.lit("a loss of 12.5%")), -12.5), (lambda: K.claimed_return(F.lit("gain of 7 %")), 7.0), (lambda: K.claimed_return(F.lit("7% of voters")), None), (lambda: K.district_of(F.lit("AK00")), "AK-AL"), (lambda: K.district_of(F.lit("SC03")), "SC-03"), (lambda: K.district_of(F.lit("x")), None),
        (lambda: K.any_date(F.lit("3/9/2025")), DAY("2025-03-09")), (lambda: K.any_date(F.lit("9-Mar-2025")), DAY("2025-03-09")), (lambda: K.any_date(F.lit("March 9, 2025, 4:00 PM")), DAY("2025-03-09")), (lambda: K.any_date(F.lit("2025-03-09T10:00Z")), DAY("2025-03-09")), (lambda: K.any_date(F.lit("soon")), None),
        (lambda: K.document_channel(F.lit("20012345")), "electronic"), (lambda: K.document_channel(F.lit("8012345")), "paper"), (lambda: K.document_channel(F.lit("1")), "unknown"), (lambda: K.truncated(F.lit("abcd ef"), 6), "abcd…"), (lambda: K.owner_of(F.lit(" SP ")), "spouse"), (lambda: K.owner_of(F.lit("?")), None), (lambda: K.side_of(F.lit("Sale (Partial)")), "sell"),
        (lambda: K.claims_supported(F.array(F.lit(5.0), F.lit(0.0)), F.lit(2.0)), True), (lambda: K.claims_supported(F.array(F.lit(5.0), F.lit(-1.0)), F.lit(2.0)), False), (lambda: K.claims_supported(F.array().cast("array<double>"), F.lit(2.0)), None), (lambda: K.host_of(F.lit("https://www.a.org/x")), "a.org"),
    ],
)
def test_scalars(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(("text", "want"), [("$1,001 - $15,000", (1001, 15000)), ("Over $50,000,000", (50e6, 50e6)), ("None (or less than $1,001)", (0, 1001)), ("1,001 - 15,000", None), ("$1,001 -\n $15,000", (1001, 15000)), ("none", None)])
def test_amounts(spark, text, want):
    band = one(spark, K.amount_band(F.lit(text)))
    assert (band and (band.lo, band.hi)) == want


def test_markup(spark):
    html = '<table><tr><th>a</th></tr></table><table><tr><th>Transaction Date</th></tr><tr><td>1</td><td><b>x &amp; y</b> </td></tr></table><img src="p.gif"><img src="p.gif"><img src="q.gif">'
    rows = one(spark, markup.rows_of(markup.table_with(F.lit(html), "Transaction Date")))
    assert rows == [["1", "<b>x &amp; y</b> "]] and one(spark, markup.text_of(F.lit(rows[0][1]))) == "x & y"
    assert one(spark, markup.links(F.lit(html), "src")) == ["p.gif", "q.gif"]
    assert one(spark, markup.table_with(F.lit(html), "absent")) is None


def test_landing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("2026FD.xml", "<a/>")
        z.writestr("x.txt", "no")
    assert [tuple(r)[1:] for r in landing.read_zip_entries(spark, f"{tmp_path}/*.zip", "FD.xml").collect()] == [("2026FD.xml", "<a/>")]
    assert landing.read_json(spark, str(tmp_path / "absent"), "a int", must_exist=False).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in landing.append_ledger(df.where("k = 2"), df, ["k"], "v").collect()) == [(1, "a"), (2, "c")]
    assert [r.k for r in landing.keep_last(df, "k", ["v"], 1).collect()] == [2]
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        landing.published(spark, out, "t")
    assert landing.published(spark, out, "t", "k int").count() == 0
    landing.publish({"t": df, "u": df.limit(1)}, out, lambda name, got: [])
    with pytest.raises(ValueError, match="u: bad"):
        landing.publish({"t": df.limit(1), "u": df}, out, lambda name, got: ["bad"] if name == "u" else [])
    assert landing.published(spark, out, "t").count() == 3
    landing.publish({"t": df.limit(2)}, out, lambda name, got: [])
    assert landing.published(spark, out, "t").count() == 2 and landing.prune(spark, out) == 1
    assert landing.published(spark, out, "t").count() == 2
    note = f"{tmp_path}/report.json"
    landing.report(spark, note, "gate", "no", {"x": 1.0}, ["w"], ["f"])
    assert spark.read.option("multiLine", True).json(note).first().validation == ["f"]
    landing.withdraw(spark, note)
    assert not landing.exists(spark, note)
    warnings = []
    assert landing.or_last_good("s", lambda: df.select(F.raise_error(F.lit("bad"))), lambda: df, warnings).count() == 3 and len(warnings) == 1
    with pytest.raises(landing.StepError, match="^s: "):
        landing.step("s", lambda: 1 / 0)
    with pytest.raises(landing.StepError, match="^inner: "):
        landing.step("outer", lambda: landing.step("inner", lambda: 1 / 0))


def test_change_feed_and_state(spark, tmp_path):
    schema = "id int, ts timestamp, state string"
    rows = [(1, dt.datetime(2024, 1, 1), "corroborated"), (1, dt.datetime(2024, 1, 2), "unverified"), (2, dt.datetime(2024, 1, 3), "conflict")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        feed.change_feed(source, "id", "ts", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return sorted(r.id for r in feed.rows(spark, f"{tmp_path}/out", schema).collect())

    assert run() == [1, 2]
    spark.createDataFrame([(2, dt.datetime(2024, 1, 4), "conflict"), (3, dt.datetime(2024, 1, 4), "?")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == [1, 2, 3]
    got = {r.id: r.state for r in feed.verification(spark.read.parquet(f"{tmp_path}/in"), "id").collect()}
    assert got == {1: "corroborated", 2: "conflict", 3: "unverified"}
