"""Steps whose work or traffic must not grow faster than their input."""

from pyspark.sql import functions as F

from tidemark.functions.columns import amount_band, found, once, us_date
from tidemark.operators import intake, matching
from tidemark.plans import queries
from tidemark.plans.model import trades
from tidemark.plans.runs import QUERIES
from tidemark.sources import filings, markup

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_roll_call_is_parsed_once(spark):
    assert _plan(QUERIES["c14_g12_roll_calls"](spark, SF)).count("from_xml(") == 1


def test_a_page_is_parsed_once(spark):
    docs = spark.range(1).select(F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"))
    read = filings.ptr_transactions(docs)
    assert _plan(read).count("Filed\\s+") == 1


def test_a_value_used_often_is_computed_once_in_a_lambda(spark):
    row = spark.range(1).select(F.array(F.lit("x 12"), F.lit("x"), F.lit(None).cast("string")).alias("a")).select(F.transform("a", lambda x: found(x, r"(\d+)")).alias("f"))
    assert row.first().f == ["12", None, None]
    assert _plan(spark.range(1).select(F.transform(F.array(F.col("id").cast("string")), lambda x: found(x, r"(\d+)")).alias("f"))).count("regexp_extract(") == 1
    assert [r.x for r in spark.createDataFrame([(1,), (None,)], "i int").select(once(F.col("i"), lambda i: i + 1).alias("x")).collect()] == [2, None]


def test_texts_of_cells_at_once_are_those_of_each(spark):
    cells = ["a <b>c</b>", " ", "", "<div\n>x  y</div> ", "a < b", "c > d", "&amp;lt; &#233;&#x41;&bad; &#32;", "x & y", "e\tf\n\n g", "é z", "&nbsp;"]
    arrays = [cells, ["a\x1fb", "c&#31;d"], ["c&#31;d", "<i>e"], [""], [" ", " "], []]
    rows = spark.createDataFrame([(a,) for a in arrays], "a array<string>").select(markup.texts_of(F.col("a")).alias("now"), F.transform("a", markup.text_of).alias("each")).collect()
    assert all(r.now == r.each for r in rows)
    assert rows[0].now[6] == "&lt; éA&bad;"


def test_ends_of_lines_of_layout_text(spark):
    text = "SP   Fund A   P   01/02/2024 01/03/2024   $1,001 - $15,000\r\n  (ABéC)\r more\r\n\n  F S: New\nJT   Fund B   S (partial)   01/02/2024 01/03/2024   $1,001 -\n  more of it     $15,000\n  Type\n"
    rows = filings.layout_transactions(spark.createDataFrame([(text,)], "text string")).orderBy("line").collect()
    assert [(r.line, r.owner_code, r.asset, r.type_code, r.partial, r.lo, r.hi) for r in rows] == [(0, "SP", "Fund A (AB C) more", "P", False, 1001.0, 15000.0), (4, "JT", "Fund B more of it", "S", True, 1001.0, 15000.0)]


def _side(spark, *rows):
    return spark.createDataFrame([(m, "2024-01-01", "buy", a, o, o, "text", 1, 2, f) for m, a, o, f in rows], "member long, traded string, side string, asset string, ord string, rid string, text string, lo long, hi long, filed string")


def test_a_key_pass_moves_rows_once(spark):
    own, other = _side(spark, (1, "A", "o2", "x"), (1, "A", "o1", "x"), (2, None, "o3", "x"), (1, "B", "o4", "x")), _side(spark, (1, "A", "k9", "y"), (1, "A", "k5", "y"), (1, "A", "k7", "y"), (2, None, "k1", "y"))
    found = matching.key_pass(own, other)
    assert sorted(map(tuple, found.collect())) == [("k5", "o1"), ("k7", "o2")]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_matches_carry_columns_of_both_sides(spark):
    own, other = _side(spark, (1, "A", "o1", "x")), _side(spark, (1, "A", "k1", "y"), (3, "A", "k2", "z"))
    got = {r.rid: (r.official_rid, r.how, r.filed, r.official_filed, r.lo, r.official_lo) for r in matching.one_to_one(own, other, carry=["filed", "lo"]).collect()}
    assert got == {"k1": ("o1", "key", "y", "x", 1, 1), "k2": (None, "none", "z", None, 1, None)}


def test_trades_are_joined_once_and_only_what_is_read_is_written(spark):
    assert set(queries._once(spark, SF, "rid", "lo", where="side = 'buy'").columns) == {"rid", "lo"}
    assert "l_orderkey" not in _plan(QUERIES["j13_asof_forward"](spark, SF))


def test_landed_pages_are_no_file_each(spark):
    read = QUERIES["a10_a11_search_scan"](spark, SF).inputFiles()
    assert len(read) < 40 and not any(f.endswith(".txt") for f in read)


def test_a_grouping_by_order_moves_no_trade_again(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = trades(spark, SF, by_order=True).groupBy("orderkey", "filed").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == 4  # both sides of two joins


def test_an_amount_and_a_date_are_looked_at_once(spark):
    texts = ["$1,001 - $15,000", "Over $50", "less  than $7", "$1 -", "$, - $5", "over $2 x $3-$4", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(amount_band(F.col("t")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in rows] == [(1001.0, 15000.0), (50.0, 50.0), (0.0, 7.0), None, None, (3.0, 4.0), None]
    assert _plan(spark.range(1).select(amount_band(F.col("id").cast("string")).alias("b"))).count("regexp_extract(") == 3
    dates = spark.createDataFrame([(t,) for t in ("2/29/2020", "2/29/2021", "1/2/20", " 12/31/2020 ", "2020-01-02", None)], "t string").select(us_date(F.col("t")).cast("string").alias("d"))
    assert [r.d for r in dates.collect()] == ["2020-02-29", None, None, "2020-12-31", None, None]
    assert "gettimestamp" not in _plan(dates)


def test_cells_of_long_rows_need_no_stack(spark):
    html = "<TR a><td>" + "<b>x</b > " * 50000 + "</TD><td>y</td></tr><tr><td>z"
    rows = spark.createDataFrame([(html,)], "h string").select(F.transform(markup.rows_of(F.col("h")), markup.texts_of).alias("t")).first().t
    assert rows == [[" ".join(["x"] * 50000), "y"]]


def test_rows_that_are_no_trades_are_moved_without_their_columns(spark):
    columns = {"id": "r1", "ord": "1", "source_id": "house_clerk", "transaction_date": "2024-01-01", "filing_date": "2024-01-02", "owner": "SP", "ticker": None, "asset_name": "Fund", "asset_type": "ST", "transaction_type": "Purchase", "amount_range_low": 1.0,
               "amount_range_high": 2.0, "is_late": 0, "comment": None, "doc_url": "https://x.org/1", "filer_id": None, "filer_name": "Ann Oda", "branch": "congress", "chamber": "house", "party": "R"}
    schema = ", ".join(f"{c} {'double' if c.startswith('amount') else 'int' if c == 'is_late' else 'string'}" for c in columns)
    odd = [{}, {"ord": "2"}, {"id": "r2", "ord": "3", "branch": "executive"}, {"id": None, "ord": "5", "filer_name": "Bo Lee"}, {"id": None, "ord": "4"}, {"id": "", "ord": "6", "transaction_type": "Exchange"}]
    rows = spark.createDataFrame([tuple({**columns, **o}.values()) for o in odd], schema)
    roster = spark.createDataFrame([(7, "Ann Oda", "house")], "member long, name string, chamber string")
    none = spark.createDataFrame([], "security string, ticker string, name string, kind string, aliases array<string>, ord int")
    good, bad, lost = intake.normalize_third(rows, roster, none)
    assert sorted((r.ord, r.member, r.security, r.lo) for r in good.collect()) == [("1", 7, None, 1.0), ("4", 7, None, 1.0)]
    assert sorted((r.ord, r.reason) for r in bad.collect()) == [("2", "duplicate row id"), ("3", "non-congress filer"), ("5", "duplicate row id"), ("6", "unsupported transaction_type: Exchange")]
    judged = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in bad.inputFiles()})
    assert "transaction_type" not in judged.columns and judged.where("reason is not null and url is not null").count() == 0
    assert lost.count() == 0


def test_rows_of_a_search_are_dealt_and_their_link_is_looked_for_once(spark):
    link = '<a href="/search/view/{}/0a1b2c3d-0000-0000-0000-000000000001/" target="_blank">{}</a>'
    cells = [["Al", "Oda, ", "Senator", link.format("annual", "New  Filer Report"), "1/2/2020"], ["Bo", "Lee", "Senator", link.format("PAPER", "Periodic\x1f$1 Transaction"), "01/02/2020"]]
    rows = spark.createDataFrame([(c,) for c in cells], "cells array<string>").coalesce(1)
    got = filings.search_rows(rows)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.last, r.kind, r.channel, r.title, r.filed.isoformat()) for r in got.collect()) == [("Lee", "other", "paper", "Periodic\x1f$1 Transaction", "2020-01-02"), ("Oda", "annual", "electronic", "New Filer Report", "2020-01-02")]
    assert _plan(rows.select(filings.hit_rows(F.col("cells")).alias("h"))).count("regexp_extract(") == 2  # the link and the date


def test_actions_are_sorted_without_an_interpreted_comparison(spark):
    assert "array_sort(" not in _plan(QUERIES["c9_g24_w13_bills"](spark, SF))


def test_plain_texts_are_read_without_a_pattern(spark, monkeypatch):
    cells = ["plain", " a - b ", "", "x > y", "--"]
    monkeypatch.setattr(markup, "_BLANKS", "(")  # no pattern: whoever looks for it fails
    rows = spark.createDataFrame([(cells,)], "a array<string>").select(markup.texts_of(F.col("a")).alias("all"), F.transform("a", markup.text_of).alias("each"))
    assert rows.first() == (["plain", "a - b", "", "x > y", "--"],) * 2


def test_texts_with_uneven_white_space_or_tags(spark):
    cells = ["a  b", "a\tb", "\n a", "a\x0b\x0cb\r", " a", "a <b>c</b>d", "a&nbsp;&nbsp;b", "<i> </i>", "a\x1f  b"]
    want = ["a b", "a b", "a", "a b", "a", "a c d", "a b", "", "a\x1f b"]
    rows = spark.createDataFrame([(cells,)], "a array<string>").select(markup.texts_of(F.col("a")).alias("all"), F.transform("a", markup.text_of).alias("each"), F.transform("a", lambda c: markup.texts_of(F.array(c))[0]).alias("one"))
    assert rows.first() == (want,) * 3


def test_names_of_assets(spark):
    row = lambda name: f"<tr><td>1</td><td>{name}</td><td>ETF</td><td>Self</td><td>$1,001 - $15,000</td></tr>"
    names = ["<a>T</a> -  Fund  A\n<i>x</i> Description: d", "- - B", "<A HREF='x'>\nT </A>C", "<a>T</a> d <a>U</a> e", "&#45; F", "Description: g"]
    docs = spark.createDataFrame([(i, f"Part 3. Assets<table>{row(n)}</table>") for i, n in enumerate(names)], "i int, html string")
    got = filings.annual_assets(docs).orderBy("i").collect()
    assert [(r.ticker, r.asset, r.lo, r.hi) for r in got] == [(t, a, 1001.0, 15000.0) for t, a in (("T", "Fund A x"), (None, "- B"), ("T", "C"), ("T", "d e"), (None, "F"), (None, ""))]
