"""Registered queries of the parsers and resolvers: documents are written from the test tables, all rows of them, and
parsed again, so the SQL that makes the expected rows needs no parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as K
from tidemark.functions import labels as L
from tidemark.operators import bill, intake, portfolio, resolve
from tidemark.plans.model import MEMBERS_SQL, TRADES_SQL, members, table, trades
from tidemark.plans.queries import ORACLES, QUERIES, query  # noqa: F401
from tidemark.shared import stored
from tidemark.sources import bills, filings, landing

_LABELS = ("Self", "Spouse", "Joint", "Dependent Child", "Other")
_OWNER = "CASE line % 5 WHEN 0 THEN 'self' WHEN 1 THEN 'spouse' WHEN 2 THEN 'joint' WHEN 3 THEN 'dependent' END"


def _us(c: str) -> Column:
    return F.date_format(c, "MM/dd/yyyy")


def _dollars(c: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.col(c), 0))


def _pick(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def _td(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def _joined(row: Column, order: str = "rid") -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r"))))["r"], "\n")


@query(f"""WITH {TRADES_SQL} SELECT orderkey, line AS row, filed::VARCHAR AS filed, traded::VARCHAR AS traded, {_OWNER} AS owner, CASE WHEN line % 4 <> 0 THEN ticker END AS ticker, text AS asset, CASE WHEN line % 3 = 0 THEN 'Company: ' || kind || ' & Co' END AS detail,
  CASE WHEN side = 'buy' THEN 'Purchase' WHEN partial THEN 'Sale (Partial)' ELSE 'Sale (Full)' END AS type, CASE WHEN line = 7 THEN 0 ELSE lo END::BIGINT AS lo, CASE WHEN line = 6 THEN lo ELSE hi END::BIGINT AS hi, CASE WHEN line % 2 = 0 THEN 'é ' || line END AS comment
FROM t""")
def c3_c7_electronic_pages(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d, by_order=True)
    amount = F.when(F.col("line") == 6, F.concat(F.lit("Over "), _dollars("lo"))).when(F.col("line") == 7, F.concat(F.lit("None (or less than "), _dollars("hi"), F.lit(")"))).otherwise(F.concat(_dollars("lo"), F.lit(" - "), _dollars("hi")))
    detail = F.when(F.col("line") % 3 == 0, F.concat(F.lit("<div class='m'><em>Company:</em> "), "kind", F.lit(" &amp; Co</div>"))).otherwise("")
    kind = F.when(F.col("side") == "buy", "Purchase").when(F.col("partial"), "Sale (Partial)").otherwise("Sale (Full)")
    cells = _td(
        F.col("line").cast("string"), _us("traded"), _pick(_LABELS, F.col("line") % 5), F.when(F.col("line") % 4 == 0, "--").otherwise(F.concat(F.lit("<a>"), "ticker", F.lit("</a>"))), F.concat("text", detail), F.lit("Stock"), kind, amount,
        F.when(F.col("line") % 2 == 0, F.concat(F.lit("&#233; "), F.col("line").cast("string"))).otherwise("--"),
    )
    # A page has one stamp: rows of an order with another filing date are a page of their own.
    pages = t.groupBy("orderkey", "filed").agg(_joined(cells).alias("rows"))
    html = F.concat(F.lit("<p>Filed "), _us("filed"), F.lit("</p><table><tr><th>Other</th></tr></table><table><tr><th>Transaction Date</th></tr>"), "rows", F.lit("</table>"))
    found = filings.ptr_transactions(pages.select("orderkey", html.alias("html")))
    text = lambda c: F.col(c).cast("string").alias(c)
    return found.select("orderkey", "row", text("filed"), text("traded"), "owner", "ticker", "asset", "detail", F.col("kind").alias("type"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "comment")


@query(f"""WITH {TRADES_SQL} SELECT orderkey, text || ' (' || ticker || ') [ST]' AS asset, side, coalesce(CASE line % 4 WHEN 1 THEN 'spouse' WHEN 2 THEN 'joint' WHEN 3 THEN 'dependent' END, 'self') AS owner, lo, hi, traded::VARCHAR AS traded, filed > traded + 45 AS late,
  CASE WHEN partial THEN 'partial sale' END AS note FROM t WHERE line <> 5""")
def c2_p1_layout_text(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d, by_order=True)
    code = F.when(F.col("line") % 4 == 1, "SP   ").when(F.col("line") % 4 == 2, "JT   ").when(F.col("line") % 4 == 3, "DC   ").otherwise("     ")
    kind = F.when(F.col("line") == 5, "E").when(F.col("side") == "buy", "P").when(F.col("partial"), "S (partial)").otherwise("S")
    wrapped = F.col("line") % 3 == 0
    head = F.concat(F.lit("   "), code, "text", F.lit("   "), kind, F.lit("   "), _us("traded"), F.lit(" "), _us("filed"), F.lit("   "), _dollars("lo"), F.lit(" -"), F.when(wrapped, "").otherwise(F.concat(F.lit(" "), _dollars("hi"))))
    rest = F.concat(F.lit("        ("), "ticker", F.lit(") [ST]"), F.when(wrapped, F.concat(F.lit("          "), _dollars("hi"))).otherwise(""))
    text = F.concat_ws("\n", head, rest, F.lit("        F      S        : New"), F.lit("        not a part of it"), F.lit(""))
    docs = t.groupBy("orderkey", "filed").agg(_joined(text).alias("text"))
    rows = filings.layout_transactions(docs).withColumns({"member": F.lit("M"), "security": F.lit(None).cast("string"), "year": F.lit(2026), "doc_id": F.col("orderkey").cast("string")})
    found, _ = intake.house_trades(rows)
    number = F.regexp_extract("url", r"/(\d+)\.pdf$", 1).cast("long").alias("orderkey")
    return found.select(number, "asset", "side", "owner", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("traded").cast("string").alias("traded"), "late", "note")


@query("""SELECT s_suppkey AS supplier, s_name || ' & <Co>' AS last, 'N' || s_nationkey AS first, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 2000 + s_suppkey % 20 END AS year, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE make_date(2000 + (s_suppkey % 20)::INT, 3, (1 + s_suppkey % 28)::INT)::VARCHAR END AS filed,
  CASE WHEN s_nationkey = 0 THEN 'TX-AL' ELSE 'TX-' || lpad(s_nationkey::VARCHAR, 2, '0') END AS district, CASE WHEN s_suppkey % 3 = 0 THEN 'electronic' WHEN s_suppkey % 3 = 1 THEN 'paper' ELSE 'unknown' END AS channel FROM supplier""")
def c1_f3_k18_index(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("no_date", F.col("s_suppkey") % 9 == 0)
    number = F.col("s_suppkey").cast("string")
    doc_id = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("2"), F.lpad(number, 7, "0"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("8"), F.lpad(number, 6, "0"))).otherwise(F.concat(F.lit("x"), number))
    year = F.lit(2000) + F.col("s_suppkey") % 20
    date = F.when(F.col("no_date"), "").otherwise(F.concat(F.lit("3/"), (F.lit(1) + F.col("s_suppkey") % 28).cast("string"), F.lit("/"), year.cast("string")))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    last = F.concat("s_name", F.lit(" &amp; &lt;Co&gt;"))
    block = F.concat(
        F.lit("<Member><Prefix />"), tag("Last", last), tag("First", F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))), F.lit("<Suffix/>"), tag("FilingType", F.lit("P")), tag("StateDst", F.concat(F.lit("TX"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))),
        tag("Year", F.when(F.col("no_date"), "").otherwise(year.cast("string"))), tag("FilingDate", date), tag("DocID", doc_id), F.lit("</Member>"),
    )
    docs = s.withColumn("block", block).groupBy(F.floor(F.col("s_suppkey") / 500).alias("doc")).agg(F.concat(F.lit("<FD>"), _joined(F.col("block"), "s_suppkey"), F.lit("</FD>")).alias("xml"))
    rows = filings.house_index(docs)
    supplier = F.regexp_extract("doc_id", r"^(?:[28]0*|x)(\d+)$", 1).cast("long").alias("supplier")
    return rows.select(supplier, "last", "first", F.nullif(F.col("year"), F.lit(0)).cast("long").alias("year"), F.col("filed").cast("string").alias("filed"), K.district_of(F.col("state_dst")).alias("district"), K.document_channel(F.col("doc_id")).alias("channel"))


_ORDERS_SQL = "o AS (SELECT *, o_orderkey % 5 AS k, CASE WHEN o_totalprice <= 100000 THEN 1001 ELSE 100001 END AS lo, CASE WHEN o_totalprice <= 100000 THEN 100000 ELSE 1000000 END AS hi FROM orders)"


@query(f"""WITH {_ORDERS_SQL} SELECT o_orderkey AS orderkey, 'Fund ' || o_orderpriority AS asset, CASE k WHEN 0 THEN 'self' WHEN 1 THEN 'spouse' WHEN 2 THEN 'joint' WHEN 3 THEN 'dependent' END AS owner, CASE WHEN o_orderkey % 7 <> 0 THEN lo END::BIGINT AS lo, CASE WHEN o_orderkey % 7 <> 0 THEN hi END::BIGINT AS hi,
  CASE WHEN k = 4 THEN 'unrecognized owner' WHEN o_orderkey % 7 = 0 THEN 'no value band' ELSE 'holds' END AS result FROM o""")
def c4_p3_annual_reports(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"lo": F.when(F.col("o_totalprice") <= 100000, 1001).otherwise(100001), "hi": F.when(F.col("o_totalprice") <= 100000, 100000).otherwise(1000000)})
    band = F.when(F.col("o_orderkey") % 7 == 0, "--").otherwise(F.concat(_dollars("lo"), F.lit(" - "), _dollars("hi")))
    name = F.concat(F.lit("<a href='x'>T"), F.col("o_orderkey").cast("string"), F.lit("</a> - Fund "), "o_orderpriority", F.lit(" Description: of it"))
    cells = _td(F.col("o_orderkey").cast("string"), name, F.lit("ETF"), _pick(_LABELS, F.col("o_orderkey") % 5), band)
    # A report for each customer and hundred days of orders: none grows with the table.
    pages = o.groupBy("o_custkey", F.floor(F.unix_date(F.col("o_orderdate").cast("date")) / 100).alias("part")).agg(_joined(cells, "o_orderkey").alias("rows"))
    html = F.concat(F.lit("<h3>Part 2.</h3><table><tr><td>0</td><td>a</td><td>b</td><td>Self</td><td>$1 - $2</td></tr></table><h3>Part 3. Assets</h3><table><tr><td>short</td></tr>"), "rows", F.lit("</table><h3>Part 4a. Other</h3><table><tr><td>0</td><td>a</td><td>b</td><td>Self</td><td>$1 - $2</td></tr></table>"))
    rows = filings.annual_assets(pages.select("o_custkey", html.alias("html")))
    rows = rows.withColumns({"filing": F.substring("ticker", 2, 99), "member": F.lit("M"), "security": F.col("ticker"), "url": F.lit("u"), "title": F.lit("Annual"), "filed": F.lit("2026-05-15").cast("date")})
    rows = stored(rows)
    good, bad = intake.senate_holdings(rows)
    reasons = bad.select(F.col("filing").cast("long").alias("orderkey"), F.when(F.contains("reason", F.lit("unrecognized owner")), "unrecognized owner").otherwise("no value band").alias("result"))
    results = good.select(F.substring("security", 2, 99).cast("long").alias("orderkey"), F.col("status").alias("result")).unionByName(reasons)
    kept = rows.select(F.col("filing").cast("long").alias("orderkey"), "asset", "owner", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    return kept.join(results, "orderkey")


@query("""SELECT c_custkey AS customer, CASE c_custkey % 4 WHEN 2 THEN 'paper' ELSE 'electronic' END AS channel, CASE c_custkey % 4 WHEN 0 THEN 'ptr' WHEN 1 THEN 'annual' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'ptr' ELSE 'annual' END ELSE 'other' END AS kind,
  c_name AS last, make_date(2020, 1 + (c_custkey % 12)::INT, 1 + (c_custkey % 28)::INT)::VARCHAR AS filed FROM customer""")
def c6_search_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    kind = F.col("c_custkey") % 4
    title = F.when(kind == 3, "Extension  Notice").when((kind == 2) & (F.col("c_custkey") % 3 == 0), "Periodic\n Transaction Report").otherwise("Annual Report for 2020")
    id_ = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    link = F.concat(F.lit('<a href="/search/view/'), _pick(("ptr", "annual", "paper", "regular"), kind), F.lit("/"), id_, F.lit('/" target="_blank">'), title, F.lit("</a>"))
    date = F.concat_ws("/", (F.lit(1) + F.col("c_custkey") % 12).cast("string"), (F.lit(1) + F.col("c_custkey") % 28).cast("string"), F.lit("2020"))
    rows = c.select(F.array(F.lit("First"), F.concat("c_name", F.lit(",  ")), F.lit("Senator"), link, date).alias("cells"))
    found = filings.search_rows(rows)
    return found.select(F.right("filing", F.lit(12)).cast("long").alias("customer"), "channel", "kind", "last", F.col("filed").cast("string").alias("filed"))


_ACTIONS = (("", "nothing", ""), ("1000", "Introduced in House", ""), ("8000", "On passage", ""), ("", "Received in the Senate &amp; read", ""), ("14000", "Committee on Banking. Reported by Senator X", ""), ("", "Cloture motion presented", ""), ("17000", "Passed Senate", ""), ("", "Signed", "BecameLaw"))


@query(f"""WITH {TRADES_SQL}, a AS (
  SELECT orderkey, traded, min(filed) FILTER (WHERE line = 1) AS i, min(filed) FILTER (WHERE line = 2) AS h, min(filed) FILTER (WHERE line = 3) AS r, min(filed) FILTER (WHERE line = 5) AS c, min(filed) FILTER (WHERE line = 6) AS p, min(filed) FILTER (WHERE line = 7) AS l FROM t GROUP BY ALL
), b AS (SELECT a.*, min(t.filed) FILTER (WHERE line = 4) AS s, coalesce(bool_or(line = 4 AND side = 'sell'), false) AS x FROM a LEFT JOIN t ON a.orderkey = t.orderkey AND t.filed >= a.r GROUP BY ALL)
SELECT orderkey, coalesce(i, traded)::VARCHAR AS introduced, h::VARCHAR AS house_passed, s::VARCHAR AS senate_reported, c::VARCHAR AS senate_cloture, p::VARCHAR AS senate_passed, l::VARCHAR AS became_law, x AS substitute_in_play, p IS NOT NULL AND x AS requires_repassage,
  list_position([h IS NULL, s IS NULL, p IS NULL, true], true) AS reached, 'H.R. ' || orderkey AS label FROM b""")
def c9_g24_w13_bills(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d, by_order=True)
    field = lambda i: _pick(tuple(a[i] for a in _ACTIONS), F.col("line"))
    text = F.concat(field(1), F.when((F.col("line") == 4) & (F.col("side") == "sell"), " with an amendment in the nature of a substitute").otherwise(""))
    item = F.concat(F.lit("<item><actionDate>"), F.col("filed").cast("string"), F.lit("</actionDate><text>"), text, F.lit("</text><type>"), field(2), F.lit("</type><actionCode>"), field(0), F.lit("</actionCode></item>"))
    docs = t.groupBy("orderkey", "traded").agg(_joined(item).alias("items"))
    xml = F.concat(F.lit("<billStatus><bill><congress>119</congress><type>HR</type><number>1</number><title>t</title><introducedDate>"), F.col("traded").cast("string"), F.lit("</introducedDate><actions>"), "items", F.lit("</actions></bill></billStatus>"))
    status = bills.bill_status(docs.select("orderkey", xml.alias("xml")))
    none = F.array().cast("array<struct<number: int, date: date, question: string, kind: string, result: string, yeas: int, nays: int, url: string>>")
    marked = bill.milestones(status.withColumn("hits", none))
    day = lambda m: F.col(f"{m}.date").cast("string").alias(m)
    strip = bill.stages(marked)
    reached = F.array_position(F.transform(strip, lambda s: s["status"]), "current").cast("int") - 1
    return marked.select("orderkey", *map(day, ("introduced", "house_passed", "senate_reported", "senate_cloture", "senate_passed", "became_law")), "substitute_in_play", "requires_repassage", reached.alias("reached"), L.bill_label(F.lit("hr"), F.col("orderkey").cast("string")).alias("label"))


@query(f"""WITH {TRADES_SQL}, v AS (SELECT orderkey, ['R', 'D', 'I'][(member % 3 + 1)::INT] AS party, line % 6 AS v FROM t)
SELECT orderkey, count(*) FILTER (WHERE v < 5) AS members, party_n.party, party_n.yea, party_n.nay, party_n.present, party_n.not_voting FROM v JOIN (
  SELECT orderkey, party, count(*) FILTER (WHERE v IN (0, 1)) AS yea, count(*) FILTER (WHERE v = 2) AS nay, count(*) FILTER (WHERE v = 3) AS present, count(*) FILTER (WHERE v = 4) AS not_voting FROM v WHERE v < 5 GROUP BY ALL
) party_n USING (orderkey) GROUP BY ALL""")
def c14_g12_roll_calls(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d, by_order=True)
    cast = _pick(("Yea", "Guilty", "Nay", "Present", "Absent", "Unknown"), F.col("line") % 6)
    row = F.concat(F.lit("<member><member_full>M</member_full><party>"), _pick(("R", "D", "I"), F.col("member") % 3), F.lit("</party><state>TX</state><vote_cast>"), cast, F.lit("</vote_cast><lis_member_id>S"), F.col("member").cast("string"), F.lit("</lis_member_id></member>"))
    docs = t.groupBy("orderkey").agg(_joined(row).alias("rows"))
    xml = F.concat(F.lit("<roll_call_vote><congress>119</congress><vote_date>January 5, 2026,  05:31 PM</vote_date><question>On Passage</question><vote_result>Passed</vote_result><members>"), "rows", F.lit("</members></roll_call_vote>"))
    found = bills.senate_detail(docs.select("orderkey", xml.alias("xml")))
    # An inner explode filters by the map's size below the parser, which would parse each document again.
    parties = found.select("orderkey", F.size("members").cast("long").alias("members"), F.explode_outer("by_party").alias("party", "n")).where("party is not null")
    return parties.select("orderkey", "members", "party", *[F.col(f"n.{v}").cast("long").alias(v) for v in ("yea", "nay", "present", "not_voting")])


_LETTERS = ("0123456789", "abcdefghij")
_THIRD_SQL = f"""{TRADES_SQL}, x AS (SELECT *, translate(member::VARCHAR, '{_LETTERS[0]}', '{_LETTERS[1]}') AS surname FROM t), r AS (
  SELECT rid, 'r' || orderkey || '-' || (line % 5) AS id, orderkey, line, part, member, surname, traded, filed, lo, hi, text, ticker, side, partial FROM x
), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rid) AS n FROM r)"""


@query(f"""WITH {_THIRD_SQL} SELECT rid, CASE WHEN n > 1 THEN 'duplicate row id' WHEN CASE WHEN part % 4 = 0 THEN line % 3 = 2 ELSE member % 10 = 9 END THEN 'non-congress filer'
  WHEN member % 17 = 3 THEN 'phantom filer (no party): ' || CASE WHEN orderkey % 101 = 7 THEN 'unknown' WHEN member % 13 = 4 THEN 'Zed Unknown' ELSE 'Bob ' || surname || ' Jr.' END
  WHEN orderkey % 101 = 7 THEN 'row has no filer name' WHEN member % 13 = 4 THEN 'filer not in member roster: Zed Unknown' WHEN member % 19 = 6 THEN 'filer not in member roster: Bob ' || surname || ' Jr.'
  WHEN part % 11 = 0 THEN 'unsupported transaction_type: Exchange' WHEN part % 23 = 0 THEN 'missing amount range' WHEN orderkey % 37 = 0 THEN 'missing/invalid transaction_date' WHEN orderkey % 41 = 0 THEN 'missing/invalid filing_date'
  WHEN orderkey % 29 = 0 THEN 'missing doc_url' WHEN part % 31 = 0 THEN 'no asset text' END AS reason, CASE WHEN reason IS NULL THEN member END AS member, CASE WHEN reason IS NULL THEN side END AS side, CASE WHEN reason IS NULL THEN lo END AS lo, CASE WHEN reason IS NULL THEN hi END AS hi, CASE WHEN reason IS NULL THEN traded::VARCHAR END AS traded
FROM f""")
def p4_u3_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).withColumn("surname", F.translate(F.col("member").cast("string"), *_LETTERS))
    c = F.col
    rows = t.select(
        F.concat(F.lit("r"), c("orderkey").cast("string"), F.lit("-"), (c("line") % 5).cast("string")).alias("id"), c("rid").alias("ord"), _pick(("house_clerk", "senate_efd", "oge"), c("line") % 3).alias("source_id"),
        F.when(c("orderkey") % 37 == 0, "n/a").otherwise(c("traded").cast("string")).alias("transaction_date"), F.when(c("orderkey") % 41 != 0, c("filed").cast("string")).alias("filing_date"), F.lit("SP").alias("owner"), F.lit(None).cast("string").alias("ticker"),
        F.when(c("part") % 31 == 0, "  ").otherwise(c("text")).alias("asset_name"), F.lit("ST").alias("asset_type"), F.when(c("part") % 11 == 0, "Exchange").when(c("side") == "buy", "Purchase").when(c("partial"), "Sale (Partial)").otherwise("Sale").alias("transaction_type"),
        c("hi").cast("double").alias("amount_range_low"), F.when(c("part") % 23 != 0, c("lo").cast("double")).alias("amount_range_high"), F.lit(1).alias("is_late"), F.lit(None).cast("string").alias("comment"),
        F.when(c("orderkey") % 29 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x.org/"), c("orderkey").cast("string"))).alias("doc_url"), F.lit(None).cast("string").alias("filer_id"),
        F.when(c("orderkey") % 101 == 7, None).when(c("member") % 13 == 4, "Zed Unknown").otherwise(F.concat(F.lit("Bob "), "surname", F.lit(" Jr."))).alias("filer_name"), F.when(c("part") % 4 == 0, None).when(c("member") % 10 == 9, "executive").otherwise("congress").alias("branch"),
        F.when(c("member") % 19 == 6, "none").otherwise("house").alias("chamber"), F.when(c("member") % 17 == 3, "").otherwise("R").alias("party"),
    )
    roster = members(spark, d).select("member", F.concat(F.lit("Robert "), F.translate(c("member").cast("string"), *_LETTERS)).alias("name"), F.lit("house").alias("chamber"))
    none = spark.createDataFrame([], "security string, ticker string, name string, kind string, aliases array<string>, ord int")
    good, bad, _ = intake.normalize_third(rows, roster, none)
    out = good.select(c("ord").alias("rid"), F.lit(None).cast("string").alias("reason"), "member", "side", c("lo").cast("long").alias("lo"), c("hi").cast("long").alias("hi"), c("traded").cast("string").alias("traded"))
    return out.unionByName(bad.select(c("ord").alias("rid"), "reason"), allowMissingColumns=True)


@query(f"""WITH {MEMBERS_SQL}, r AS (SELECT member, translate((member % 40)::VARCHAR, '{_LETTERS[0]}', '{_LETTERS[1]}') AS surname, state, member % 3 AS district FROM m WHERE chamber = 'house'), f AS (SELECT c_custkey AS filing, translate((c_custkey % 40)::VARCHAR, '{_LETTERS[0]}', '{_LETTERS[1]}') AS surname, n_name AS state, c_custkey % 3 AS district FROM customer JOIN nation ON c_nationkey = n_nationkey),
j AS (SELECT filing, count(*) AS n, min(member) AS m, count(*) FILTER (WHERE r.district = f.district) AS n_near, min(member) FILTER (WHERE r.district = f.district) AS near FROM f JOIN r USING (surname, state) GROUP BY filing)
SELECT filing, CASE WHEN n = 1 THEN m WHEN n_near = 1 THEN near END AS member FROM j WHERE n = 1 OR n_near = 1""")
def j1_house_members(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.translate((F.col(c) % 40).cast("string"), *_LETTERS)
    roster = members(spark, d).select("member", F.concat(F.lit("Ánn Q. "), name("member"), F.lit(", Jr.")).alias("name"), "chamber", "state", (F.col("member") % 3).alias("district"))
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    c = table(spark, d, "customer")
    rows = c.join(nations, c["c_nationkey"] == nations["n_nationkey"]).select(F.col("c_custkey").alias("filing"), name("c_custkey").alias("last"), "state", (F.col("c_custkey") % 3).alias("district"))
    return resolve.house_members(rows, roster)


_PARTS_SQL = "p AS (SELECT p_partkey, 'T' || (p_partkey % 200) AS ticker, 'name ' || (p_partkey % 150) AS name, p_partkey % 200 < 20 OR p_partkey % 7 = 0 AS direct FROM part)"


@query(f"""WITH {_PARTS_SQL}, k AS (SELECT ticker, count(*) AS n, coalesce(min(p_partkey) FILTER (WHERE NOT direct), min(p_partkey)) AS s FROM p GROUP BY ticker), n AS (SELECT name, max(p_partkey) AS s FROM p GROUP BY name),
a AS (SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN 'T' || (l_partkey % 200) WHEN l_linenumber % 3 = 1 THEN '--' END AS ticker, 'Name ' || (l_partkey % 150) || CASE WHEN l_linenumber % 2 = 0 THEN ' Description : mined' ELSE '' END AS asset FROM lineitem)
SELECT a.ticker, asset, CASE WHEN NOT a.ticker LIKE 'T%' OR a.ticker IS NULL THEN n.s WHEN k.n > 1 AND asset NOT LIKE '%mined' AND 'T' || (n.s % 200) = a.ticker THEN n.s ELSE k.s END::VARCHAR AS security
FROM a LEFT JOIN k ON k.ticker = a.ticker LEFT JOIN n ON n.name = lower(replace(asset, ' Description : mined', ''))""")
def j6_senate_securities(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    named = lambda prefix, n, c: F.concat(F.lit(prefix), (c % n).cast("string"))
    kind = F.when((key % 200 < 20) | (key % 7 == 0), "direct").otherwise("miner")
    universe = table(spark, d, "part").select(key.cast("string").alias("security"), named("T", 200, key).alias("ticker"), named("name ", 150, key).alias("name"), key.alias("ord"), kind.alias("kind"))
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    ticker = F.when(line % 3 == 0, named("T", 200, part)).when(line % 3 == 1, "--")
    asset = F.concat(named("Name ", 150, part), F.when(line % 2 == 0, " Description : mined").otherwise(""))
    return resolve.resolve_senate(table(spark, d, "lineitem").select(ticker.alias("ticker"), asset.alias("asset")), universe)


@query(f"""WITH {TRADES_SQL}, {MEMBERS_SQL} SELECT member, count(*) AS trade_count, max(traded)::VARCHAR AS last_trade, md5(string_agg(rid, ',' ORDER BY traded DESC, filed DESC, rid)) AS newest_first, md5(string_agg((lo + hi)::VARCHAR, ',' ORDER BY traded, rid)) AS series FROM t JOIN m USING (member) GROUP BY member""")
def g16_documents(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).withColumn("ord", F.col("rid")).withColumn("asset", F.col("text"))
    none = spark.createDataFrame([], "member long, security string, owner string, status string, lo long, hi long, as_of date")
    docs, _ = portfolio.documents(t, none, members(spark, d))
    rids = F.array_join(F.transform("trades", lambda x: x["ord"]), ",")
    doubled = F.array_join(F.transform("series", lambda x: (x["value"] * 2).cast("long").cast("string")), ",")
    return docs.select("member", "trade_count", F.col("last_trade").cast("string").alias("last_trade"), F.md5(rids.cast("binary")).alias("newest_first"), F.md5(doubled.cast("binary")).alias("series"))


@query(f"""WITH {TRADES_SQL} SELECT ticker AS symbol, traded::VARCHAR AS date, (sum(cents) // count(*))::BIGINT AS close FROM t GROUP BY ALL HAVING count(*) % 3 <> 0""")
def c15_price_series(spark: SparkSession, d: str) -> DataFrame:
    closes = trades(spark, d).groupBy("ticker", "traded").agg(F.floor(F.sum("cents") / F.count(F.lit(1))).cast("double").alias("close"), (F.count(F.lit(1)) % 3 == 0).alias("none"))
    days = F.sort_array(F.collect_list(F.struct("traded", F.when(~F.col("none"), F.col("close")).alias("close"))))
    # A chart for each symbol and year: none grows with the history.
    charts = closes.groupBy("ticker", F.year("traded").alias("year")).agg(days.alias("d"))
    series = F.struct(F.transform("d", lambda x: F.unix_timestamp(x["traded"].cast("timestamp"))).alias("timestamp"), F.struct(F.array(F.struct(F.transform("d", lambda x: x["close"]).alias("close"))).alias("quote")).alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.array(series).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    some = charts.where(F.exists("d", lambda x: x["close"].isNotNull()))
    found = landing.price_series(some.select(F.col("ticker").alias("symbol"), body.alias("body")))
    return found.select("symbol", F.col("date").cast("string").alias("date"), F.col("close").cast("long").alias("close"))


@query("""WITH s AS (SELECT event_type || user_id AS filing, min(event_id) AS ord FROM events GROUP BY ALL), l AS (SELECT filing FROM s ORDER BY ord DESC LIMIT 5000) SELECT filing, (SELECT max(ts)::DATE::VARCHAR FROM events) AS last_submitted FROM l""")
def b5_w19_state(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("filing"), F.col("ts").cast("date").alias("filed"), F.col("event_id").alias("ord"))
    last, ids = landing.senate_state(rows.limit(0), rows)
    return ids.select("filing").join(F.broadcast(last.select(F.col("last_submitted").cast("string").alias("last_submitted"))), how="cross")


@query("""WITH p AS (SELECT page_id, lower(url) AS u FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'conflict' WHEN page_id % 3 = 1 THEN 'supporting' ELSE 'none' END AS class FROM p""")
def k40_news_classes(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_id") % 3
    title = F.when(number == 0, F.concat(F.lit("Begich dumps IBIT "), "url")).when(number == 1, "Senate notes").otherwise("Begich dumps IBIT: he buys")
    text = F.when(number == 1, "BEGICH reported ibit").when(number == 2, None).otherwise("")
    status = F.when(number == 2, "other").otherwise("holds")
    found = L.news_class(title, text, F.when(number == 2, "nobody").otherwise("begich"), F.array(F.lit("ibit")), status)
    return table(spark, d, "pages").select("page_id", found.alias("class"))
