"""Parsers, resolvers and projections on filings small enough to read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as K
from tidemark.functions import labels as L
from tidemark.operators import intake, positions, resolve
from tidemark.sources import filings, landing, markup

DAY = dt.date.fromisoformat


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


LAYOUT = "\n".join([
    "    JT    Harbour Grain Trust (HGT)    P    03/05/2026 03/19/2026    $250,001 -",
    "          [ST]     $500,000",
    "          Filing status : first",
    "          whatever stands below a label",
    "",
    "          Copper lots [CT]    S (partial)    04/02/2026 04/03/2026    $50,001 - $100,000",
    "          Remark : none",
    "    SP    Northern Rail & Ferry 9 (NRF9) [EF]    E    05/11/2026 05/12/2026    $15,001 - $50,000",
    "    DC    An endlessly titled    P    05/11/2026 05/12/2026    $500,001 -",
    "          pension scheme \u25a1",
    "          $1,000,000",
    "          of teachers",
])


def test_layout_text(spark):
    rows = filings.layout_transactions(spark.createDataFrame([("d1", LAYOUT), ("d2", ""), ("d3", None), ("d4", "no transactions\nhere")], "doc_id string, text string")).orderBy("line").collect()
    got = [(r.doc_id, r.owner_code, r.asset, r.type_code, r.partial, str(r.traded), r.lo, r.hi) for r in rows]
    assert got == [
        ("d1", "JT", "Harbour Grain Trust (HGT) [ST]", "P", False, "2026-03-05", 250001, 500000), ("d1", None, "Copper lots [CT]", "S", True, "2026-04-02", 50001, 100000),
        ("d1", "SP", "Northern Rail & Ferry 9 (NRF9) [EF]", "E", False, "2026-05-11", 15001, 50000), ("d1", "DC", "An endlessly titled pension scheme of teachers", "P", False, "2026-05-11", 500001, 1000000),
    ]
    frame = spark.createDataFrame(rows).withColumns({"member": F.lit("M"), "security": F.lit(None).cast("string"), "filed": F.lit("2026-05-20").cast("date"), "year": F.lit(2026)})
    trades, exchanges = intake.house_trades(frame)
    assert sorted((t.side, t.owner, t.late, t.note) for t in trades.collect()) == [("buy", "dependent", False, None), ("buy", "joint", True, None), ("sell", "self", True, "partial sale")]
    assert exchanges.count() == 1 and trades.first().url.endswith("/ptr-pdfs/2026/d1.pdf")


INDEX = """<?xml version="1.0"?><FinancialDisclosure>
<Member><Prefix>Hon.</Prefix><Last>O&apos;Neil &amp; Co</Last><First>Ann</First><Suffix /><FilingType>P</FilingType><StateDst>SC03</StateDst><Year>2026</Year><FilingDate>3/9/2026</FilingDate><DocID>20012345</DocID></Member>
<Member><Prefix /><Last>Gone</Last><First>Bo</First><Suffix>Jr</Suffix><FilingType>W</FilingType><StateDst /><Year /><FilingDate /><DocID>8012345</DocID></Member></FinancialDisclosure>"""


def test_index(spark):
    rows = filings.house_index(spark.createDataFrame([(2026, INDEX)], "y int, xml string")).collect()
    assert [(r.last, r.filing_type, r.state_dst, r.year, str(r.filed), r.doc_id) for r in rows] == [("O'Neil & Co", "P", "SC03", 2026, "2026-03-09", "20012345"), ("Gone", "W", "", 0, "None", "8012345")]
    with pytest.raises(Exception, match="DocID"):
        filings.house_index(spark.createDataFrame([(INDEX.replace("20012345", ""),)], "xml string")).collect()
    with pytest.raises(Exception, match="no <Member>"):
        filings.house_index(spark.createDataFrame([("<a/>",)], "xml string")).collect()
    stub = intake.scan_stub(spark.createDataFrame(rows).withColumn("member", F.lit(None).cast("string"))).collect()
    assert {r.filer for r in stub} == {"Hon. Ann O'Neil & Co", "Bo Gone Jr"} and all(r.ocr_pending for r in stub)
    state = spark.createDataFrame([("1",)], "doc_id string")
    assert [r.doc_id for r in landing.transaction_reports(spark.createDataFrame(rows), state).collect()] == ["20012345"]


PTR = """<p>Filed 07/24/2026 @ 1</p><table><tr><th>other</th></tr></table><table class="t"><thead><tr><th>Transaction Date</th></tr></thead>
<tr><td>2</td><td>07/02/2026</td><td>Dependent Child</td><td>--</td><td>Bitcoin <div class="muted"><em>Company:</em> R&#233;ver</div></td><td>Cryptocurrency</td><td>Sale (Partial)</td><td>$1,001 - $15,000</td><td>--</td></tr>
<tr><td>1</td><td>07/01/2026</td><td>Joint</td><td><a>IBIT</a></td><td>iShares &amp; Co</td><td>Stock</td><td>Purchase</td><td>Over $50,000,000</td><td>a note</td></tr>
<tr><td>3</td><td>07/03/2026</td><td>Nobody</td><td></td><td>x</td><td>Stock</td><td>Exchange</td><td>$1 - $2</td></tr></table>"""


def test_electronic_pages(spark):
    page = lambda html: spark.createDataFrame([("f", html)], "filing string, html string")
    rows = filings.ptr_transactions(page(PTR)).orderBy("row").collect()
    assert [(r.row, str(r.filed), str(r.traded), r.owner, r.ticker, r.asset, r.detail, r.kind, r.lo, r.hi, r.comment) for r in rows] == [
        (1, "2026-07-24", "2026-07-01", "joint", "IBIT", "iShares & Co", None, "Purchase", 50e6, 50e6, "a note"), (2, "2026-07-24", "2026-07-02", "dependent", None, "Bitcoin", "Company: Réver", "Sale (Partial)", 1001, 15000, None),
        (3, "2026-07-24", "2026-07-03", None, None, "x", None, "Exchange", 1, 2, None),
    ]
    frame = spark.createDataFrame(rows).withColumns({"member": F.lit("M"), "security": F.lit(None).cast("string"), "url": F.lit("u"), "submitted": F.lit("2026-07-25").cast("date")})
    trades, others = intake.senate_trades(frame)
    assert sorted((t.side, t.note) for t in trades.collect()) == [("buy", "a note"), ("sell", "partial sale")]
    assert others.first().reason == 'row 3: transaction type "Exchange" is neither buy nor sell'
    with pytest.raises(Exception, match="cells"):
        filings.ptr_transactions(page("<table>Transaction Date<tr><td>1</td></tr></table>")).collect()
    with pytest.raises(Exception, match="without a table"):
        filings.ptr_transactions(page("<p>")).collect()
    annual = """<h3>Part 3. Assets</h3><table><tr><td>1</td><td><a>IBIT</a> - iShares Description: of a trust</td><td>ETF</td><td>Self</td><td>$1,001 - $15,000</td></tr><tr><td>x</td></tr>
    <tr><td>2</td><td>Bitcoin Exchange/Platform : River</td><td>Other</td><td>Someone</td><td>--</td></tr></table><h3>Part 4a. Other</h3><table><tr><td>9</td><td>b</td><td>c</td><td>Self</td><td>$1 - $2</td></tr></table>"""
    assets = filings.annual_assets(page(annual)).orderBy("row").collect()
    assert [(r.row, r.ticker, r.asset, r.owner, r.lo, r.hi) for r in assets] == [(1, "IBIT", "iShares", "self", 1001, 15000), (2, None, "Bitcoin Exchange/Platform : River", None, None, None)]
    known = spark.createDataFrame(assets).withColumns({"member": F.lit("M"), "security": F.lit("S"), "url": F.lit("u"), "title": F.lit("Annual"), "filed": F.lit("2026-05-15").cast("date")})
    good, bad = intake.senate_holdings(known)
    assert good.first().note == "from Annual: iShares" and bad.first().reason == 'asset row 2: unrecognized owner "Someone"'
    scans = '<img src="https://efd-media-public.senate.gov/a/1.gif"><img src="https://efd-media-public.senate.gov/a/2.gif"><img src="https://efd-media-public.senate.gov/a/1.gif">'
    assert [x[-5:] for x in filings.paper_images(page(scans)).first().images] == ["1.gif", "2.gif"]
    with pytest.raises(Exception, match="without scans"):
        filings.paper_images(page("<p>")).collect()


def test_search_rows(spark):
    link = lambda view, title: f'<a href="/search/view/{view}/12345678-1234-1234-1234-123456789abc/" target="_blank">{title}</a>'
    rows = [["Bernie", "Moran,  ", "Senator", link("ptr", "Periodic  Transaction Report for 07/24/2026"), "07/24/2026"], ["A", "B", "C", link("paper", "Annual Report"), "7/4/2026"], ["A", "B", "C", link("regular", "Extension"), "7/4/2026"]]
    got = filings.search_rows(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>")).orderBy("i").collect()
    assert [(r.last, r.channel, r.kind, r.title, str(r.filed)) for r in got] == [("Moran", "electronic", "ptr", "Periodic Transaction Report for 07/24/2026", "2026-07-24"), ("B", "paper", "annual", "Annual Report", "2026-07-04"), ("B", "electronic", "other", "Extension", "2026-07-04")]
    assert got[0].url == "https://efdsearch.senate.gov/search/view/ptr/12345678-1234-1234-1234-123456789abc/"
    with pytest.raises(Exception, match="no link"):
        filings.search_rows(spark.createDataFrame([(["a", "b", "c", "d", "1/1/2026"],)], "cells array<string>")).collect()
    page = one(spark, filings.search_pages(F.lit('{"recordsTotal": 3, "data": [["a"], ["b"]]}')))
    assert (page.total, page.filtered, page.data) == (3, 3, [["a"], ["b"]])


def test_entities(spark):
    assert one(spark, markup.decoded(F.lit("a &amp;lt; b &#233;&#x1F600; &unknown; & c&nbsp;d"))) == "a &lt; b é😀 &unknown; & c d"


def test_members(spark):
    roster = [("A", "Linda T. Sánchez", "house", "CA", "CA-38", 1), ("B", "Donald S. Beyer, Jr.", "house", "VA", "VA-08", 2), ("C", "Mary Smith", "house", "NJ", "NJ-04", 3), ("D", "Adrian Smith", "house", "NJ", "NJ-03", 4), ("E", "Rick Scott", "senate", "FL", None, 5), ("F", "Tim Scott", "senate", "SC", None, 6), ("G", "Jerry Moran", "senate", "KS", None, 7)]
    people = spark.createDataFrame(roster, "member string, name string, chamber string, state string, district string, ord int")
    asked = [("1", "Sanchez", "CA", "CA-01"), ("2", "Beyer", "VA", "VA-01"), ("3", "Smith", "NJ", "NJ-03"), ("4", "Smith", "NJ", "NJ-09"), ("5", "Sanchez", "TX", "TX-01"), ("6", "T Sánchez", "CA", "CA-01"), ("7", "", "CA", "CA-01")]
    got = resolve.house_members(spark.createDataFrame(asked, "filing string, last string, state string, district string"), people)
    assert {r.filing: r.member for r in got.collect()} == {"1": "A", "2": "B", "3": "D", "6": "A"}
    names = [("RICK", "SCOTT"), ("T.", "Scott"), ("X", "Scott"), ("Anyone", "Moran"), ("A", "Nobody")]
    got = resolve.senate_members(spark.createDataFrame(names, "first string, last string"), people)
    assert {(r.first, r.last): r.member for r in got.collect()} == {("RICK", "SCOTT"): "E", ("T.", "Scott"): "F", ("Anyone", "Moran"): "G"}


@pytest.mark.parametrize(("name", "keys"), [("J. P. Smith", ["j smith"]), ("J. Paul Smith Jr.", ["paul smith"]), ("Nuñez", []), ("José Nuñez", ["jose nunez"]), ("Bill Cassidy MD", ["william md", "cassidy md"])])
def test_candidate_keys(spark, name, keys):
    assert one(spark, resolve.candidate_keys(F.lit(name), resolve.NICKNAMES)) == keys


UNIVERSE = [
    ("BTC:direct", "BTC", "Bitcoin (direct holding)", "direct", ["Bitcoin", "XBT"], 1), ("BTC:spot-etf", "BTC", "Grayscale Bitcoin Mini Trust ETF", "spot-etf", [], 2),
    ("IBIT:spot-etf", "IBIT", "iShares Bitcoin Trust ETF", "spot-etf", ["iShares Bitcoin Trust"], 3), ("MSTR:treasury", "MSTR", "Strategy Inc", "treasury", ["MicroStrategy"], 4), ("ASST:treasury", "ASST", "Strive", "treasury", ["SMLR"], 5),
]


def universe(spark):
    return spark.createDataFrame(UNIVERSE, "security string, ticker string, name string, kind string, aliases array<string>, ord int")


def test_securities_of_three_sources(spark):
    texts = {"Grayscale Mini (BTC) [ST]": "BTC:spot-etf", "iShares Bitcoin Trust ETF": "IBIT:spot-etf", "Bitcoin [CT]": "BTC:direct", "Own XBT here": "BTC:direct", "OwnXBT": None, "Block, Inc. (SQ) [ST]": None, "strategy incorporated": "MSTR:treasury"}
    got = resolve.resolve_texts(spark.createDataFrame([(t,) for t in texts], "text string"), universe(spark))
    assert {r.text: r.security for r in got.collect()} == texts
    senate = {("IBIT", "x"): "IBIT:spot-etf", ("ZZZ", "Bitcoin"): None, ("BTC", "Bitcoin"): "BTC:direct", ("BTC", "other"): "BTC:spot-etf", ("--", "BITCOIN"): "BTC:direct", (None, "Bitcoin Exchange/Platform : River"): "BTC:direct", (None, "Bitcoin Miners Description : S21"): None}
    got = resolve.resolve_senate(spark.createDataFrame(list(senate), "ticker string, asset string"), universe(spark))
    assert {(r.ticker, r.asset): r.security for r in got.collect()} == senate
    third = {
        ("IBIT", "iShares Bitcoin Trust ETF - iShares Bitcoin Trust ETF", "ET"): "IBIT:spot-etf", (None, "BTC", "CT"): "BTC:direct", ("BTC", "Bitcoin", "CT"): "BTC:direct", (None, "BTC (Bitcoin)", "CT"): "BTC:direct",
        ("MSTR", "Strategy Inc - Class A Common Stock", "ST"): "MSTR:treasury", ("BTC", "Grayscale Bitcoin Mini Trust ETF", "ET"): "BTC:spot-etf", ("SMLR", "Semler", "ST"): "ASST:treasury", ("BTC", None, "ST"): None,
        ("BTC", None, "CT"): "BTC:direct", (None, "Apple Inc", "ST"): None, (None, None, None): None, (" ibit ", "", "ST"): "IBIT:spot-etf", (None, "MicroStrategy Common Stock", "ST"): "MSTR:treasury",
    }
    got = resolve.resolve_third(spark.createDataFrame(list(third), "ticker string, asset string, asset_type string"), universe(spark))
    assert {(r.ticker, r.asset, r.asset_type): r.security for r in got.collect()} == third


ROW = dict(id="a", ord=1, source_id="house_clerk", transaction_date="2026-01-02", filing_date="2026-01-09", owner="SP", ticker="IBIT", asset_name="iShares", asset_type="ET", transaction_type="Purchase", amount_range_low=15000.0, amount_range_high=1001.0, is_late=1, comment=" n ", doc_url="https://x.org/1", filer_id=None, filer_name="Bob Smith", branch=None, chamber="house", party="R", state="TX")


def test_normalization_in_order(spark):
    rows = [
        ({}, None), ({"ord": 2}, "duplicate row id"), ({"id": "b", "branch": "executive", "party": None}, "non-congress filer"), ({"id": "c", "source_id": "oge", "filer_id": "other"}, "non-congress filer"),
        ({"id": "d", "party": ""}, "phantom filer (no party): Bob Smith"), ({"id": "e", "party": None, "filer_name": None, "filer_id": "q"}, "phantom filer (no party): q"), ({"id": "f", "filer_name": None}, "row has no filer name"),
        ({"id": "g", "filer_name": "Zed Zed"}, "filer not in member roster: Zed Zed"), ({"id": "h", "chamber": "senate"}, "filer not in member roster: Bob Smith"), ({"id": "i", "transaction_type": "Exchange"}, "unsupported transaction_type: Exchange"),
        ({"id": "j", "transaction_type": None}, "unsupported transaction_type: null"), ({"id": "k", "amount_range_low": None}, "missing amount range"), ({"id": "l", "transaction_date": "1/2/2026"}, "missing/invalid transaction_date"),
        ({"id": "m", "filing_date": None}, "missing/invalid filing_date"), ({"id": "n", "doc_url": "ftp://x"}, "missing doc_url"), ({"id": "o", "asset_name": " ", "ticker": " "}, "no asset text"), ({"id": "p", "amount_range_low": -5.0}, "schema: negative amount"),
        ({"id": "q", "filer_name": None, "party": None, "chamber": None, "filer_id": "known"}, None), ({"id": "r", "filer_name": None, "party": None, "chamber": None}, None),
    ]
    given = [{**ROW, "ord": 10 + n, **change} for n, (change, _) in enumerate(rows)]
    schema = landing.THIRD.replace("id string,", "id string, ord int,", 1)
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(",")) for r in given], schema).repartition(3)
    roster = spark.createDataFrame([("M", "Robert Smith", "house")], "member string, name string, chamber string")
    filers = spark.createDataFrame([("known", "Robert Smith", "congress", "house", "R", "TX")], landing.FILER)
    trades, skipped, unmatched = intake.normalize_third(frame, roster, universe(spark), filers, {"id": "d", "full_name": "Bob Smith", "branch": "congress", "chamber": "house", "party": "R"})
    # The default filer fills the names of rows that name none: "f" and "r" are its own, "e" names another.
    reasons = {r.ord: r.reason for r in skipped.collect()}
    want = {10 + n: reason for n, (_, reason) in enumerate(rows) if reason}
    want.pop(16)
    want[2] = want.pop(11)
    first = min(r["ord"] for r in given if r["id"] == "a")
    assert first == 2 and reasons.pop(10) == "duplicate row id" and {k: v for k, v in reasons.items()} == {k: v for k, v in want.items() if k != 2}
    got = {t.id: t for t in trades.collect()}
    assert set(got) == {"a", "f", "q", "r"} and {t.member for t in got.values()} == {"M"}
    assert (got["a"].lo, got["a"].hi, got["a"].owner, got["a"].side, got["a"].late, got["a"].note, got["a"].security) == (1001, 15000, "spouse", "buy", True, "n", "IBIT:spot-etf")
    assert [r.filer_name for r in unmatched.collect()] == ["Bob Smith", "Zed Zed"]
    assert [r.id for r in intake.roster_filers(filers, roster).collect()] == ["known"]


def test_positions_name_their_sources(spark):
    base = [("m", "A", "self", 100, 200, DAY("2023-12-31"), 1, "pdf-ocr", [("filing", "old", "t")], "old note"), ("m", "A", "self", 1, 2, DAY("2024-12-31"), 2, "efd-html", [("filing", "b1", "t"), ("filing", "b1", "u")], "note"), ("m", "A", "self", 3, 4, DAY("2024-12-31"), 3, "pdf-text", [("filing", "b2", "t")], "note")]
    reports = spark.createDataFrame(base, "member string, security string, owner string, lo long, hi long, as_of date, ord int, extraction string, sources array<struct<kind: string, url: string, title: string>>, note string")
    latest = positions.latest_baseline(reports)
    r = latest.first()
    assert (r.lo, r.hi, r.extraction, [(s.url, s.title) for s in r.sources], r.notes) == (4, 6, "pdf-text", [("b1", "t"), ("b2", "t")], ["note"])
    events = [("A", "buy", False, 10, 20, "2024-12-31", "x"), ("A", "buy", False, 10, 20, "2025-01-02", "u1"), ("A", "sell", True, 1, 2, "2025-01-03", "u1"), ("A", "sell", True, 1, 2, "2025-01-03", "b1"), ("B", "sell", True, 1, 2, "2025-01-03", "v"), ("C", "sell", False, 1, 2, "2025-01-03", "w"), ("D", "buy", False, 1, 2, "2025-01-03", "p"), ("D", "sell", True, 2, 9, "2025-01-04", "q"), ("D", "sell", True, 2, 9, "2025-01-05", "q")]
    rows = [("m", s, None, side, part, lo, hi, DAY(day), DAY(day), i, url) for i, (s, side, part, lo, hi, day, url) in enumerate(events)]
    trades = spark.createDataFrame(rows, "member string, security string, owner string, side string, partial boolean, lo long, hi long, traded date, filed date, ord long, url string")
    got = {r.security: r for r in positions.fold(trades, latest).collect()}
    assert (got["A"].status, got["A"].lo, got["A"].hi, [s.url for s in got["A"].sources], got["A"].notes, got["A"].extraction) == ("holds", 10, 24, ["b1", "b2", "u1"], ["note", "partial sale 2025-01-03"], "pdf-text")
    assert got["B"].status == "none" and got["B"].reject_reasons == ["partial sale on 2025-01-03 without a known position - remaining holdings unknown (missed annual baseline?)"] and got["B"].n_sources == 0
    assert (got["C"].status, got["C"].notes, got["C"].n_sources) == ("sold", [positions.SOLD_UNSEEN], 1)
    assert (got["D"].status, got["D"].lo, got["D"].hi, got["D"].notes, got["D"].n_sources, got["D"].rejects) == ("sold", 1, 2, ["partial sales through 2025-01-04 exhausted the disclosed range"], 2, 1)
    good, bad = positions.derived(trades, latest, F.lit("2025-02-01").cast("date"))
    assert sorted(r.security for r in good.collect()) == ["A", "C", "D"] and sorted(r.security for r in bad.collect()) == ["B", "D"]
    old = good.withColumns({"verification": F.lit("corroborated"), "sources": F.concat("sources", F.array(F.struct(F.lit("news").alias("kind"), F.lit("n1").alias("url"), F.lit(None).cast("string").alias("title"))))})
    now = good.withColumn("hi", F.when(F.col("security") == "C", 99).otherwise(F.col("hi")))
    carried = {r.security: (r.verification, [s.url for s in r.sources][-1]) for r in positions.carry_forward(old, now).collect()}
    assert carried == {"A": ("corroborated", "n1"), "C": ("unverified", "w"), "D": ("corroborated", "n1")}


def test_all_tickers_and_series(spark):
    rows = spark.createDataFrame([("m", "Apple (AAPL)", None, 1, 3, DAY("2025-01-02"), 1), ("m", "A fund", None, 1, 3, DAY("2025-01-01"), 2), ("m", "x", "B:direct", 3, 5, DAY("2025-01-01"), 3)], "member string, asset string, security string, lo long, hi long, traded date, ord int")
    wide, none = intake.all_tickers(rows)
    assert sorted(r.security for r in wide.collect()) == ["AAPL:other", "B:direct"] and none.first().reason.endswith(": A fund") and intake.slim(rows).count() == 1
    points = intake.series(rows)
    assert [p.value for p in points.first().series] == [2.0, 4.0, 2.0]
    traders = spark.createDataFrame([("m",), ("n",)], "member string")
    assert {r.member: len(r.series) for r in intake.with_series(traders, points).collect()} == {"m": 3, "n": 0}


def test_roster(spark):
    schema = "id struct<bioguide: string, lis: string>, name struct<official_full: string, first: string, last: string>, terms array<struct<type: string, state: string, district: int, party: string>>"
    feed = intake.legislators(spark.createDataFrame([(("A", None), (None, "Ann", "Bo"), [("sen", "TX", None, "Democrat"), ("rep", "TX", 3, "Republican")]), (("B", "S1"), ("Cy Dee", "C", "D"), [("sen", "AK", None, "Independent")]), (("C", None), ("E", "E", "E"), [("rep", "AK", 0, "Democrat")])], schema))
    assert {(r.member, r.name, r.party, r.chamber, r.district) for r in feed.collect()} == {("A", "Ann Bo", "R", "house", "TX-03"), ("B", "Cy Dee", "I", "senate", None), ("C", "E", "D", "house", "AK-AL")}
    prior = spark.createDataFrame([("A", None, "Annie Bo", "R", "house", "TX", "TX-03", True, "n"), ("Z", None, "Old", "D", "house", "NY", "NY-01", True, None)], "member string, lis string, name string, party string, chamber string, state string, district string, active boolean, note string")
    got = {r.member: (r.name, r.active, r.note) for r in intake.overlay_roster(feed, prior, ["C"]).collect()}
    assert got == {"A": ("Annie Bo", True, "n"), "B": ("Cy Dee", True, None), "C": ("E", False, None), "Z": ("Old", False, None)}
    with pytest.raises(Exception, match="unknown party"):
        intake.legislators(spark.createDataFrame([(("A", None), (None, "A", "B"), [("rep", "TX", 1, "Whig")])], schema)).collect()


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: L.range_bar(F.lit(5.0), F.lit(9.0), F.lit(0.0)), (0.0, 0.0)), (lambda: L.range_bar(F.lit(0.0), F.lit(1.0), F.lit(100.0)), (0.0, 2.0)), (lambda: L.range_bar(F.lit(99.0), F.lit(150.0), F.lit(100.0)), (98.0, 2.0)),
        (lambda: K.truncated(F.lit("abc\n\n def"), 6), "abc…"), (lambda: K.clean_asset(F.lit("A &amp;lt; B&#39;s [ST] (X)")), "a b s"), (lambda: K.without_marks(F.lit("Nuñez Žák ế")), "Nunez Zak e"), (lambda: K.without_share_class(F.lit("strategy inc class a common stock")), "strategy inc class a"),
        (lambda: L.signed_pct(F.lit(-23.24)), "−23.2%"), (lambda: L.signed_points(F.lit(41.46)), "+41.5 pp"), (lambda: L.signed_pct(F.lit(0.0)), "0.0%"), (lambda: L.tally(F.lit(294), F.lit(134)), "294–134"), (lambda: L.day_label(F.lit("2025-07-07").cast("date")), "Jul 7, 2025"),
        (lambda: L.bill_label(F.lit("hjres"), F.lit("7")), "H.J.Res. 7"), (lambda: L.bill_url(F.lit(119), F.lit("HR"), F.lit("3633")), "https://www.congress.gov/bill/119th-congress/house-bill/3633"), (lambda: L.vote_url(F.lit(119), F.lit(2), F.lit(210)), "https://www.senate.gov/legislative/LIS/roll_call_votes/vote1192/vote_119_2_00210.xml"),
        (lambda: L.version_of(F.lit("Placed on Calendar"))["code"], "POC"), (lambda: L.version_of(F.lit(" Reported to Senate "))["chamber"], "senate"), (lambda: L.senate_question(F.lit("On Cloture on the Motion to Proceed")), "cloture"), (lambda: L.senate_question(F.lit("On the Joint Resolution S.J.Res. 1")), "passage"), (lambda: L.senate_question(F.lit("On the Motion")), "other"),
        (lambda: L.house_question(F.lit("On Motion to Suspend the Rules and Pass")), "passage"), (lambda: L.house_question(F.lit("On Agreeing to the Senate Amendment")), "passage"), (lambda: L.house_question(F.lit("On Ordering the Previous Question")), None), (lambda: L.result_of(F.lit("Nomination Confirmed"), F.lit("senate")), "passed"),
        (lambda: L.cast_of(F.lit("Guilty"), F.lit("senate")), "yea"), (lambda: L.cast_of(F.lit("Aye"), F.lit("house")), "yea"), (lambda: L.cast_of(F.lit("Guilty"), F.lit("house")), None), (lambda: K.published_since(F.lit("2026-03-01").cast("date"), 1), "2026-02-28T00:00:00.000Z"), (lambda: K.menu_date(F.lit("27-JUL"), F.lit(2026)), DAY("2026-07-27")),
        (lambda: L.holding_flags(F.lit("spouse"), F.lit("pdf-ocr"), F.lit("conflict"), F.lit("sold"), F.lit("2025-04-24").cast("date")), ["spouse", "OCR", "conflicting sources", "SOLD Apr 2025"]), (lambda: L.vote_label(F.lit("recorded"), F.lit("not-voting")), "Not voting"), (lambda: L.security_label(F.lit("IBIT"), F.lit("spot-etf")), "IBIT spot ETF"),
        (lambda: L.security_tokens(F.lit("IBIT"), F.lit("The iShares Bitcoin Trust")), ["ibit", "ishares", "bitcoin"]), (lambda: L.news_last_name(F.lit("Nick Begich III")), "begich"), (lambda: K.surname_of(F.lit("Angus S. King, Jr.")), "king"), (lambda: K.file_name(F.lit("a/b c")), "a__b__c"), (lambda: K.worst_extraction(F.array(F.lit("efd-html"), F.lit("pdf-text"))), "pdf-text"),
        (lambda: K.holding_key(F.lit("m"), F.lit("s"), F.lit(None)), "m|s|self"), (lambda: K.full_name(F.lit("Hon."), F.lit(""), F.lit("X")), "Hon. X"), (lambda: L.holding_queries(F.lit("Al"), F.lit("BTC"), F.lit("n"), F.lit("direct")), ["Al Bitcoin disclosure", "Al Bitcoin bought sold"]),
    ],
)
def test_scalars(spark, column, want):
    got = one(spark, column())
    assert (tuple(got) if isinstance(want, tuple) else got) == want
