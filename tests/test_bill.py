"""A bill's status, votes and stages, news about holdings, and the site's tables, on documents small enough to read."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bill, matching, portfolio, review, views
from tidemark.sources import bills, landing

DAY = dt.date.fromisoformat

STATUS = """<?xml version="1.0"?><billStatus><bill><number>3633</number><type>HR</type><congress>119</congress><title>An Act</title><introducedDate>2025-05-29</introducedDate>
<sponsors><item><bioguideId>H001072</bioguideId><firstName>French</firstName><lastName>Hill</lastName><party>R</party><state>AR</state></item></sponsors>
<titles><item><titleType>Short Title(s) as Passed House</titleType><title>Later</title></item><item><titleType>Short Title(s) as Introduced</titleType><title>OPENNESS Act</title></item></titles>
<actions><item><actionDate>2025-09-18</actionDate><text>Received in the Senate &amp; read.</text><type>IntroReferral</type></item>
<item><actionDate>2025-07-17</actionDate><text>On passage Passed by the Yeas and Nays</text><type>Floor</type><actionCode>8000</actionCode><recordedVotes><recordedVote><rollNumber>199</rollNumber><chamber>House</chamber><congress>119</congress><sessionNumber>1</sessionNumber><date>2025-07-17T19:30:31Z</date><url>https://clerk/roll199.xml</url></recordedVote><recordedVote><rollNumber>1</rollNumber><url></url></recordedVote></recordedVotes></item>
<item><actionDate>2025-05-29</actionDate><text>Introduced in House</text><type>IntroReferral</type><actionCode>1000</actionCode></item><item><text>no date</text></item>{more}</actions>
<textVersions><item><type>Engrossed in House</type><date>2025-07-17T04:00:00Z</date><formats><item><url>https://x/eh.xml</url></item></formats></item><item><type>Reported to Senate</type><date>2026-06-01T04:00:00Z</date></item><item><type></type><date>2026-06-01</date></item></textVersions>
<relatedBills><item><title>Responsible Financial Innovation Act</title><congress>119</congress><number>4</number><type>S</type></item><item><title>x</title><congress>119</congress><number></number><type>HR</type></item></relatedBills>
<latestAction><actionDate>2025-09-18</actionDate><text>Received</text></latestAction></bill></billStatus>"""
PASSED = "<item><actionDate>2026-07-20</actionDate><text>Passed Senate with an amendment</text><type>Floor</type></item>"
AGAIN = "<item><actionDate>2026-07-25</actionDate><text>House agreed to the Senate amendment</text><type>Floor</type></item>"
LAW = "<item><actionDate>2026-08-01</actionDate><text>Became Public Law No: 119-99.</text><type>BecameLaw</type></item>"
MENU = """<vote_summary><congress>119</congress><session>2</session><congress_year>2026</congress_year><votes>
<vote><vote_number>00211</vote_number><vote_date>28-Jul</vote_date><issue>PN1</issue><question>On the Nomination</question><result>Confirmed</result><title>t</title><en_bloc><matter><issue>H.R. 3633</issue></matter><matter><issue></issue></matter></en_bloc></vote>
<vote><vote_number>00210</vote_number><vote_date>27-Jul</vote_date><issue>H.R. 3633</issue><question>On Cloture on the Motion to Proceed</question><result>Agreed to</result><vote_tally><yeas>60</yeas><nays>39</nays></vote_tally><title>t</title></vote>
<vote><vote_number>00209</vote_number><vote_date>26-Jul</vote_date><issue>S. 1</issue><question>On Passage</question><result>Passed</result></vote></votes></vote_summary>"""
ROLL = """<!DOCTYPE x><rollcall-vote><vote-metadata><congress>119</congress><session>1st</session><rollcall-num>199</rollcall-num><legis-num>H R 3633</legis-num><vote-question>On Passage</vote-question><vote-result>Passed</vote-result><action-date>17-Jul-2025</action-date>
<vote-totals><totals-by-party><party>Republican</party><yea-total>216</yea-total><nay-total>0</nay-total><present-total>0</present-total><not-voting-total>4</not-voting-total></totals-by-party><totals-by-party><party>Independent</party><yea-total>0</yea-total><nay-total>0</nay-total><present-total>0</present-total><not-voting-total>0</not-voting-total></totals-by-party>
<totals-by-vote><yea-total>294</yea-total><nay-total>134</nay-total><present-total>0</present-total><not-voting-total>4</not-voting-total></totals-by-vote></vote-totals></vote-metadata>
<vote-data><recorded-vote><legislator name-id="A000370" unaccented-name="Adams" party="D" state="NC">Adams</legislator><vote>Nay</vote></recorded-vote><recorded-vote><legislator name-id="B000001" party="R" state="TX">Bé</legislator><vote>Aye</vote></recorded-vote>
<recorded-vote><legislator party="R" state="TX">No id</legislator><vote>Aye</vote></recorded-vote><recorded-vote><legislator name-id="C000001" party="R" state="TX">C</legislator><vote>Speaker</vote></recorded-vote></vote-data></rollcall-vote>"""
DETAIL = """<roll_call_vote><congress>119</congress><session>2</session><vote_number>5</vote_number><vote_date>January 5, 2026,  05:31 PM</vote_date><question>On Passage of the Bill</question><vote_result>Bill Passed</vote_result><count><yeas>1</yeas><nays>1</nays><present></present></count>
<members><member><member_full>A (D-MD)</member_full><party>D</party><state>MD</state><vote_cast>Yea</vote_cast><lis_member_id>S428</lis_member_id></member><member><member_full>B</member_full><party>R</party><state>TX</state><vote_cast>Absent</vote_cast><lis_member_id>S1</lis_member_id></member>
<member><member_full>C</member_full><party>R</party><state>TX</state><vote_cast>Nay</vote_cast><lis_member_id>S2</lis_member_id></member><member><member_full>D</member_full><party>R</party><state>TX</state><vote_cast>?</vote_cast><lis_member_id>S3</lis_member_id></member></members></roll_call_vote>"""


def doc(spark, xml):
    return spark.createDataFrame([(xml,)], "xml string")


def marked(spark, more="", menu=MENU):
    status = bills.bill_status(doc(spark, STATUS.replace("{more}", more)))
    hits = bill.menu_hits(bills.senate_menu(doc(spark, menu)), "hr3633")
    return bill.milestones(bill.with_hits(status, hits))


def test_status(spark):
    r = bills.bill_status(doc(spark, STATUS.replace("{more}", ""))).first()
    assert (r.congress, r.bill_type, r.number, r.short_title, str(r.introduced), r.sponsor.name, r.latest_action.text) == (119, "hr", 3633, "OPENNESS Act", "2025-05-29", "Rep. French Hill", "Received")
    assert [a.code for a in r.actions] == ["", "8000", "1000"] and r.actions[0].text == "Received in the Senate & read." and [v.url for v in r.actions[1].votes] == ["https://clerk/roll199.xml"]
    assert [(v.code, v.chamber, str(v.date), v.url) for v in r.versions] == [("EH", "house", "2025-07-17", "https://x/eh.xml"), ("RS", "senate", "2026-06-01", "")]
    assert [(b.label, b.url) for b in r.related] == [("S. 4", "https://www.congress.gov/bill/119th-congress/senate-bill/4")]
    status = bills.bill_status(doc(spark, STATUS.replace("{more}", "")))
    assert [x.url for x in bill.house_roll_urls(status).collect()] == ["https://clerk/roll199.xml"]
    assert [b.note is not None for b in status.select(F.explode(bill.related_bills(F.col("related"))).alias("b")).select("b.*").collect()] == [True]
    assert [v.version for v in status.select(bill.text_versions(F.col("versions")).alias("v")).first().v] == ["EH"]
    with pytest.raises(Exception, match="no <bill>"):
        bills.bill_status(doc(spark, "<a/>")).collect()
    empty = bills.bill_status(doc(spark, "<bill><congress>1</congress></bill>")).first()
    assert empty.actions == [] and empty.sponsor is None and empty.short_title is None


def test_votes(spark):
    menu = bills.senate_menu(doc(spark, MENU))
    assert [(r.number, str(r.date), r.kind, r.yeas, r.en_bloc) for r in menu.orderBy("pos").collect()] == [(211, "2026-07-28", "other", None, ["H.R. 3633"]), (210, "2026-07-27", "cloture", 60, []), (209, "2026-07-26", "passage", None, [])]
    seen = spark.createDataFrame([(211,)], "number int")
    assert [r.number for r in bill.menu_hits(menu, "H R 3633").collect()] == [210, 211] and [r.number for r in bill.menu_hits(menu, "hr3633", seen).collect()] == [210]
    assert sorted(r.number for r in landing.watch_state(seen, bill.menu_hits(menu, "hr3633")).collect()) == [210, 211]
    assert [(r.type, r.yea, r.nay, r.result) for r in bill.menu_votes(bill.menu_hits(menu, "hr3633")).collect()] == [("cloture", 60, 39, "passed")]
    roll = bills.house_roll(doc(spark, ROLL))
    r = roll.first()
    assert (r.roll, str(r.date), r.totals.yea, r.totals.not_voting, r.by_party["R"].yea, set(r.by_party)) == (199, "2025-07-17", 294, 4, 216, {"R", "I"})
    assert [(m.member, m.name, m.vote) for m in r.members] == [("A000370", "Adams", "nay"), ("B000001", "Bé", "yea")]
    vote = bill.house_votes(roll.withColumn("url", F.lit("u"))).first()
    assert (vote.type, vote.result, len(vote.votes)) == ("passage", "passed", 2)
    detail = bills.senate_detail(doc(spark, DETAIL))
    d = detail.first()
    assert (str(d.date), d.kind, d.counts.yeas, d.counts.present, d.counts.absent, [m.lis for m in d.members], d.by_party["R"].nay, d.by_party["R"].not_voting, d.by_party["D"].yea) == ("2026-01-05", "passage", 1, 0, 0, ["S428", "S1", "S2"], 1, 1, 1)
    assert bill.senate_votes(detail.withColumn("url", F.lit("u"))).first().result == "passed"
    members = spark.createDataFrame([("A000370", "house"), ("Z", "house"), ("S428", "senate")], "member string, chamber string")
    votes = bill.house_votes(roll.withColumn("url", F.lit("u"))).select("type", "chamber", F.lit(1).alias("ord"), "votes")
    assert {r.member: (r.vote_kind, r.vote) for r in views.votes_of(members, votes).collect()} == {"A000370": ("recorded", "nay"), "Z": ("unrecorded", None), "S428": ("senate-pending", None)}


@pytest.mark.parametrize(
    ("more", "states", "requires"),
    [("", "done done current pending pending pending", False), (PASSED, "done done current done pending pending", True), (PASSED + AGAIN, "done done current done done pending", False), (PASSED + AGAIN + LAW, "done done current done done done", False)],
)
def test_stages(spark, more, states, requires):
    m = marked(spark, more)
    r = m.select(bill.stages(m).alias("s"), "requires_repassage", "substitute_in_play", "senate_cloture", bill.latest_action(F.col("latest_action"), F.col("hits")).alias("l")).first()
    assert " ".join(s.status for s in r.s) == states and r.requires_repassage is requires and r.substitute_in_play
    assert r.s[2].label == "Senate committee reported (substitute text)" and r.s[4].label == "House re-passage of Senate text"
    assert r.senate_cloture.detail == "On Cloture on the Motion to Proceed: Agreed to (Roll no. 210)." and r.l.text == "Senate roll call 211: On the Nomination - Confirmed."
    if not more:
        assert r.s[3].detail.startswith("Cloture activity recorded - not a passage vote. ")
    votes = spark.createDataFrame([(DAY("2026-01-01"), "senate", "cloture", "q", "passed", 1, 2, "u"), (DAY("2025-01-01"), "house", "passage", "q", "passed", 1, 2, "u")], "date date, chamber string, type string, question string, result string, yea int, nay int, url string")
    votes = votes.withColumns({"congress": F.lit(119), "bill": F.lit("hr3633")})
    other = votes.withColumn("bill", F.lit("hr1"))
    whole = bill.assemble(m, votes.unionByName(other), "OPENNESS", "H.R. 3633").first()
    assert [v.chamber for v in whole.votes] == ["house", "senate"] and (whole.warning.startswith("The Senate passed") is requires)
    assert "If the Senate passes H.R. 3633" in whole.warning and "House-passed OPENNESS text" in whole.warning


def test_law_without_an_act_raises(spark):
    m = marked(spark, PASSED + LAW)
    votes = spark.createDataFrame([], "date date, chamber string, type string, question string, result string, yea int, nay int, url string")
    with pytest.raises(Exception, match="shown as law"):
        bill.assemble(m, votes.withColumns({"congress": F.lit(119), "bill": F.lit("hr3633")})).collect()


def test_each_bill_gets_its_own_votes(spark):
    statuses = [f"<bill><congress>119</congress><type>{t}</type><number>{n}</number><title>t</title><introducedDate>2025-01-0{n}</introducedDate></bill>" for t, n in (("HR", 1), ("HR", 2), ("S", 1))]
    status = bills.bill_status(spark.createDataFrame([(x,) for x in statuses], "xml string"))
    menu = spark.createDataFrame([(119, 1, 5, DAY("2026-01-01"), "H.R. 1", ["S. 1", "H.R. 9"], "q", "passage", "Passed", 60, 30), (119, 1, 6, DAY("2026-01-02"), "H.R. 2", None, "q", "cloture", "Rejected", 1, 2), (118, 1, 7, DAY("2024-01-02"), "H.R. 2", [], "q", "cloture", "Agreed to", 1, 2)],
        "congress int, session int, number int, date date, issue string, en_bloc array<string>, question string, kind string, result string, yeas int, nays int")
    hits = bill.votes_of_bills(menu, status)
    marked_ = bill.milestones(bill.with_hits(status, hits))
    assert {r.bill: [h.number for h in r.hits] for r in marked_.collect()} == {"hr1": [5], "hr2": [6], "s1": [5]}
    got = {(r.bill_type, r.number): [(v.type, v.yea) for v in r.votes] for r in bill.assemble(marked_, bill.menu_votes(hits)).collect()}
    assert got == {("hr", 1): [("passage", 60)], ("hr", 2): [("cloture", 1)], ("s", 1): [("passage", 60)]}
    assert sorted(r.bill for r in bill.votes_of_bills(menu, status, spark.createDataFrame([(6,)], "number int")).collect()) == ["hr1", "s1"]


def test_review(spark):
    holdings = spark.createDataFrame([(1, 1, "M", "IBIT", "spot-etf", "holds"), (2, 2, "M", "BTC", "direct", "sold"), (3, 3, "N", "IBIT", "spot-etf", "holds"), (4, 4, "X", "IBIT", "spot-etf", "holds")], "holding int, ord int, member string, ticker string, kind string, status string")
    members = spark.createDataFrame([("M", "Nick Begich III"), ("N", "Ann Oda")], "member string, name string")
    universe = spark.createDataFrame([("IBIT", "spot-etf", "iShares Bitcoin Trust"), ("BTC", "direct", "Bitcoin")], "ticker string, kind string, name string")
    asked = review.searches(holdings, members, universe)
    assert sorted((r.holding, r.nth) for r in asked.collect()) == [(h, n) for h in (1, 2, 3) for n in (0, 1)]
    assert asked.where("holding = 1 and nth = 0").first().query == "Nick Begich III iShares Bitcoin Trust IBIT disclosure"
    results = [(1, 0, 0, "Weather", "http://a", "begich and rain"), (1, 0, 1, "Senate", "http://b", "Begich disclosed IBIT shares"), (1, 0, 2, "Begich dumps his IBIT", "http://c", ""), (1, 1, 0, "Begich buys IBIT", "http://d", ""), (2, 0, 0, "Begich bought bitcoin", "https://e", ""), (2, 1, 0, "Begich sold bitcoin", "https://f", " "), (2, 1, 1, "Begich filed on bitcoin", "ftp://g", ""), (3, 0, 0, "Oda sells IBIT, buys more", "https://h", "")]
    found = review.outcomes(spark.createDataFrame(results, "holding int, nth int, pos int, title string, url string, text string"), holdings, members, universe)
    got = {r.holding: (r.outcome, [e.url for e in r.evidence]) for r in found.collect()}
    assert got == {1: ("conflict", ["http://c"]), 2: ("corroborated", ["https://f", "ftp://g"]), 3: ("corroborated", ["https://h"])}
    rows = holdings.select("holding", F.when(F.col("holding") == 3, "conflict").otherwise("unverified").alias("verification"), F.array(F.struct(F.lit("filing").alias("kind"), F.lit("https://f").alias("url"), F.lit(None).cast("string").alias("title"))).alias("sources"))
    after = {r.holding: (r.verification, [s.url for s in r.sources]) for r in review.applied(rows, found).collect()}
    assert after == {1: ("conflict", ["https://f", "http://c"]), 2: ("corroborated", ["https://f"]), 3: ("conflict", ["https://f"]), 4: ("unverified", ["https://f"])}
    body = json.dumps({"results": [{"title": "a", "url": "https://www.x.org/1", "publishedDate": "2026-01-02T00:00:00Z"}, {"title": " ", "url": "https://x.org/2", "publishedDate": "2026-01-02"}, {"title": "b", "url": "no url", "publishedDate": "2026-01-02"}, {"title": "c", "url": "https://x.org/3", "publishedDate": "soon"}]})
    news = review.news_items(landing.search_results(spark.createDataFrame([(body,)], "body string")).withColumn("ord", F.col("pos")))
    assert [(r.title, r.source, str(r.published)) for r in news.collect()] == [("a", "x.org", "2026-01-02")]
    with pytest.raises(Exception, match="without results"):
        landing.search_results(spark.createDataFrame([("{}",)], "body string")).collect()


def test_views(spark):
    source = [("news", "n"), ("filing", "f")]
    rows = [("A", "x", "self", 1, 10, "holds", source), ("A", "y", "self", 1, 99, "sold", source), ("B", "x", "self", 5, 50, "stale", source), ("C", "x", "self", 1, 2, "holds", source), ("D", "z", "self", 1, 2, "holds", [("news", "n")]), ("B", "q", "self", 1, 3, "holds", source)]
    held = spark.createDataFrame(rows, "member string, security string, owner string, lo int, hi int, status string, sources array<struct<kind: string, url: string>>")
    members = spark.createDataFrame([("A", "Al", "R"), ("B", "Bo", "R"), ("D", "Di", "D")], "member string, name string, party string")
    good, bad = views.model(held, members, spark.createDataFrame([("x", 1), ("y", 1)], "security string, tier int"))
    assert sorted((r.member, r.security, r.tier, r.filing_url) for r in good.collect()) == [("A", "x", 1, "f"), ("A", "y", 1, "f"), ("B", "q", 2, "f"), ("B", "x", 1, "f")] and sorted(r.member for r in bad.collect()) == ["C", "D"]
    assert [(r.member, r.max_hi, [x.security for x in r.rows]) for r in views.tier_columns(good).collect()] == [("B", 50, ["x"]), ("A", 10, ["y", "x"])]
    assert views.shown(good, parties=("D",)).count() == 3 and views.shown(good, tiers=(2,)).count() == 1
    assert [r.hi for r in views.ordered(good, "tier_2_range", down=True).collect()] == [99, 50, 10, 3]
    assert [r.security for r in views.ordered(good, "holdings").collect()] == ["x", "y", "q", "x"]
    common = spark.createDataFrame([("t", 2, 1, 1, 0, [("holds",), ("sold",), ("holds",)]), ("u", 2, 1, 0, 0, [("holds",)])], "security string, owners_count int, party_r int, party_d int, party_i int, owners array<struct<status: string>>")
    assert [r.security for r in views.sums_hold(common).collect()] == ["u"]
    days = spark.createDataFrame([(DAY("2025-01-02"),), (DAY("2025-01-05"),)], "d date")
    assert days.agg(views.window_label(F.col("d")).alias("x")).first().x == "disclosed buys 2025-01-02 to 2025-01-05, since-trade, midpoint-weighted"
    trades = spark.createDataFrame([("A", "a", "x", "buy", "self", 1, 3, DAY("2025-01-02"), DAY("2025-01-09"), 1), ("A", "b", "x", "buy", "self", 1, 5, DAY("2025-01-03"), DAY("2025-01-09"), 2), ("Q", "c", "x", "buy", "self", 1, 5, DAY("2025-01-03"), DAY("2025-01-09"), 3)], "member string, asset string, security string, side string, owner string, lo long, hi long, traded date, filed date, ord int")
    docs, lost = portfolio.documents(trades, held.select("member", "security", "owner", "status", "lo", "hi", F.lit("2025-01-01").cast("date").alias("as_of")), members)
    d = docs.first()
    assert (d.member, [t.asset for t in d.trades], [p.value for p in d.series], len(d.positions), d.trade_count) == ("A", ["b", "a"], [2.0, 3.0], 2, 2) and [r.member for r in lost.collect()] == ["Q"]
    assert landing.index_differs(docs, members).count() == 2


def test_prices_and_feeds(spark, tmp_path):
    chart = lambda **k: json.dumps({"chart": {"error": None, "result": [{"timestamp": [1767312000, 1767225600, 1767398400], "indicators": {"quote": [{"close": [10.0, 11.0, None]}], **k}}]}})
    rows = spark.createDataFrame([("A", chart()), ("B", chart(adjclose=[{"adjclose": [9.0, None, None]}]))], "symbol string, body string")
    assert sorted((r.symbol, str(r.date), r.close) for r in landing.price_series(rows).collect()) == [("A", "2026-01-01", 11.0), ("A", "2026-01-02", 10.0), ("B", "2026-01-01", 11.0), ("B", "2026-01-02", 9.0)]
    with pytest.raises(Exception, match="Not Found"):
        landing.price_series(spark.createDataFrame([("A", '{"chart": {"error": {"code": "Not Found"}, "result": null}}')], "symbol string, body string")).collect()
    (tmp_path / "filer").mkdir()
    (tmp_path / "filer/1.json").write_text(json.dumps({"filer": {"id": "f", "full_name": "Al", "party": "R"}, "trades": [{"id": "t1", "ticker": "A"}, {"id": "t2", "filer_name": "Own"}]}))
    got = landing.filer_histories(spark, f"{tmp_path}/filer/*.json").collect()
    assert sorted((r.id, r.filer_id, r.filer_name, r.party) for r in got) == [("t1", "f", "Al", "R"), ("t2", "f", "Own", "R")]
    assert landing.filer_histories(spark, f"{tmp_path}/none/*.json").count() == 0
    for name in landing.DATASETS:
        (tmp_path / f"{name}.json").write_text("[]")
    (tmp_path / "prices.json").write_text(json.dumps({"A": {"latest": {"date": "2026-01-03", "close": 3.0}, "month": {"date": "2026-01-01", "close": 1.0}}, "B": {"previous": None}}))
    sets = landing.third_party(spark, str(tmp_path))
    assert sorted((r.symbol, r.snapshot, r.close) for r in sets["prices"].collect()) == [("A", "latest", 3.0), ("A", "month", 1.0)] and sets["trades"].count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        landing.load_inputs(spark, str(tmp_path), {"absent": "a int"})
    assert landing.load_inputs(spark, str(tmp_path), {"filers": landing.FILER}, {"absent": "a int"})["absent"].count() == 0
    files = spark.createDataFrame([("a", dt.datetime(2026, 1, 1)), ("a", dt.datetime(2026, 1, 2)), ("b", dt.datetime(2026, 1, 2, 23))], "name string, landed timestamp")
    now = F.lit("2026-01-03 00:00:00").cast("timestamp")
    assert [r.name for r in landing.stale(landing.newest_landed(files), now).collect()] == ["a"]
    done = spark.createDataFrame([("x", DAY("2026-01-02"), 2), ("y", DAY("2026-01-01"), 3), ("x", DAY("2026-01-02"), 4)], "filing string, filed date, ord int")
    last, ids = landing.senate_state(done.limit(0), done, most=1)
    assert str(last.first().last_submitted) == "2026-01-02" and [r.filing for r in ids.collect()] == ["y"]
    state = spark.createDataFrame([(2026, "2")], "year int, doc_id string")
    assert [r.doc_id for r in landing.house_state(state, spark.createDataFrame([(2026, "1"), (2026, "2")], state.schema)).collect()] == ["1", "2"]


def test_merged_sources(spark):
    own = spark.createDataFrame([("o1", "u"), ("o2", "https://efdsearch.senate.gov/x")], "rid string, url string")
    other = spark.createDataFrame([("k1", "v"), ("k2", "v")], "rid string, url string")
    matches = spark.createDataFrame([("k1", "o1", "key"), ("k2", None, "none")], "rid string, official_rid string, how string")
    got = matching.merged(own, other, matches)
    assert {r.rid: r.provenance for r in got.collect()} == {"o1": "both", "o2": "official", "k2": "third-party"}
    assert {r.provenance: r.trades for r in views.provenance_counts(got).collect()} == {"both": 1, "official": 1, "third-party": 1}
    assert [r.x for r in own.orderBy("rid").select(matching.chamber_of(F.col("url")).alias("x")).collect()] == ["house", "senate"]
    start = matching.coverage_start(F.col("c"), {"senate": "2025-01-01"}, None, F.lit("2024-06-01").cast("date"))
    rows = spark.createDataFrame([("senate",), ("house",)], "c string").select(start.alias("x")).collect()
    assert [str(r.x) for r in rows] == ["2025-01-01", "2024-06-01"]
