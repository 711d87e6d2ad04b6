"""A bill's status, roll calls and vote menus from their XML, as nested columns of one row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clerk_date, found, iso_date, long_date, menu_date, once, truncated
from tidemark.functions.labels import bill_label, bill_url, cast_of, senate_question, version_of

_VOTE = "struct<rollNumber: int, chamber: string, congress: int, sessionNumber: int, date: string, url: string>"
_STATUS = f"""congress int, type string, number int, title string, introducedDate string,
sponsors struct<item: array<struct<bioguideId: string, firstName: string, middleName: string, lastName: string, party: string, state: string>>>,
titles struct<item: array<struct<titleType: string, title: string>>>, latestAction struct<actionDate: string, text: string>,
actions struct<item: array<struct<actionDate: string, text: string, type: string, actionCode: string, recordedVotes: struct<recordedVote: array<{_VOTE}>>>>>,
textVersions struct<item: array<struct<type: string, date: string, formats: struct<item: array<struct<url: string>>>>>>,
relatedBills struct<item: array<struct<title: string, congress: int, number: string, type: string>>>"""
_TALLY = "`yea-total`: int, `nay-total`: int, `present-total`: int, `not-voting-total`: int"
_ROLL = f"""`vote-metadata` struct<congress: int, session: string, `rollcall-num`: int, `legis-num`: string, `vote-question`: string, `vote-result`: string, `action-date`: string,
`vote-totals`: struct<`totals-by-party`: array<struct<party: string, {_TALLY}>>, `totals-by-vote`: struct<{_TALLY}>>>,
`vote-data` struct<`recorded-vote`: array<struct<legislator: struct<_VALUE: string, `_name-id`: string, `_unaccented-name`: string, _party: string, _state: string>, vote: string>>>"""
_MENU = """congress int, session int, congress_year int,
votes struct<vote: array<struct<vote_number: int, vote_date: string, issue: string, question: string, result: string, title: string, vote_tally: struct<yeas: int, nays: int>, en_bloc: struct<matter: array<struct<issue: string>>>>>>"""
_DETAIL = """congress int, session int, vote_number int, vote_date string, question string, vote_result string, vote_result_text string,
count struct<yeas: int, nays: int, present: int, absent: int>,
members struct<member: array<struct<member_full: string, last_name: string, first_name: string, party: string, state: string, vote_cast: string, lis_member_id: string>>>"""
#: Party names of the roll calls.
_PARTIES = {"republican": "R", "democratic": "D", "democrat": "D", "independent": "I"}
VOTES = ("yea", "nay", "present", "not-voting")


def _read(xml: Column, schema: str, root: str) -> Column:
    """The element ``root`` of a document; a document without it raises."""
    block = found(xml, rf"(?s)(<{root}(?:\s[^>]*)?>.*</{root}>)")
    return F.from_xml(F.coalesce(block, F.raise_error(F.lit(f"no <{root}> in the document")).cast("string")), schema, {"mode": "FAILFAST"})


def _items(array: Column, of: str) -> Column:
    """An array that is empty where the document has none."""
    return F.coalesce(array, F.array().cast(of))


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def bill_status(docs: DataFrame, xml: str = "xml", title_letters: int = 200) -> DataFrame:
    """The columns of ``docs`` but the document, with ``congress``, ``bill_type``, ``number``, ``title``,
    ``short_title``, ``introduced``, ``sponsor``, ``latest_action``, and the arrays ``actions`` (those with a date),
    ``versions`` (with type and date) and ``related`` (with type and number), in the document's order."""
    b = F.col("_b")
    rows = docs.withColumn("_b", _read(F.col(xml), _STATUS, "bill"))
    kind = F.lower(_text(b["type"]))
    person = F.get(b["sponsors"]["item"], F.lit(0))
    name = F.array_join(F.filter(F.array(*[_text(person[c]) for c in ("firstName", "middleName", "lastName")]), lambda p: p != ""), " ")
    title = F.concat(F.when(kind.startswith("s"), "Sen.").otherwise("Rep."), F.lit(" "), name)
    sponsor = F.when(person["party"].isin("R", "D", "I"), F.struct(person["bioguideId"].alias("member"), title.alias("name"), person["party"].alias("party"), person["state"].alias("state")))
    short = F.filter(_items(b["titles"]["item"], "array<struct<titleType: string, title: string>>"), lambda t: F.startswith(t["titleType"], F.lit("Short Title")))
    introduced = F.filter(short, lambda t: F.contains(t["titleType"], F.lit("as Introduced")))
    short_title = F.nullif(_text(F.get(F.concat(introduced, short), F.lit(0))["title"]), F.lit(""))

    def vote(v: Column) -> Column:
        chamber = F.when(F.lower(v["chamber"]) == "senate", "senate").otherwise("house")
        return F.struct(v["rollNumber"].alias("roll"), chamber.alias("chamber"), v["congress"].alias("congress"), v["sessionNumber"].alias("session"), iso_date(v["date"]).alias("date"), v["url"].alias("url"))

    def action(a: Column) -> Column:
        votes = F.filter(_items(a["recordedVotes"]["recordedVote"], f"array<{_VOTE}>"), lambda v: _text(v["url"]) != "")
        return F.struct(iso_date(a["actionDate"]).alias("date"), _text(a["text"]).alias("text"), _text(a["type"]).alias("type"), _text(a["actionCode"]).alias("code"), F.transform(votes, vote).alias("votes"))

    def version(v: Column) -> Column:
        own = version_of(_text(v["type"]))
        url = _text(F.get(v["formats"]["item"], F.lit(0))["url"])
        return F.struct(own["code"].alias("code"), _text(v["type"]).alias("type"), own["chamber"].alias("chamber"), iso_date(v["date"]).alias("date"), url.alias("url"))

    def related(r: Column) -> Column:
        return F.struct(truncated(_text(r["title"]), title_letters).alias("title"), r["congress"].alias("congress"), bill_label(r["type"], r["number"]).alias("label"), r["type"].alias("type"), r["number"].alias("number"), bill_url(r["congress"], r["type"], r["number"]).alias("url"))

    has = lambda x, *names: _all(*[_text(x[n]) != "" for n in names])
    latest = F.struct(iso_date(b["latestAction"]["actionDate"]).alias("date"), _text(b["latestAction"]["text"]).alias("text"))
    return rows.select(
        *[c for c in docs.columns if c != xml], b["congress"].alias("congress"), kind.alias("bill_type"), b["number"].alias("number"), _text(b["title"]).alias("title"), short_title.alias("short_title"),
        iso_date(b["introducedDate"]).alias("introduced"), sponsor.alias("sponsor"), latest.alias("latest_action"),
        F.coalesce(F.transform(F.filter(b["actions"]["item"], lambda a: has(a, "actionDate")), action), F.array()).alias("actions"),
        F.coalesce(F.transform(F.filter(b["textVersions"]["item"], lambda v: has(v, "type", "date")), version), F.array()).alias("versions"),
        F.coalesce(F.transform(F.filter(b["relatedBills"]["item"], lambda r: has(r, "type", "number")), related), F.array()).alias("related"),
    )


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _totals(t: Column) -> Column:
    return F.struct(*[_zero(t[f"{v}-total"]).alias(v.replace("-", "_")) for v in VOTES])


def house_roll(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """A roll call of the House: ``congress``, ``session``, ``roll``, ``bill``, ``question``, ``result``, ``date``,
    ``totals``, ``by_party`` (a map) and ``members`` (``member, name, party, state, vote``; those with an id and a vote
    that is known)."""
    rows = docs.withColumn("_r", _read(F.col(xml), _ROLL, "rollcall-vote"))
    meta = F.col("_r")["vote-metadata"]
    party = lambda p: F.coalesce(F.create_map(*[F.lit(x) for kv in _PARTIES.items() for x in kv])[F.lower(p["party"])], p["party"])
    by_party = F.map_from_entries(F.transform(F.coalesce(meta["vote-totals"]["totals-by-party"], F.array()), lambda p: F.struct(party(p).alias("key"), _totals(p).alias("value"))))

    def member(v: Column) -> Column:
        who = v["legislator"]
        name = F.coalesce(who["_unaccented-name"], F.trim(who["_VALUE"]))
        return F.struct(_text(who["_name-id"]).alias("member"), name.alias("name"), _text(who["_party"]).alias("party"), _text(who["_state"]).alias("state"), cast_of(v["vote"], F.lit("house")).alias("vote"))

    members = F.filter(F.transform(F.coalesce(F.col("_r")["vote-data"]["recorded-vote"], F.array()), member), lambda m: (m["member"] != "") & m["vote"].isNotNull())
    return rows.select(
        *[c for c in docs.columns if c != xml], meta["congress"].alias("congress"), _text(meta["session"]).alias("session"), meta["rollcall-num"].alias("roll"), _text(meta["legis-num"]).alias("bill"),
        _text(meta["vote-question"]).alias("question"), _text(meta["vote-result"]).alias("result"), clerk_date(meta["action-date"]).alias("date"), _totals(meta["vote-totals"]["totals-by-vote"]).alias("totals"),
        by_party.alias("by_party"), members.alias("members"),
    )


def senate_menu(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each vote of a session's menu, in its order: ``congress``, ``session``, ``pos``, ``number``, ``date``
    (its day with the menu's year), ``issue``, ``question``, ``kind``, ``result``, ``yeas`` and ``nays`` (null if
    missing), ``title`` and ``en_bloc`` (the issues decided together)."""
    own = [c for c in docs.columns if c != xml]
    rows = docs.withColumn("_m", _read(F.col(xml), _MENU, "vote_summary")).select(*own, "_m", F.posexplode(F.col("_m.votes.vote")).alias("pos", "_v"))
    v = F.col("_v")
    issues = F.filter(F.transform(F.coalesce(v["en_bloc"]["matter"], F.array()), lambda m: _text(m["issue"])), lambda i: i != "")
    return rows.select(
        *own, "_m.congress", "_m.session", "pos", v["vote_number"].alias("number"), menu_date(v["vote_date"], F.col("_m.congress_year")).alias("date"), _text(v["issue"]).alias("issue"), _text(v["question"]).alias("question"),
        senate_question(_text(v["question"])).alias("kind"), _text(v["result"]).alias("result"), v["vote_tally"]["yeas"].alias("yeas"), v["vote_tally"]["nays"].alias("nays"), _text(v["title"]).alias("title"), issues.alias("en_bloc"),
    )


def party_tally(members: Column) -> Column:
    """Votes by party of an array of members with ``party`` and ``vote``. The array is computed once: where it is a parsed
    document, each use of it would parse that again."""

    def tally(members: Column) -> Column:
        parties = F.array_sort(F.array_distinct(F.transform(members, lambda m: m["party"])))

        def count(party: Column, vote: str) -> Column:
            return F.size(F.filter(members, lambda m: (m["party"] == party) & (m["vote"] == vote))).alias(vote.replace("-", "_"))

        def entry(p: Column) -> Column:
            return F.struct(p.alias("key"), F.struct(*[count(p, v) for v in VOTES]).alias("value"))

        return F.map_from_entries(F.transform(parties, entry))

    return once(members, tally)


def senate_detail(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """A roll call of the Senate: ``congress``, ``session``, ``number``, ``date``, ``question``, ``kind``, ``result``,
    ``counts``, ``members`` (by the chamber's own ids; unknown votes are left out) and ``by_party``, counted from them."""
    rows = docs.withColumn("_d", _read(F.col(xml), _DETAIL, "roll_call_vote"))
    d = F.col("_d")

    def member(m: Column) -> Column:
        texts = [_text(m[c]).alias(n) for c, n in (("lis_member_id", "lis"), ("member_full", "name"), ("party", "party"), ("state", "state"))]
        return F.struct(*texts, cast_of(m["vote_cast"], F.lit("senate")).alias("vote"))

    rows = rows.withColumn("members", F.filter(F.transform(F.coalesce(d["members"]["member"], F.array()), member), lambda m: m["vote"].isNotNull()))
    counts = F.struct(*[_zero(d["count"][c]).alias(c) for c in ("yeas", "nays", "present", "absent")])
    return rows.select(
        *[c for c in docs.columns if c != xml], d["congress"].alias("congress"), d["session"].alias("session"), d["vote_number"].alias("number"), long_date(d["vote_date"]).alias("date"), _text(d["question"]).alias("question"),
        senate_question(_text(d["question"])).alias("kind"), _text(d["vote_result"]).alias("result"), counts.alias("counts"), "members", party_tally(F.col("members")).alias("by_party"),
    )
