"""A bill's milestones, stages and votes from its status and roll calls: one row a bill, arrays inside.

Cloture is never passage, and a substitute that the Senate passes goes back to the House: it is never law.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import bill_number, house_question, is_passed, is_senate_amendment, result_of, version_label, vote_url

#: Codes of actions.
INTRODUCED, HOUSE_PASSED, SENATE_REPORTED, SENATE_PASSED = "1000", "8000", "14000", "17000"
#: Words of a title that may replace the bill; the bill's own short name is one more.
VEHICLE_WORDS = ("market structure", "digital commodit", "responsible financial innovation", "digital asset")
#: The texts about a substitute; ``{own}`` is the bill's short name with a blank, ``{number}`` its number.
VEHICLE_NOTE = "WATCH: Senate-side measure matching market-structure keywords - possible replacement vehicle for the {own}text."
SUBSTITUTE = (
    "The Senate text is a full strike-and-replace substitute (amendment in the nature of a substitute). "
    "If the Senate passes {number}, the bill goes back to the House for re-passage of the amended text - "
    "it does NOT send the House-passed {own}text to the President. A cloture vote is not a passage vote."
)
SUBSTITUTE_PASSED = (
    "The Senate passed its substitute text - this is NOT the House-passed {own}text and it is NOT law. "
    "House re-passage of the amended text is now required. "
)
REPASSAGE_REQUIRED = (
    "REQUIRED NOW: the Senate passed a strike-and-replace substitute, so the amended text goes back to the House. "
    "Senate passage did not make the House-passed {own}text law."
)
REPASSAGE_LATER = "Required because the Senate text strikes all House-passed text."
CLOTURE_DETAIL = "Cloture activity recorded - not a passage vote. "
#: What the actions of the milestones say, whatever the case.
SAYS = {
    "introduced": "^introduced in house$",
    "house_passed": "passed/agreed to in house",
    "received_in_senate": "received in the senate",
    "senate_reported": "^committee on .*reported by senator",
    "senate_ordered": "ordered to be reported",
    "substitute": "amendment in the nature of a substitute",
    "cloture": "cloture",
    "senate_passed": "passed/agreed to in senate|passed senate",
    "house_repassed": "house agreed to (the )?senate amendment",
    "to_president": "presented to president",
    "became_law": "became public law",
}
#: An action that says all of these repasses the bill as well.
REPASSES = ("motion that the house agree", "senate amendment", "agreed to")
_MEMBER_ID = r"^[A-Z]\d{6}$"


#: What a vote belongs to: its congress, and the bill's type and number as ``bill_number`` writes them.
_BILL = ("congress", "bill")


def _own(votes: DataFrame) -> list[str]:
    return [c for c in _BILL if c in votes.columns]


def keyed(status: DataFrame) -> DataFrame:
    """Statuses with ``bill``."""
    return status.withColumn("bill", bill_number(F.concat("bill_type", F.col("number").cast("string"))))


def votes_of_bills(menu: DataFrame, status: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Votes of a menu on any of the bills (``congress``, ``bill``), alone or decided together with others, once for each
    bill, that are not among ``seen`` (``number``); with the address of the vote."""
    named = F.array_distinct(F.transform(F.concat(F.array("issue"), F.coalesce("en_bloc", F.array().cast("array<string>"))), bill_number))
    rows = menu.withColumn("bill", F.explode(named)).join(keyed(status).select(*_BILL).distinct(), list(_BILL), "left_semi")
    if seen is not None:
        rows = rows.join(seen.select("number"), "number", "left_anti")
    return rows.withColumn("url", vote_url(F.col("congress"), F.col("session"), F.col("number")))


def menu_hits(menu: DataFrame, bill: str, seen: DataFrame | None = None) -> DataFrame:
    """Those of one bill (``bill``), by number."""
    wanted = bill_number(F.lit(bill))
    hits = menu.where((bill_number(F.col("issue")) == wanted) | F.exists("en_bloc", lambda i: bill_number(i) == wanted))
    if seen is not None:
        hits = hits.join(seen.select("number"), "number", "left_anti")
    return hits.withColumns({"bill": wanted, "url": vote_url(F.col("congress"), F.col("session"), F.col("number"))}).orderBy("number")


def _listed(votes: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """The votes of each bill in one array; a bill has some dozens."""
    return votes.groupBy(*_BILL).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


_HIT = "array<struct<number: int, date: date, question: string, kind: string, result: string, yeas: int, nays: int, url: string>>"


def with_hits(status: DataFrame, hits: DataFrame) -> DataFrame:
    """Statuses with ``bill`` and ``hits``: its own votes of the menus, as an array by number (empty without any)."""
    listed = _listed(hits, "hits", ("number", "date", "question", "kind", "result", "yeas", "nays", "url"))
    return keyed(status).join(listed, list(_BILL), "left").withColumn("hits", F.coalesce("hits", F.array().cast(_HIT)))


def milestones(status: DataFrame) -> DataFrame:
    """Statuses with a struct of ``date`` and ``detail`` for each milestone (null if it is not reached),
    ``substitute_in_play`` and ``requires_repassage``. ``status``: as ``bill_status`` gives it, with ``hits``."""
    # The earliest action counts, on one day the one that stands first; sorted without a comparison that is interpreted.
    actions = F.sort_array(F.transform("actions", lambda a, i: F.struct(a["date"].alias("date"), i.alias("pos"), a["text"].alias("text"), a["type"].alias("type"), a["code"].alias("code"))))
    says = lambda what: (lambda a: a["text"].rlike(f"(?i){SAYS[what]}"))
    pair = lambda date, detail: F.struct(date.alias("date"), detail.alias("detail"))

    def first(condition, since: Column | None = None) -> Column:  # noqa: ANN001
        hit = F.get(F.filter("_actions", lambda a: condition(a) if since is None else condition(a) & (a["date"] >= since)), F.lit(0))
        return F.when(hit.isNotNull(), pair(hit["date"], hit["text"]))

    def hit_detail(h: Column, score: bool) -> Column:
        tally = F.when(h["yeas"].isNotNull() & h["nays"].isNotNull(), F.format_string(" %d-%d", h["yeas"], h["nays"])).otherwise("") if score else F.lit("")
        return F.concat(h["question"], F.lit(": "), h["result"], tally, F.lit(" (Roll no. "), h["number"].cast("string"), F.lit(")."))

    def hit(condition, score: bool) -> Column:  # noqa: ANN001
        h = F.get(F.filter("hits", condition), F.lit(0))
        return F.when(h.isNotNull(), pair(h["date"], hit_detail(h, score)))

    out = status.withColumn("_actions", actions)
    out = out.withColumn("received_in_senate", first(says("received_in_senate")))
    since = F.coalesce(F.col("received_in_senate.date"), F.lit("9999-12-31").cast("date"))
    amendment = F.get(F.filter("versions", lambda v: is_senate_amendment(v["code"])), F.lit(0))
    replaced = F.exists("_actions", lambda a: (a["date"] >= since) & says("substitute")(a)) | F.exists("versions", lambda v: (v["chamber"] == "senate") & v["code"].isin("RS", "EAS"))

    def repasses(a: Column) -> Column:
        every = F.lit(True)
        for part in REPASSES:
            every = every & F.contains(F.lower(a["text"]), F.lit(part))
        return says("house_repassed")(a) | every

    out = out.withColumns({
        "introduced": F.coalesce(first(lambda a: (a["code"] == INTRODUCED) | says("introduced")(a)), pair(F.col("introduced"), F.lit("Introduced"))),
        "house_passed": first(lambda a: (a["code"] == HOUSE_PASSED) | says("house_passed")(a)),
        "senate_reported": F.coalesce(first(lambda a: (a["code"] == SENATE_REPORTED) | says("senate_reported")(a), since), first(says("senate_ordered"), since)),
        "senate_cloture": F.coalesce(first(says("cloture")), hit(lambda h: h["kind"] == "cloture", False)),
        "senate_passed": F.coalesce(
            first(lambda a: (a["code"] == SENATE_PASSED) | says("senate_passed")(a)), hit(lambda h: (h["kind"] == "passage") & is_passed(h["result"]), True),
            F.when(amendment.isNotNull(), pair(amendment["date"], F.lit("Engrossed Amendment Senate (EAS) text published."))),
        ),
        "house_repassed": first(repasses), "to_president": first(says("to_president")),
        "became_law": first(lambda a: (a["type"] == "BecameLaw") | says("became_law")(a)), "substitute_in_play": F.coalesce(replaced, F.lit(False)),
    }).drop("_actions")
    returned = F.col("senate_passed").isNotNull() & (F.col("substitute_in_play") | amendment.isNotNull())
    return out.withColumn("requires_repassage", returned & F.col("house_repassed").isNull())


def _named(text: str, short: str, number: str = "") -> str:
    return text.format(own=f"{short} " if short else "", number=number or "the bill")


def stages(marked: DataFrame, short: str = "") -> Column:
    """The six stages of a bill with its milestones: ``label, date, status, detail``. What is reached is done, the first
    other one is current, the rest are pending; the floor vote stays open through cloture. ``short`` names the bill."""
    own = lambda m: F.nullif(F.col(f"{m}.detail"), F.lit(""))
    floor = F.coalesce(F.col("senate_passed.detail"), F.concat(F.lit(CLOTURE_DETAIL), F.col("senate_cloture.detail")))
    swap = F.col("substitute_in_play")
    again = F.when(F.col("requires_repassage"), _named(REPASSAGE_REQUIRED, short)).otherwise(REPASSAGE_LATER)
    rows = [
        (F.lit("Introduced in House"), F.col("introduced"), own("introduced")),
        (F.lit("Passed House"), F.col("house_passed"), own("house_passed")),
        (F.when(swap, "Senate committee reported (substitute text)").otherwise("Senate committee reported"), F.col("senate_reported"), own("senate_reported")),
        (F.lit("Senate floor vote"), F.col("senate_passed"), floor),
        (F.when(swap, "House re-passage of Senate text").otherwise("To President"), F.when(swap, F.col("house_repassed")).otherwise(F.col("to_president")), F.when(swap, again).otherwise(own("to_president"))),
        (F.lit("Signed into law"), F.col("became_law"), own("became_law")),
    ]
    first = F.coalesce(*[F.when(m.isNull(), i) for i, (_, m, _) in enumerate(rows)], F.lit(-1))
    status = lambda i, m: F.when(m.isNotNull(), "done").when(first == i, "current").otherwise("pending")
    return F.array(*[F.struct(label.alias("label"), m["date"].alias("date"), status(i, m).alias("status"), detail.alias("detail")) for i, (label, m, detail) in enumerate(rows)])


def substitute_warning(in_play: Column, requires: Column, short: str = "", number: str = "") -> Column:
    later = _named(SUBSTITUTE, short, number)
    return F.when(in_play & requires, _named(SUBSTITUTE_PASSED, short) + later).when(in_play, later)


def related_bills(related: Column, short: str = "") -> Column:
    """``title``, ``number``, ``url`` and ``note`` of related bills; Senate bills that may replace this one are noted."""

    def row(r: Column) -> Column:
        risk = F.lit(False)
        for w in (*VEHICLE_WORDS, *([short.lower()] if short else [])):
            risk = risk | F.contains(F.lower(r["title"]), F.lit(w))
        note = F.when(F.startswith(F.upper(r["type"]), F.lit("S")) & risk, _named(VEHICLE_NOTE, short))
        return F.struct(r["title"].alias("title"), r["label"].alias("number"), r["url"].alias("url"), note.alias("note"))

    return F.transform(related, row)


def text_versions(versions: Column) -> Column:
    """Versions that have an address, by date: ``version, label, chamber, date, url``."""
    dated = F.array_sort(F.transform(F.filter(versions, lambda v: v["url"] != ""), lambda v, i: F.struct(v["date"].alias("date"), i.alias("pos"), v.alias("v"))))
    return F.transform(dated, lambda d: F.struct(d["v"]["code"].alias("version"), version_label(d["v"]["code"], d["v"]["type"]).alias("label"), d["v"]["chamber"].alias("chamber"), d["date"].alias("date"), d["v"]["url"].alias("url")))


def house_votes(rolls: DataFrame) -> DataFrame:
    """The House's votes that pass the bill: the columns of a bill's vote, with the votes of members who have an id.
    ``rolls``: as ``house_roll`` gives them, with ``url``."""
    votes = F.transform(F.filter("members", lambda m: m["member"].rlike(_MEMBER_ID)), lambda m: F.struct(m["member"].alias("member"), m["vote"].alias("vote")))
    return rolls.withColumn("type", house_question(F.col("question"))).where("type is not null").select(
        "type", F.lit("house").alias("chamber"), "date", "question", result_of(F.col("result"), F.lit("house")).alias("result"), F.col("totals.yea").alias("yea"), F.col("totals.nay").alias("nay"),
        F.col("totals.present").alias("present"), F.col("totals.not_voting").alias("not_voting"), "url", "by_party", votes.alias("votes"), *_own(rolls),
    )


def senate_votes(details: DataFrame) -> DataFrame:
    """The Senate's votes of cloture and passage; members by the chamber's own ids. ``details``: as ``senate_detail``
    gives them, with ``url``."""
    votes = F.transform("members", lambda m: F.struct(m["lis"].alias("lis"), m["name"].alias("name"), m["party"].alias("party"), m["state"].alias("state"), m["vote"].alias("vote")))
    return details.where("kind <> 'other'").select(
        F.col("kind").alias("type"), F.lit("senate").alias("chamber"), "date", "question", result_of(F.col("result"), F.lit("senate")).alias("result"), F.col("counts.yeas").alias("yea"), F.col("counts.nays").alias("nay"),
        F.col("counts.present").alias("present"), F.col("counts.absent").alias("not_voting"), "url", "by_party", votes.alias("senate_votes"), *_own(details),
    )


def menu_votes(hits: DataFrame) -> DataFrame:
    """The same from the menu alone, where a vote's detail is missing: no members, missing tallies are 0."""
    return hits.where("kind <> 'other'").select(
        F.col("kind").alias("type"), F.lit("senate").alias("chamber"), "date", "question", result_of(F.col("result"), F.lit("senate")).alias("result"), F.coalesce("yeas", F.lit(0)).alias("yea"), F.coalesce("nays", F.lit(0)).alias("nay"), "url", *_own(hits),
    )


def latest_action(latest: Column, hits: Column) -> Column:
    """The newest vote of the menu where it is later than the status' own latest action."""
    newest = F.try_element_at(hits, F.lit(-1))
    text = F.concat(F.lit("Senate roll call "), newest["number"].cast("string"), F.lit(": "), newest["question"], F.lit(" - "), newest["result"], F.lit("."))
    return F.when(newest["date"] > latest["date"], F.struct(newest["date"].alias("date"), text.alias("text"))).otherwise(latest)


_VOTES = "array<struct<date: date, chamber: string, type: string, question: string, result: string, yea: int, nay: int, url: string>>"


def assemble(marked: DataFrame, votes: DataFrame, short: str = "", number: str = "") -> DataFrame:
    """One row a bill, with its own votes by ``congress`` and ``bill`` (called ``short``, with its number, in the texts about it): its stages, versions, votes by date and chamber, related bills, warning and latest action. A
    bill that would be shown as law without an act that says so raises."""
    listed = _listed(votes, "votes", ("date", "chamber", "type", "question", "result", "yea", "nay", "url"))
    own = marked if "bill" in marked.columns else keyed(marked)
    law = F.get(stages(marked), F.lit(5))["status"] == "done"
    wrong = law & (F.col("became_law").isNull() | F.col("requires_repassage"))
    sound = F.when(wrong, F.raise_error(F.lit("a bill is shown as law while it is none"))).otherwise(stages(marked, short))
    return own.join(listed, list(_BILL), "left").select(
        "congress", "bill_type", "number", "title", "short_title", F.col("introduced.date").alias("introduced"), "sponsor", latest_action(F.col("latest_action"), F.col("hits")).alias("latest_action"),
        substitute_warning(F.col("substitute_in_play"), F.col("requires_repassage"), short, number).alias("warning"), "requires_repassage", sound.alias("stages"), text_versions(F.col("versions")).alias("versions"), F.coalesce("votes", F.array().cast(_VOTES)).alias("votes"),
        related_bills(F.col("related"), short).alias("related"),
    )


def house_roll_urls(status: DataFrame) -> DataFrame:
    """Distinct addresses of the House's recorded votes."""
    votes = status.select(F.explode(F.flatten(F.transform("actions", lambda a: a["votes"]))).alias("v"))
    return votes.where("v.chamber = 'house'").select("v.url").distinct()
