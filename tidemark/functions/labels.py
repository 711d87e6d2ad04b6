"""Column functions for display: money, dates, bars, chips, and the names of bills, votes and securities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import has_word, lookup, words_of

MINUS, DASH = "−", "–"
#: How votes are cast in the two chambers.
HOUSE_CASTS = {"yea": "yea", "aye": "yea", "nay": "nay", "no": "nay", "present": "present", "not voting": "not-voting"}
SENATE_CASTS = {"yea": "yea", "guilty": "yea", "nay": "nay", "not guilty": "nay", "present": "present", "present, giving live pair": "present", "not voting": "not-voting", "absent": "not-voting"}
#: Versions of a bill's text, their codes and chambers.
VERSIONS = {
    "introduced in house": ("IH", "house"), "reported in house": ("RH", "house"), "engrossed in house": ("EH", "house"), "referred in senate": ("RFS", "senate"),
    "reported to senate": ("RS", "senate"), "engrossed amendment senate": ("EAS", "senate"), "engrossed amendment house": ("EAH", "house"), "enrolled bill": ("ENR", None), "public law": ("PL", None),
}
#: What a version's code is called.
VERSION_LABELS = {
    "IH": "Introduced in House",
    "RH": "Reported in House",
    "EH": "Engrossed in House (House-passed text)",
    "RFS": "Referred in Senate (House-passed text as received)",
    "RS": "Reported to Senate - committee amendment in the nature of a substitute (strike-and-replace)",
    "EAS": "Engrossed Amendment Senate - the Senate-passed substitute text (NOT the House-passed text)",
    "EAH": "Engrossed Amendment House",
    "ENR": "Enrolled Bill",
}
#: Types of bills, their place in an address and their label.
BILL_TYPES = {
    "HR": ("house-bill", "H.R."), "S": ("senate-bill", "S."), "HRES": ("house-resolution", "H.Res."), "SRES": ("senate-resolution", "S.Res."), "HJRES": ("house-joint-resolution", "H.J.Res."),
    "SJRES": ("senate-joint-resolution", "S.J.Res."), "HCONRES": ("house-concurrent-resolution", "H.Con.Res."), "SCONRES": ("senate-concurrent-resolution", "S.Con.Res."),
}
#: What kinds of securities are called.
KIND_LABELS = {"other": "stock", "direct": "direct", "spot-etf": "spot ETF", "treasury": "BTC treasury", "miner": "miner", "exchange": "exchange", "futures-etf": "futures ETF"}
#: Words in a security's name that news must not be matched by.
GENERIC_NAME_WORDS = (
    "the", "trust", "fund", "shares", "share", "inc", "corp", "class", "common", "stock", "wise", "origin", "mini", "direct", "holding", "holdings", "platforms", "global",
)
#: Word forms that news about a sale, a purchase or a disclosure has, and the two-word forms of it.
SALE_WORDS = (
    "sold", "sell", "sells", "sale", "selloff", "dump", "dumped", "dumps", "exit", "exited", "exits", "offload", "offloaded", "offloads", "divest", "divested", "divests", "liquidated", "liquidates",
)
BUY_WORDS = (
    "bought", "buy", "buys", "purchase", "purchases", "purchased", "acquire", "acquires", "acquired", "add", "adds", "added", "invest", "invests", "invested", "scoop", "scooped", "scoops",
)
DISCLOSURE_WORDS = (
    "disclose", "discloses", "disclosed", "disclosure", "disclosures", "file", "files", "filed", "filing", "filings", "report", "reports", "reported", "hold", "holds", "holding",
)
DISCLOSURE_PHRASES = ("periodic transaction", "stock act")
#: What stands after a member's name in news.
NEWS_SUFFIXES = ("jr", "jr.", "sr", "sr.", "ii", "iii", "iv")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def usd(n: Column) -> Column:
    """$800, $50K, $1.6M, $12M."""
    tenths = F.floor(n / 100_000 + 0.5).cast("long")
    whole, rest = F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")
    large = F.when(n >= 10_000_000, _half_up(n / 1_000_000)).when(rest == "0", whole).otherwise(F.concat_ws(".", whole, rest))
    return F.concat(F.lit("$"), F.when(n >= 1_000_000, F.concat(large, F.lit("M"))).when(n >= 1000, F.concat(_half_up(n / 1000), F.lit("K"))).otherwise(_half_up(n)))


def usd_range(lo: Column, hi: Column) -> Column:
    return F.concat(usd(lo), F.lit(DASH), usd(hi))


def day_label(date: Column) -> Column:
    """Jul 17, 2025."""
    return F.date_format(date, "MMM d, yyyy")


def month_label(date: Column) -> Column:
    """Jul 2025."""
    return F.date_format(date, "MMM yyyy")


def _signed(v: Column, unit: str) -> Column:
    size = F.format_string("%.1f" + unit.replace("%", "%%"), F.abs(v).cast("double"))
    return F.concat(F.when(v > 0, "+").when(v < 0, MINUS).otherwise(""), size)


def signed_pct(v: Column) -> Column:
    """+62.5%, with a minus sign that is no hyphen."""
    return _signed(v, "%")


def signed_points(v: Column) -> Column:
    return _signed(v, " pp")


def tally(yea: Column, nay: Column) -> Column:
    return F.concat_ws(DASH, yea.cast("string"), nay.cast("string"))


def range_bar(lo: Column, hi: Column, most: Column, least: float = 2.0) -> Column:
    """Left edge and width in percent of a band on a scale from 0 to ``most``: at least ``least`` wide, never beyond
    100; empty without a scale or where nothing is above 0."""
    scale = F.when(most > 0, most.cast("double"))
    a = F.least(F.greatest(lo, F.lit(0.0)), scale)
    b = F.least(F.greatest(hi, a), scale)
    width = F.least(F.lit(100.0), F.greatest(F.lit(least), (b - a) / scale * 100))
    left = F.least(a / scale * 100, 100.0 - width)
    shown = (hi > 0) & scale.isNotNull()
    return F.struct(F.when(shown, left).otherwise(0.0).alias("left"), F.when(shown, width).otherwise(0.0).alias("width"))


def series_extent(date: Column, value: Column) -> list[Column]:
    """Aggregates of a series for its line: first day, span of days, least value, span of values; a span of nothing is 1."""
    days = F.datediff(F.max(date), F.min(date))
    span = F.max(value) - F.min(value)
    return [F.min(date).alias("first"), F.when(days == 0, 1).otherwise(days).alias("days"), F.min(value).alias("least"), F.when(span == 0, 1.0).otherwise(span).alias("span")]


def ordinal(n: Column) -> Column:
    last, teen = F.pmod(n, F.lit(10)).cast("int"), F.pmod(n, F.lit(100)).between(11, 13)
    return F.concat(n.cast("string"), F.when(~teen & last.between(1, 3), F.get(F.array(F.lit("st"), F.lit("nd"), F.lit("rd")), last - 1)).otherwise("th"))


def bill_label(kind: Column, number: Column) -> Column:
    known = lookup(F.upper(kind), {k: label for k, (_, label) in BILL_TYPES.items()})
    return F.concat_ws(" ", F.coalesce(known, kind), number)


def bill_url(congress: Column, kind: Column, number: Column) -> Column:
    slug = F.coalesce(lookup(F.upper(kind), {k: slug for k, (slug, _) in BILL_TYPES.items()}), F.lit("bill"))
    return F.concat(F.lit("https://www.congress.gov/bill/"), ordinal(congress), F.lit("-congress/"), slug, F.lit("/"), number)


def filing_url(year: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("https://disclosures-clerk.house.gov/public_disc/ptr-pdfs/"), year.cast("string"), F.lit("/"), doc_id, F.lit(".pdf"))


def vote_menu_url(congress: Column, session: Column) -> Column:
    return F.format_string("https://www.senate.gov/legislative/LIS/roll_call_lists/vote_menu_%d_%d.xml", congress, session)


def vote_url(congress: Column, session: Column, number: Column) -> Column:
    return F.format_string("https://www.senate.gov/legislative/LIS/roll_call_votes/vote%d%d/vote_%d_%d_%05d.xml", congress, session, congress, session, number)


def bill_number(text: Column) -> Column:
    """A bill's number without blanks and dots, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def version_of(kind: Column) -> Column:
    """``code`` and ``chamber`` of a version of a text; the initials if it is not known."""
    key = F.lower(F.trim(kind))
    initials = F.array_join(F.transform(F.split(kind, r"\s+"), lambda w: F.upper(F.left(w, F.lit(1)))), "")
    code = F.coalesce(lookup(key, {k: c for k, (c, _) in VERSIONS.items()}), F.nullif(initials, F.lit("")), F.lit("UNKNOWN"))
    return F.struct(code.alias("code"), lookup(key, {k: c for k, (_, c) in VERSIONS.items() if c}).alias("chamber"))


def version_label(code: Column, kind: Column) -> Column:
    return F.coalesce(lookup(code, VERSION_LABELS), kind)


def is_house_passed(code: Column) -> Column:
    return code == "EH"


def is_senate_substitute(code: Column) -> Column:
    return code.isin("RS", "EAS")


def is_senate_amendment(code: Column) -> Column:
    return code == "EAS"


def cast_of(vote: Column, chamber: Column) -> Column:
    """How a vote was cast; null for what the chamber does not know."""
    key = F.lower(F.trim(vote))
    return F.when(chamber == "senate", lookup(key, SENATE_CASTS)).otherwise(lookup(key, HOUSE_CASTS))


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def is_passed(result: Column) -> Column:
    return _contains_any(F.lower(result), ("passed", "agreed"))


def result_of(result: Column, chamber: Column) -> Column:
    confirmed = (chamber == "senate") & F.lower(result).contains("confirmed")
    return F.when(is_passed(result) | confirmed, "passed").otherwise("failed")


def house_question(question: Column) -> Column:
    """passage for a vote that passes the measure or agrees to the Senate's amendment, else null."""
    q = F.lower(question)
    return F.when(_contains_any(q, ("passage", "suspend the rules and pass")) | (q.contains("agree") & q.contains("senate amendment")), "passage")


def senate_question(question: Column) -> Column:
    """cloture before passage, since a question may name both; other for anything else."""
    q = F.trim(F.lower(question))
    return F.when(q.contains("cloture"), "cloture").when(q.contains("passage") | q.rlike(r"^on the (?:joint |concurrent )?resolution"), "passage").otherwise("other")


def vote_label(kind: Column, vote: Column) -> Column:
    """What a member's chip says: the vote if it is recorded, else why there is none."""
    recorded = F.when(vote == "not-voting", "Not voting").otherwise(F.initcap(vote))
    return F.when(kind == "recorded", recorded).when(kind == "senate-pending", "no floor vote yet").otherwise("no roll-call data")


def party_label(party: Column, state: Column) -> Column:
    return F.concat_ws(DASH, party, state)


def holding_flags(owner: Column, extraction: Column, verification: Column, status: Column, as_of: Column, with_owner: bool = True) -> Column:
    """The chips that a holding must carry, in their order."""
    chips = [
        F.when(F.lit(with_owner) & (owner != "self"), owner), F.when(extraction == "pdf-ocr", "OCR"), F.when(verification == "unverified", "unverified"),
        F.when(verification == "conflict", "conflicting sources"), F.when(status == "stale", F.concat(F.lit("stale · "), month_label(as_of))), F.when(status == "sold", F.concat(F.lit("SOLD "), month_label(as_of))),
    ]
    return F.array_compact(F.array(*chips))


def security_label(ticker: Column, kind: Column) -> Column:
    return F.concat_ws(" ", ticker, lookup(kind, KIND_LABELS))


def news_last_name(name: Column) -> Column:
    """The lower-case last word of a member's name, the whole name if all its words are suffixes."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~F.lower(w).isin(*NEWS_SUFFIXES))
    return F.lower(F.coalesce(F.try_element_at(words, F.lit(-1)), name))


def security_tokens(ticker: Column, name: Column) -> Column:
    """What news about a security must hold: its ticker, or a word of four letters that is not generic."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_NAME_WORDS))
    return F.array_distinct(F.concat(F.array(F.lower(ticker)), words))


def _about(text: Column, last_name: Column, tokens: Column) -> Column:
    return F.contains(text, last_name) & F.exists(tokens, lambda t: F.contains(text, t))


def news_class(title: Column, text: Column, last_name: Column, tokens: Column, status: Column) -> Column:
    """supporting, conflict or none. A sale in the title of a row that is held is a conflict only if the title names
    member and security and has no word of buying."""
    head = F.lower(F.coalesce(title, F.lit("")))
    both = F.concat_ws(" ", head, F.lower(F.coalesce(text, F.lit(""))))
    sale = lambda t: has_word(t, SALE_WORDS) | t.rlike(r"(?<![a-z0-9_])sell-off(?![a-z0-9_])")
    told = has_word(both, DISCLOSURE_WORDS) | _phrase(both)
    held = F.when(_about(head, last_name, tokens) & sale(head) & ~has_word(head, BUY_WORDS), "conflict").when(has_word(both, BUY_WORDS) | told, "supporting")
    gone = F.when(sale(both) | told, "supporting")
    return F.when(_about(both, last_name, tokens), F.coalesce(F.when(status == "sold", gone).otherwise(held), F.lit("none"))).otherwise("none")


def _phrase(text: Column) -> Column:
    return F.array_contains(F.transform(F.array(*map(F.lit, DISCLOSURE_PHRASES)), lambda p: F.contains(F.array_join(words_of(text), " "), p)), True)


def holding_queries(member: Column, ticker: Column, name: Column, kind: Column) -> Column:
    """The two searches for a holding; a direct holding is searched as Bitcoin."""
    direct = kind == "direct"
    label = F.when(direct, "Bitcoin").otherwise(F.concat_ws(" ", name, ticker))
    return F.array(F.concat_ws(" ", member, label, F.lit("disclosure")), F.concat_ws(" ", member, F.when(direct, "Bitcoin").otherwise(ticker), F.lit("bought sold")))
