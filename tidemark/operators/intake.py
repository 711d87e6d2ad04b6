"""Parsed filings and third-party rows onto the columns of a trade: ``member, asset, security, side, owner, lo, hi,
traded, filed, url, late, note``. What cannot be one is a row of the second DataFrame, with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import full_name, given, is_late, iso_date, midpoint, owner_of, side_of, ticker_in
from tidemark.functions.labels import filing_url
from tidemark.operators.gate import first_reason
from tidemark.operators.resolve import NICKNAMES, match_names, resolve_third
from tidemark.shared import stored

#: Sources of the congress, where a filer's branch is not known.
CONGRESS_SOURCES = ("house_clerk", "senate_efd")
#: Why a third-party row is no trade, in the order in which the reasons are tried.
REASONS = (
    "duplicate row id",
    "non-congress filer",
    "phantom filer (no party): ",
    "row has no filer name",
    "filer not in member roster: ",
    "unsupported transaction_type: ",
    "missing amount range",
    "missing/invalid transaction_date",
    "missing/invalid filing_date",
    "missing doc_url",
    "no asset text",
    "schema: negative amount",
    "schema: invalid url",
)
TRADE = ("member", "asset", "security", "side", "owner", "lo", "hi", "traded", "filed", "url", "late", "note")


def filer_context(rows: DataFrame, filers: DataFrame | None = None, default: dict[str, str | None] | None = None) -> DataFrame:
    """Rows whose ``filer_name``, ``branch``, ``chamber`` and ``party`` are filled from the directory of filers (``id,
    full_name, branch, chamber, party``; ids are unique), or from the default filer where a row names none or that one."""
    names = {"full_name": "filer_name", "branch": "branch", "chamber": "chamber", "party": "party"}
    spark = rows.sparkSession
    known = filers.select("id", *names) if filers is not None else spark.createDataFrame([], "id string, " + ", ".join(f"{n} string" for n in names))
    if default:
        own = spark.createDataFrame([tuple(default.get(n) for n in ("id", *names))], "id string, " + ", ".join(f"{n} string" for n in names))
        known = known.where(F.col("id") != default["id"]).unionByName(own)
    known = known.toDF("_filer", *[f"_{n}" for n in names])
    key = F.coalesce("filer_id", F.lit(default["id"] if default else None).cast("string"))
    out = rows.join(known, key == F.col("_filer"), "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"_{d}")) for d, n in names.items()}).drop("_filer", *[f"_{d}" for d in names])


def is_congress(rows: DataFrame) -> Column:
    """By the branch if it is known, else by the source."""
    return F.coalesce(rows["branch"] == "congress", rows["source_id"].isin(*CONGRESS_SOURCES), F.lit(False))


def _duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """All rows with ``_first``: whether a row is the first of its key. The least of each key is reduced before the
    exchange, so a key that most rows have is no group of one task."""
    # Grouped by the two columns that a comparison of nulls is made of, so that the groups lie where they are joined.
    known, none = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull()
    first = rows.groupBy(known.alias("_id"), none.alias("_none")).agg(F.min(order).alias("_least"))
    return rows.join(first, (known == F.col("_id")) & (none == F.col("_none")), "left").withColumn("_first", F.col(order) == F.col("_least")).drop("_id", "_none", "_least")


def normalize_third(rows: DataFrame, roster: DataFrame, universe: DataFrame, filers: DataFrame | None = None, default: dict[str, str | None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trades of third-party rows, the rows that are none with the first reason that holds, and the sorted names of
    filers that the roster lacks.

    ``rows``: ``id, ord`` (the input's order), ``source_id, transaction_date, filing_date, owner, ticker, asset_name,
    asset_type, transaction_type, amount_range_low, amount_range_high, is_late, comment, doc_url, filer_id,
    filer_name, branch, chamber, party``. The reasons, in order: a repeated id, no filer of the congress, a filer
    without party, without name, not on the roster; no purchase or sale; no amounts; no sound transaction or filing
    date; no address; no asset; and last the contract of a trade.
    """
    rows = filer_context(rows, filers, default)
    sound = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
    side, asset = side_of(F.col("transaction_type")), F.coalesce(given(F.col("asset_name")), given(F.col("ticker")))
    text = lambda label, *values: F.concat(F.lit(label), F.coalesce(*[F.col(v) for v in values[:-1]], F.lit(values[-1])))
    # What each reason ends with, and when a row passes it.
    ends = {2: ("filer_name", "filer_id", "unknown"), 4: ("filer_name", ""), 5: ("transaction_type", "null")}
    passes = (
        F.coalesce("_first", F.lit(False)), is_congress(rows), F.col("party") != "", F.col("filer_name").isNotNull(), F.col("member").isNotNull(), side.isNotNull(), F.col("amount_range_low").isNotNull() & F.col("amount_range_high").isNotNull(),
        sound("transaction_date"), sound("filing_date"), F.col("doc_url").rlike(r"^https?://"), asset.isNotNull(), F.least("amount_range_low", "amount_range_high") >= 0, F.try_parse_url("doc_url", F.lit("HOST")).isNotNull(),
    )
    rules = [(text(r, *ends[i]) if i in ends else r, ok) for i, (r, ok) in enumerate(zip(REASONS, passes, strict=True))]
    # What a row says by itself comes first: only what can become a trade is moved, and of other rows their reason.
    rows = rows.withColumns({"_before": first_reason(rules[1:4]), "_after": first_reason(rules[5:])})
    low, high = F.least("amount_range_low", "amount_range_high"), F.greatest("amount_range_low", "amount_range_high")
    trade = {
        "ticker": F.col("ticker"), "asset_name": F.col("asset_name"), "asset_type": F.col("asset_type"), "side": side, "owner": owner_of(F.col("owner")), "lo": low, "hi": high, "traded": iso_date(F.col("transaction_date")),
        "filed": iso_date(F.col("filing_date")), "url": F.col("doc_url"), "late": F.coalesce(F.col("is_late").cast("int") == 1, F.lit(False)), "note": given(F.col("comment")),
    }
    asked, whole = F.col("_before").isNull(), F.col("_before").isNull() & F.col("_after").isNull()
    rows = stored(rows.select("id", "ord", "_before", F.when(asked, F.col("_after")).alias("_after"), *[F.when(asked, F.col(c)).alias(c) for c in ("filer_name", "chamber")], *[F.when(whole, v).alias(n) for n, v in trade.items()]))
    # Matches are stored, so that the sizes of the files say whether rows must move for them.
    matched = match_names(rows.where("_before is null").select(F.col("filer_name").alias("name"), "chamber"), roster, NICKNAMES)
    matched = stored(matched.select(F.col("name").alias("_name"), F.col("chamber").alias("_chamber"), "member"))
    rows = rows.join(matched, (F.col("filer_name") == F.col("_name")) & F.col("chamber").eqNullSafe(F.col("_chamber")), "left").drop("_name", "_chamber", "chamber")
    unknown = first_reason([rules[4]])
    lost = F.when(F.col("_before").isNull() & F.col("member").isNull(), F.col("filer_name"))
    rows = rows.withColumn("_own", F.coalesce("_before", unknown, "_after")).withColumn("filer_name", lost)
    rows = rows.withColumns({c: F.when(F.col("_own").isNull(), F.col(c)) for c in ("member", *trade)}).drop("_before", "_after")
    rows = _duplicates(rows, "id", "ord")
    # All three results come from the judged rows: they are computed once.
    rows = rows.withColumn("reason", F.coalesce(first_reason([rules[0]]), F.col("_own")))
    rows = stored(rows.select("id", "ord", "reason", "filer_name", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("member", *trade)]))
    skipped = rows.where("reason is not null").select("id", "ord", "reason")
    unmatched = rows.where(F.startswith("reason", F.lit(REASONS[4]))).select("filer_name").distinct().orderBy("filer_name")
    good = rows.where("reason is null")
    named = stored(resolve_third(good.select("ticker", F.col("asset_name").alias("asset"), "asset_type"), universe).toDF("_ticker", "_asset", "_type", "security").where("security is not null"))
    same = F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("asset_name").eqNullSafe(F.col("_asset")) & F.col("asset_type").eqNullSafe(F.col("_type"))
    trades = good.join(named, same, "left").select(
        "id", "ord", "member", asset.alias("asset"), "security", "side", "owner", "lo", "hi", "traded", "filed", "url", "late", "note",
    )
    return trades, skipped, unmatched


def roster_filers(filers: DataFrame, roster: DataFrame) -> DataFrame:
    """Sorted ids of the congress's filers with a party whose names are on the roster."""
    own = filers.where("branch = 'congress' and party <> ''")
    matched = match_names(own.select(F.col("full_name").alias("name"), "chamber"), roster, NICKNAMES).toDF("full_name", "_chamber", "_member")
    return own.join(matched, (own["full_name"] == matched["full_name"]) & own["chamber"].eqNullSafe(matched["_chamber"]), "left_semi").select("id").orderBy("id")


def house_trades(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades of the layout text's transactions, and the exchanges, which are none. ``rows``: those of
    ``layout_transactions`` with the filing's ``member, security, filed, year, doc_id``."""
    owner = F.when(F.col("owner_code") == "SP", "spouse").when(F.col("owner_code") == "JT", "joint").when(F.col("owner_code") == "DC", "dependent").otherwise("self")
    note = F.array_join(F.array_compact(F.array(F.when(F.col("partial"), "partial sale"), F.when(F.col("hi").isNull(), "amount upper bound missing from filing text"))), "; ")
    trades = rows.where("type_code <> 'E'").select(
        "member", "asset", "security", F.when(F.col("type_code") == "P", "buy").otherwise("sell").alias("side"), owner.alias("owner"), "lo", F.coalesce("hi", "lo").alias("hi"), "traded", "filed",
        filing_url(F.col("year"), F.col("doc_id")).alias("url"), F.coalesce(is_late(F.col("traded"), F.col("filed")), F.lit(False)).alias("late"), F.nullif(note, F.lit("")).alias("note"),
    )
    return trades, rows.where("type_code = 'E'").select("doc_id", "line", F.lit("an exchange is neither buy nor sell").alias("reason"))


def senate_trades(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades of the electronic filings' rows, and the others with a reason. ``rows``: those of ``ptr_transactions`` with
    the filing's ``filing, member, security, url`` and ``submitted`` (the date if the page has no stamp)."""
    side = F.when(F.startswith("kind", F.lit("Purchase")), "buy").when(F.startswith("kind", F.lit("Sale")), "sell")
    sale = F.when(F.startswith("kind", F.lit("Sale (Partial)")), "partial sale").when(F.startswith("kind", F.lit("Sale (Full)")), "full sale")
    filed = F.coalesce("filed", "submitted")
    trades = rows.where(side.isNotNull()).select(
        "member", "asset", "security", side.alias("side"), "owner", "lo", "hi", "traded", filed.alias("filed"), "url", is_late(F.col("traded"), filed).alias("late"),
        F.nullif(F.concat_ws("; ", sale, "comment"), F.lit("")).alias("note"),
    )
    reason = F.format_string('row %d: transaction type "%s" is neither buy nor sell', "row", "kind")
    return trades, rows.where(side.isNull()).select("filing", reason.alias("reason"))


def senate_holdings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings of the annual reports' assets that the universe has, and those without owner or band, with a reason.
    ``rows``: those of ``annual_assets`` with the filing's ``filing, member, security, url, title, filed``."""
    known = rows.where("security is not null").withColumn("reason", F.when(F.col("owner").isNull(), F.format_string('asset row %d: unrecognized owner "%s"', "row", "owner_label")).when(F.col("lo").isNull(), F.format_string('asset row %d: no value band reported for "%s"', "row", "asset")))
    source = F.struct(F.lit("filing").alias("kind"), F.col("url").alias("url"), F.col("title").alias("title"))
    good = known.where("reason is null").select(
        "member", "security", "owner", "lo", "hi", F.lit("holds").alias("status"), F.col("filed").alias("as_of"), F.lit("efd-html").alias("extraction"), F.lit("unverified").alias("verification"),
        F.array(source).alias("sources"), F.concat(F.lit("from "), "title", F.lit(": "), "asset").alias("note"),
    )
    return good, known.where("reason is not null").select("filing", "reason")


def scan_stub(filings: DataFrame) -> DataFrame:
    """A row that marks a paper filing of ``house_index`` (with ``member``, null if unknown) for reading later: it is
    flagged, not parsed."""
    name = full_name(*[F.col(c) for c in ("prefix", "first", "last", "suffix")])
    note = "paper filing (image scan) - OCR runs in the Action, flagged here only"
    return filings.select("doc_id", filing_url(F.col("year"), F.col("doc_id")).alias("url"), "member", name.alias("filer"), "state_dst", "filed", F.lit("pdf-ocr").alias("extraction"), F.lit(True).alias("ocr_pending"), F.lit(note).alias("note"))


def all_tickers(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades that can form positions (``security`` is kept, else the asset's ticker in parentheses with kind other),
    and those without any, with a reason."""
    other = F.concat(ticker_in(F.col("asset")), F.lit(":other"))
    wide = trades.withColumn("security", F.coalesce("security", other))
    reason = F.concat(F.lit("no resolvable ticker in filing text - trade cannot form a position: "), "asset")
    return wide.where("security is not null"), wide.where("security is null").withColumn("reason", reason)


def slim(trades: DataFrame) -> DataFrame:
    """Trades whose security is known."""
    return trades.where("security is not null")


def series(trades: DataFrame, key: str = "member") -> DataFrame:
    """For each key, its trades' midpoints by date (``date, value``), in the input's order within a day (``ord``). One
    member's trades are one row, as in the document that ships them."""
    point = F.struct(F.col("traded").alias("date"), "ord", midpoint(F.col("lo"), F.col("hi")).alias("value"))
    points = trades.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return points.select(key, F.transform("p", lambda p: F.struct(p["date"].alias("date"), p["value"].alias("value"))).alias("series"))


def with_series(traders: DataFrame, points: DataFrame, key: str = "member") -> DataFrame:
    """Traders with their ``series``, empty where there is none."""
    return traders.join(points.select(key, "series"), key, "left").withColumn("series", F.coalesce("series", F.array().cast("array<struct<date: date, value: double>>")))


def legislators(docs: DataFrame) -> DataFrame:
    """Members of the roster's feed (``id struct<bioguide, lis>, name struct<official_full, first, last>, terms
    array<struct<type, state, district, party>>``): the last term's chamber, state, district and party; an unknown party
    raises."""
    term = F.try_element_at("terms", F.lit(-1))
    party = F.create_map(*[F.lit(x) for kv in (("Republican", "R"), ("Democrat", "D"), ("Independent", "I")) for x in kv])[term["party"]]
    house = term["type"] == "rep"
    district = F.when(house, F.concat_ws("-", term["state"], F.when(term["district"] == 0, "AL").otherwise(F.lpad(term["district"].cast("string"), 2, "0"))))
    return docs.select(
        F.col("id.bioguide").alias("member"), F.col("id.lis").alias("lis"), F.coalesce("name.official_full", F.concat_ws(" ", "name.first", "name.last")).alias("name"),
        F.when(party.isNotNull(), party).otherwise(F.raise_error(F.concat(F.lit("unknown party: "), F.coalesce(term["party"], F.lit("none"))))).alias("party"),
        F.when(house, "house").otherwise("senate").alias("chamber"), term["state"].alias("state"), district.alias("district"),
    )


def overlay_roster(feed: DataFrame, prior: DataFrame, gone: list[str] | None = None, traders: DataFrame | None = None) -> DataFrame:
    """The feed's members with the prior roster's name, note and activity kept, those of ``gone`` inactive, the traders'
    mark (``member, mark``), and prior members that the feed lacks, inactive."""
    old = prior.select("member", *[F.col(c).alias(f"_{c}") for c in ("lis", "name", "party", "chamber", "state", "district", "active", "note")])
    both = feed.withColumn("_new", F.lit(True)).join(old, "member", "full")
    here = F.coalesce("_new", F.lit(False))
    active = here & F.coalesce("_active", F.lit(True)) & ~F.col("member").isin(*(gone or [""]))
    kept = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")).alias(c)
    out = both.select("member", kept("lis"), F.coalesce("_name", "name").alias("name"), *map(kept, ("party", "chamber", "state", "district")), active.alias("active"), F.col("_note").alias("note"))
    return out.join(traders.select("member", F.col("mark").alias("trader_roster")), "member", "left") if traders is not None else out
