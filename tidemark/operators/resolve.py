"""Names of people and securities against reference tables: every lookup is an equi-join, never a cross join.

A table of securities (the universe) has ``security, ticker, name, ord`` and may have ``kind`` and ``aliases``; one of
members has ``member, name`` and what each function names. ``ord`` is the order of the reference table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import GENERATIONS, SHARE_CLASSES, display_name, given, lookup, normalized_asset, plain_words, surname_of, ticker_in, without_marks, without_share_class

#: Given names that stand for longer ones.
NICKNAMES = {
    "dave": "david", "gil": "gilbert", "nick": "nicholas", "ro": "rohit", "tim": "timothy", "josh": "joshua", "mike": "michael", "jim": "james", "jimmy": "james", "bob": "robert",
    "rob": "robert", "bobby": "robert", "rick": "richard", "dick": "richard", "rich": "richard", "tom": "thomas", "tommy": "thomas", "bill": "william", "billy": "william", "will": "william",
    "greg": "gregory", "dan": "daniel", "danny": "daniel", "ben": "benjamin", "sam": "samuel", "steve": "steven", "ken": "kenneth", "ed": "edward", "eddie": "edward", "ted": "edward",
    "tony": "anthony", "chris": "christopher", "matt": "matthew", "pat": "patrick", "andy": "andrew", "drew": "andrew", "joe": "joseph", "charlie": "charles", "chuck": "charles", "cindy": "cynthia",
    "debbie": "deborah", "liz": "elizabeth", "beth": "elizabeth", "kathy": "katherine", "kate": "katherine", "jerry": "gerald", "larry": "lawrence", "ron": "ronald", "ronny": "ronald", "don": "donald",
    "frank": "francis", "fred": "frederick", "hank": "henry", "jack": "john", "johnny": "john", "jon": "jonathan", "max": "maxwell", "nate": "nathan", "pete": "peter", "phil": "philip",
    "ray": "raymond", "rusty": "russell", "vince": "vincent", "wally": "walter", "zach": "zachary",
}
#: Asset types of a currency that is held directly.
DIRECT_TYPES = ("CT", "Cryptocurrency")
#: What follows an asset's name in an annual report, in the order in which the cuts are tried.
NAME_ENDS = (" exchange platform", " description", " company")
#: Letters of a name by which it is looked for inside a text.
_GRAM = 6


def name_tokens(name: Column) -> Column:
    """Lower-case letters-only words of a name without marks and generations."""
    words = F.split(F.trim(F.regexp_replace(F.lower(without_marks(name)), "[^a-z]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*GENERATIONS))


def candidate_keys(name: Column, nicknames: dict[str, str] | None = None) -> Column:
    """Each given name (by its canonical form; the first initial only if there is nothing else) with the surname; none
    for a name of one word."""
    tokens = name_tokens(name)
    before = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    long = F.filter(before, lambda w: F.length(w) > 1)
    used = F.when(F.size(long) > 0, long).otherwise(F.slice(before, 1, 1))
    full = (lambda w: F.coalesce(lookup(w, nicknames), w)) if nicknames else (lambda w: w)
    return F.array_distinct(F.transform(used, lambda w: F.concat_ws(" ", full(w), F.element_at(tokens, -1))))


def match_names(names: DataFrame, roster: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """``name`` and ``member`` of names that belong to one member: a key of two members is void, a name whose keys lead
    to two members refuses, and a chamber, if given, must agree. ``names``: ``name, chamber``; ``roster``: ``member,
    name, chamber``."""
    keys = roster.select("member", F.col("chamber").alias("_chamber"), F.explode(candidate_keys(F.col("name"), nicknames)).alias("key"))
    sound = keys.groupBy("key").agg(F.count_distinct("member").alias("n"), F.min(F.struct("member", "_chamber")).alias("m")).where("n = 1").select("key", "m.*")
    asked = names.select("name", "chamber").distinct().withColumn("key", F.explode(candidate_keys(F.col("name"), nicknames)))
    found = asked.join(sound, "key").groupBy("name", "chamber").agg(F.count_distinct("member").alias("n"), F.min("member").alias("member"), F.min("_chamber").alias("_chamber"))
    return found.where("n = 1 and (chamber is null or chamber = '' or chamber = _chamber)").select("name", "chamber", "member")


def _spans(words: Column) -> Column:
    """All runs of an array of words, joined by blanks."""
    n = F.size(words)
    return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))


def house_members(filings: DataFrame, roster: DataFrame) -> DataFrame:
    """``filing`` and ``member`` of filings (``filing, last, state, district``) whose last name stands, as whole words, in
    one member's name of the same state (``roster``: ``member, name, chamber, state, district``); several are narrowed
    by the district."""
    words = F.filter(F.split(F.lower(display_name(F.col("name"))), " "), lambda w: w != "")
    known = roster.where("chamber = 'house'").withColumn("_words", words).where(F.size("_words") > 0)
    known = known.select("member", "state", F.col("district").alias("_district"), F.explode(F.array_distinct(_spans(F.col("_words")))).alias("_last"))
    hits = filings.withColumn("_last", F.lower(display_name(F.col("last")))).where("_last <> ''").join(known, ["state", "_last"])
    near = F.col("district") == F.col("_district")
    per = hits.groupBy("filing").agg(F.count_distinct("member").alias("n"), F.min("member").alias("any"), F.count_distinct(F.when(near, F.col("member"))).alias("n_near"), F.min(F.when(near, F.col("member"))).alias("near"))
    return per.select("filing", F.when(F.col("n") == 1, F.col("any")).when(F.col("n_near") == 1, F.col("near")).alias("member")).where("member is not null")


def senate_members(names: DataFrame, roster: DataFrame) -> DataFrame:
    """``first``, ``last`` and ``member`` of names whose last name is one senator's surname; of several, the first with
    the same first name, else the only one with the same initial. ``roster``: ``member, name, chamber, ord``."""
    first_word = lambda c: F.get(F.split(plain_words(c), " "), F.lit(0))
    known = roster.where("chamber = 'senate'").select("member", "ord", surname_of(F.col("name")).alias("_surname"), first_word(F.col("name")).alias("_given")).where("_surname <> ''")
    hits = names.select("first", "last").distinct().withColumn("_surname", plain_words(F.col("last"))).join(known, "_surname")
    own = first_word(F.col("first"))
    like = F.when((F.left("_given", F.lit(1)) == F.left(own, F.lit(1))) & (own != ""), F.col("member"))
    per = hits.groupBy("first", "last").agg(
        F.count(F.lit(1)).alias("n"), F.min("member").alias("any"), F.min_by("member", F.when(F.col("_given") == own, F.col("ord"))).alias("same"),
        F.count_if(F.col("_given") == own).alias("n_same"), F.count(like).alias("n_like"), F.min(like).alias("like"),
    )
    member = F.when(F.col("n") == 1, F.col("any")).when(F.col("n_same") > 0, F.col("same")).when(F.col("n_like") == 1, F.col("like"))
    return per.select("first", "last", member.alias("member")).where("member is not null")


def _complete(universe: DataFrame) -> DataFrame:
    kind = F.col("kind") if "kind" in universe.columns else F.lit(None).cast("string")
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in universe.columns else F.array().cast("array<string>")
    return universe.select("security", F.upper("ticker").alias("ticker"), "name", "ord", kind.alias("kind"), aliases.alias("aliases"))


def _by_ticker(universe: DataFrame) -> DataFrame:
    """For each ticker: how many securities have it, and the first that is not held directly, else the first."""
    listed = F.struct((F.coalesce("kind", F.lit("")) == "direct").alias("direct"), "ord")
    return universe.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min_by("security", listed).alias("listed"))


def resolve_texts(texts: DataFrame, universe: DataFrame, text: str = "text", least: int = _GRAM) -> DataFrame:
    """Distinct ``text`` and ``security``: by its ticker in parentheses (a shared one is that of a listed security), else
    by the longest name or alias inside it.

    Names of ``least`` characters or more match anywhere, shorter ones where no letter or digit stands beside them; ties
    go to the smaller ``ord``, names before aliases. A long name meets the texts that hold its first letters, a short
    one those that hold its first word, and is then compared as a whole; so a text is cut into as many pieces as it has
    letters, whatever the lengths of the names.
    """
    known = _complete(universe)
    asked = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    asked = asked.withColumn("_clean", F.trim(F.regexp_replace(F.regexp_replace("text", r"\[[A-Z]{2}\]", " "), r"\s+", " ")))
    names = known.select("security", "ord", F.posexplode(F.concat(F.array("name"), "aliases")).alias("_pos", "_name")).withColumn("_name", F.lower("_name")).where("_name <> ''")
    long = F.length("_name") >= least
    first_word = F.get(F.filter(F.split("_name", "[^a-z0-9]+"), lambda w: w != ""), F.lit(0))
    names = names.withColumn("_gram", F.when(long, F.left("_name", F.lit(least))).otherwise(F.concat(F.lit("\n"), first_word))).withColumn("_long", long)
    low = F.lower("_clean")
    grams = F.when(F.length(low) >= least, F.transform(F.sequence(F.lit(1), F.length(low) - (least - 1)), lambda i: F.substring(low, i, F.lit(least)))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("\n"), w))
    pieces = asked.select("text", low.alias("_low"), F.explode(F.array_distinct(F.concat(grams, words))).alias("_gram"))
    alone = F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.col("_name"), F.lit(r"\E($|[^a-z0-9])"))
    hits = pieces.join(names, "_gram").where(F.when(F.col("_long"), F.contains("_low", F.col("_name"))).otherwise(F.rlike("_low", alone)))
    best = hits.groupBy("text").agg(F.min_by("security", F.struct(-F.length("_name"), "ord", "_pos")).alias("_by_name"))
    tickers = _by_ticker(known).select(F.col("ticker").alias("_ticker"), F.col("listed").alias("_by_ticker"))
    found = asked.withColumn("_ticker", ticker_in(F.col("_clean"))).join(tickers, "_ticker", "left").join(best, "text", "left")
    return found.select("text", F.coalesce("_by_ticker", "_by_name").alias("security"))


def resolve_senate(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct ``ticker``, ``asset`` and ``security`` of rows of the electronic filings.

    A ticker decides alone (an unknown one gives null); if several securities have it, the one that the asset's whole
    name is, else the first listed one. Without a ticker, the whole name or alias, else the name up to the first clause
    that reports append. A name of several securities is that of the last.
    """
    known = _complete(universe)
    names = known.select("security", F.col("ticker").alias("_own"), "ord", F.posexplode(F.concat(F.array("name"), "aliases")).alias("_pos", "_name"))
    names = names.groupBy(plain_words(F.col("_name")).alias("_key")).agg(F.max_by(F.struct("security", "_own"), F.struct("ord", "_pos")).alias("_named"))
    asked = rows.select("ticker", "asset").distinct()
    plain = plain_words(F.coalesce("asset", F.lit("")))
    cut = [F.when(F.instr(plain, end) > 1, F.trim(F.left(plain, F.instr(plain, end) - 1))) for end in NAME_ENDS]
    tries = asked.select("ticker", "asset", F.posexplode(F.array(plain, *cut)).alias("_try", "_key")).where("_key is not null").join(names, "_key")
    named = tries.groupBy("ticker", "asset").agg(F.min_by("_named", "_try").alias("_named"), F.max(F.when(F.col("_try") == 0, F.col("_named"))).alias("_whole"))
    ticker = F.upper(F.when(~F.coalesce("ticker", F.lit("")).isin("", "--"), F.col("ticker")))
    shared = _by_ticker(known).select(F.col("ticker").alias("_t"), F.col("n").alias("_n"), "listed")
    both = asked.withColumn("_t", ticker).join(shared, "_t", "left").alias("q").join(named.alias("n"), F.col("q.ticker").eqNullSafe(F.col("n.ticker")) & F.col("q.asset").eqNullSafe(F.col("n.asset")), "left")
    by_ticker = F.when((F.col("_n") > 1) & (F.col("_whole._own") == F.col("_t")), F.col("_whole.security")).otherwise(F.col("listed"))
    return both.select("q.ticker", "q.asset", F.when(F.col("_t").isNotNull(), by_ticker).otherwise(F.col("_named.security")).alias("security"))


def name_segments(name: Column) -> Column:
    """What an asset's name may be called: the whole, its parts at dashes, what parentheses hold, and the rest without
    them; each normalized, then without its share class."""
    parts = F.concat(F.array(name), F.split(name, r"\s+-\s+"), F.regexp_extract_all(name, F.lit(r"\(([^)]+)\)"), F.lit(1)), F.array(F.regexp_replace(name, r"\([^)]*\)", " ")))
    both = F.flatten(F.transform(parts, lambda p: F.array(normalized_asset(p), without_share_class(normalized_asset(p)))))
    return F.array_distinct(F.filter(both, lambda s: (s != "") & ~s.isin(*SHARE_CLASSES)))


def resolve_third(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct ``ticker``, ``asset``, ``asset_type`` and ``security`` of third-party rows.

    The ticker, else the ticker as an alias, else the segments of the name in order, each as an alias, then as a
    ticker. Of several securities the one that the segments name best (wholly before in part); if none or two do, the
    only one held directly, where the type is that of a currency.
    """
    known = _complete(universe)
    own = F.transform(F.concat(F.array("name", "ticker"), "aliases"), normalized_asset)
    own = F.array_distinct(F.filter(F.concat(own, F.transform(own, without_share_class)), lambda a: a != ""))
    known = known.withColumn("_names", own)
    entry = F.struct("ord", "security", "kind", "_names").alias("_entry")
    table = known.select(F.concat(F.lit("t:"), "ticker").alias("_key"), entry).unionByName(known.select(F.explode("_names").alias("_key"), entry).withColumn("_key", F.concat(F.lit("a:"), "_key")))
    table = table.groupBy("_key").agg(F.array_sort(F.collect_set("_entry")).alias("_found"))
    asked = rows.select("ticker", "asset", "asset_type").distinct().withColumn("_id", F.struct("ticker", "asset", "asset_type"))
    ticker = F.upper(given(F.col("ticker")))
    by_ticker = F.when(ticker.isNotNull(), F.array(F.concat(F.lit("t:"), ticker), F.concat(F.lit("a:"), normalized_asset(ticker)))).otherwise(F.array().cast("array<string>"))
    segments = F.coalesce(name_segments(F.nullif(F.col("asset"), F.lit(""))), F.array().cast("array<string>"))
    by_name = F.flatten(F.transform(segments, lambda s: F.array(F.concat(F.lit("a:"), s), F.concat(F.lit("t:"), F.upper(s)))))
    tries = asked.select("_id", F.posexplode(F.concat(by_ticker, by_name)).alias("_try", "_key")).join(table, "_key")
    hits = tries.groupBy("_id").agg(F.min_by("_found", "_try").alias("_found")).select("_id.*", "_found").withColumn("_segments", segments)

    def score(entry: Column) -> Column:
        pairs = F.flatten(F.transform("_segments", lambda s: F.transform(entry["_names"], lambda a: F.when(s == a, 2).when((F.length(a) > 3) & F.contains(s, a), 1).otherwise(0))))
        return F.coalesce(F.array_max(pairs), F.lit(0))

    hits = hits.withColumn("_scores", F.transform("_found", score)).withColumn("_best", F.array_max("_scores"))
    best = F.filter("_found", lambda e, i: F.get(F.col("_scores"), i) == F.col("_best"))
    direct = F.filter("_found", lambda e: e["kind"] == "direct")
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))["security"])
    chosen = F.coalesce(only(F.col("_found")), F.when(F.col("_best") > 0, only(best)), F.when(F.col("asset_type").isin(*DIRECT_TYPES), only(direct)))
    found = hits.select(F.struct("ticker", "asset", "asset_type").alias("_hit"), chosen.alias("security"))
    return asked.join(found, F.col("_id").eqNullSafe(F.col("_hit")), "left").select("ticker", "asset", "asset_type", "security")


def first_by(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, all columns kept."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")
