"""What a run does around its parsers: documents set aside, a budget of searches, kept state, and lines of items."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contract, lookup, prefix, review
from tidemark.sources import caches, filings, landing, positioned, searches
from tidemark.streaming import feed

DAY = dt.date.fromisoformat


def page(*rows, header="Transaction Date"):
    cells = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<p>Filed 03/04/2026</p><table><tr><th>{header}</th></tr>{cells}</table>"


GOOD = ("1", "03/01/2026", "Self", "ABC", "A fund", "Stock", "Purchase", "$1,001 - $15,000", "--")
BAD = {
    "a page without a table of transactions": page(GOOD, header="Nothing"), "a row of cells: 2": page(GOOD, ("1", "2")), "no date: soon": page((*GOOD[:1], "soon", *GOOD[2:])), "no amount: much": page(GOOD, (*GOOD[:7], "much", "--")),
    "no number: n": page(("n", *GOOD[1:])), "no date: never": page((*GOOD[:1], "never", *GOOD[2:7], "much", "--"), ("1",)),
}


def test_broken_filings_are_set_aside(spark):
    docs = [(f"bad{i}", html, None) for i, html in enumerate(BAD.values())] + [("a", page(GOOD, GOOD), 1), ("b", page(), 2), ("n", None, 3)]
    df = spark.createDataFrame(docs, "filing string, html string, row_ int").withColumn("filed_on", F.lit("2026-03-05").cast("date"))
    rows, sound, bad = filings.set_aside(df, "html", filings.ptr_rows)
    assert {r.filing: r.reason for r in bad.collect()} == {f"bad{i}": reason for i, reason in enumerate(BAD)} | {"n": "a page without a table of transactions"}
    assert [(r.filing, r.row, r.lo, r.hi) for r in rows.collect()] == [("a", 1, 1001, 15000)] * 2 and sorted(r.filing for r in sound.collect()) == ["a", "b"]
    # What is set aside stays out of the state, so a later run with a better parser reads it again.
    _, state = landing.senate_state(spark.createDataFrame([], "filing string, filed date, ord int"), sound.select("filing", F.col("filed_on").alias("filed"), F.col("row_").alias("ord")))
    assert sorted(r.filing for r in landing.unseen(df.select("filing"), state, "filing").collect()) == ["bad0", "bad1", "bad2", "bad3", "bad4", "bad5", "n"]
    with pytest.raises(Exception, match="no date: soon"):
        filings.ptr_transactions(spark.createDataFrame([(BAD["no date: soon"],)], "html string")).collect()


@pytest.mark.parametrize(
    ("parser", "sound", "broken"),
    [
        (filings.index_rows, "<Member><DocID>2</DocID><Year>2026</Year></Member>", {"<a/>": "no <Member> rows in the index", "<Member><DocID/></Member>": "a row of the index without DocID: <Member><DocID/></Member>", "<Member><DocID>1</DocID><FilingDate>3-4</FilingDate></Member>": "no date: 3-4", "<Member><DocID>1</DocID><Year>x</Year></Member>": "no year: x"}),
        (filings.asset_rows, "Part 3. Assets<tr><td>1</td><td>A</td><td>b</td><td>Self</td><td>--</td></tr>", {"Part 2.": "a report without part 3", "Part 3. Assets<tr><td>1</td><td>A</td><td>b</td><td>Self</td><td>lots</td></tr>": "no amount: lots"}),
        (filings.image_rows, "https://efd-media-public.senate.gov/a.gif", {"<p>": "a paper filing without scans", "": "a paper filing without scans"}),
    ],
)
def test_each_parser_gives_reasons(spark, parser, sound, broken):
    rows, _, bad = filings.set_aside(spark.createDataFrame([(t,) for t in (sound, *broken)], "t string").withColumn("k", F.col("t")), "t", parser)
    assert {r.k: r.reason for r in bad.collect()} == broken and [r.k for r in rows.collect()] == [sound]


def test_rows_of_searches_are_set_aside(spark):
    link = '<a href="/search/view/ptr/12345678-1234-1234-1234-123456789abc/">Periodic</a>'
    cells = [["a", "b", "c", link, "1/2/2026"], ["a", "b", "c", "no link", "1/2/2026"], ["a"], ["a", "b", "c", link, "soon"], ["a", "b", None, link, "1/2/2026"]]
    rows, _, bad = filings.set_aside(spark.createDataFrame(list(enumerate(cells)), "i int, cells array<string>"), "cells", filings.hit_rows)
    assert [r.i for r in rows.collect()] == [0] and {r.i: r.reason for r in bad.collect()} == {1: "no link to a filing: no link", 2: "a search's row of fewer than 5 cells", 3: "no date: soon", 4: "a search's row of fewer than 5 cells"}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("  JT   Grain and Oil Co    S (partial)  01/02/2026 01/09/2026  $1,001-$15,000", ("JT", "Grain and Oil Co", "S", True, 1001, 15000)),
        ("Plain E 01/02/2026   01/09/2026 $50 - ", (None, "Plain", "E", False, 50, None)),
        (" SP  Two  words  P(partial)  01/02/2026 01/09/2026   $1", ("SP", "Two words", "P", True, 1, None)),
        ("SP Corp P 01/02/2026 01/09/2026 $1 - $2", (None, "SP Corp", "P", False, 1, 2)),
        ("Of 12/31/2025 date S 01/02/2026 01/09/2026 $1 - $2", (None, "Of 12/31/2025 date", "S", False, 1, 2)),
        ("Q P 01/02/2026 01/09/2026 1 - $2", None), ("Q X 01/02/2026 01/09/2026 $1", None), ("Q P 1/2/2026 01/09/2026 $1", None), ("Q P 01/09/2026 $1", None), ("Q P 01/02/2026 01/09/2026 $1 $2", None),
        ("Q P 01/02/2026 01/09/2026 $1 - $2 more", None), ("P 01/02/2026 01/09/2026 $1", None), ("$ / ", None),
    ],
)
def test_lines_of_transactions(spark, line, want):
    got = filings.layout_transactions(spark.createDataFrame([(line,)], "text string")).collect()
    assert [(r.owner_code, r.asset, r.type_code, r.partial, r.lo, r.hi) for r in got] == ([] if want is None else [want])


@pytest.mark.parametrize(
    ("rest", "asset", "hi"),
    [
        (["   - $9,000 "], "A", 9000), (["  of gold   $9,000"], "A of gold", 9000), (["  of gold   - $9,000", "  more"], "A of gold more", 9000), (["of gold $9,000"], "A of gold $9,000", None), (["$9", "$8"], "A $8", 9),
        (["x", "Label: y", "z"], "A x Label: y z", None), (["x", "Label : y", "z"], "A x", None), (["x", "Label:", "z"], "A x", None), (["TYPE of", "Type", "z"], "A TYPE of", None), (["Dates", "Date", "$9"], "A Dates", None),
        (["", "z"], "A", None), (["id  OWNER", "z"], "A", None), (["*  For the complete list"], "A", None), (["$200?", "z"], "A", None), (["digitally signed: X", "$9"], "A", None), (["Gains"], "A", None),
    ],
)
def test_what_belongs_to_an_asset(spark, rest, asset, hi):
    text = "\r\n".join([" A  P  01/02/2026 01/09/2026  $5 -", *rest])
    (r,) = filings.layout_transactions(spark.createDataFrame([(text,)], "text string")).collect()
    assert (r.asset, r.lo, r.hi) == (asset, 5, hi)


def test_running_sums(spark):
    g = random.Random(2)
    rows = [(i, g.randrange(5), g.randrange(-3, 9)) for i in range(300)]
    got = {r.i: r.s for r in prefix.sum_before(spark.createDataFrame(rows, "i int, k int, v int").repartition(7), [F.desc("k"), F.col("i")], "v", "s").collect()}
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[i], total = total, total + v
    assert got == want and prefix.sum_before(spark.createDataFrame([], "i int, v int"), [F.col("i")], "v", "s").count() == 0


def spend(rows, known, decisive, budget, each, failed):
    """The searches one by one, as a run makes them."""
    left, used, skipped, without, made = budget, 0, 0, 0, {}
    for h in rows:
        if h not in known:
            continue
        read = decided = False
        made[h] = 0
        for n in range(each):
            if left <= 0:
                skipped += 1
                break
            left, used = left - 1, used + 1
            made[h] += 1
            if (h, n) in failed:
                continue
            read = True
            if (h, n) in decisive:
                decided = True
                break
        without += not read and not decided and left <= 0
    return used, skipped, without, made


@pytest.mark.parametrize("seed", range(6))
def test_the_budget_is_spent_as_results_come(spark, seed):
    g = random.Random(seed)
    n, each = 60, 1 + (seed > 1)
    known = {i for i in range(n) if g.random() < 0.9}
    decisive, failed = ({(i, k) for i in range(n) for k in (0, 1) if g.random() < p} for p in (0.4, 0.2))
    holdings = spark.createDataFrame([(i, i, "M" if i in known else "X", "T", "miner", "holds") for i in range(n)], "holding int, ord int, member string, ticker string, kind string, status string")
    members, none = spark.createDataFrame([("M", "Ann Oda"), ("M", "Ann Oda")], "member string, name string"), spark.createDataFrame([], "ticker string, kind string, name string")
    table = lambda x: spark.createDataFrame(sorted(x), "holding int, nth int")
    for budget in (0, 1, g.randrange(2, 80), 500):
        out = review.spent(holdings, members, none, table(decisive), budget, each, table(failed))
        used, skipped, without, made = spend(range(n), known, decisive, budget, each, failed)
        assert {r.holding: r.searched for r in out.collect()} == made
        assert tuple(review.told(out).first()) == (used, skipped, without)


def test_one_search_for_three_holdings(spark):
    holdings = spark.createDataFrame([(i, i, "M", "T", "miner", "holds") for i in (1, 2, 3)], "holding int, ord int, member string, ticker string, kind string, status string")
    members, none = spark.createDataFrame([("M", "Ann Oda")], "member string, name string"), spark.createDataFrame([], "ticker string, kind string, name string")
    results = spark.createDataFrame([(h, 0, 0, "Oda bought T", f"https://{h}", "") for h in (1, 2)], "holding int, nth int, pos int, title string, url string, text string")
    decisive = review.judged(results, holdings, members, none).where("class <> 'none'").select("holding", "nth").distinct()
    out = review.spent(holdings, members, none, decisive, budget=1)
    assert tuple(review.told(out).first()) == (1, 2, 2)
    assert [(r.holding, r.outcome) for r in review.outcomes(results, holdings, members, none, out).collect()] == [(1, "corroborated")]


EVIDENCE = "holding string, ord int, outcome string, url string, title string"


def states(rows):
    out = {}
    for h, _, outcome, url, _ in rows:
        state, urls = out.setdefault(h, ["unverified", []])
        if outcome and not (outcome == "corroborated" and state == "conflict"):
            out[h][0] = outcome
            if url and url.startswith("http") and url not in urls:
                urls.append(url)
    return out


def test_a_review_survives_a_restart(spark, tmp_path):
    g = random.Random(5)
    batches = [[(g.choice("abcdef"), 100 * b + i, g.choice([None, "corroborated", "corroborated", "conflict"] if b else [None, "corroborated"]), g.choice([None, "ftp://x", "https://1", "https://2", f"https://{b}{i}"]), g.choice([None, "t"])) for i in range(12)] for b in range(3)]
    for rows in batches:
        spark.createDataFrame(rows, EVIDENCE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # Each run is a query of its own: what it knows of earlier ones comes from the checkpoint.
        feed.review_stream(spark.readStream.schema(EVIDENCE).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.holding: [r.verification, r.urls] for r in feed.latest_review(spark, f"{tmp_path}/out").collect()}
    want = states([r for b in batches for r in b])
    assert got == want and {s for s, _ in want.values()} >= {"conflict"}
    assert spark.read.parquet(f"{tmp_path}/out").where("batch = 2").count() == len({r[0] for r in batches[2]})  # only holdings that the batch names


def test_a_feed_takes_late_keys_and_loses_no_row(spark, tmp_path):
    schema = "id int, ts timestamp, v string"
    day = lambda y, m=1, d=1: dt.datetime(y, m, d)
    batches = [
        [(1, day(2024, 1, 2), "b"), (1, day(2024), "a"), (2, day(2024, 6), "c")],
        [(3, day(2019), "late"), (1, day(2024, 12), "again"), (None, day(2024), "no key"), (None, day(2024), "no key")],
        [(2, day(2025, 6), "again"), (4, day(2020), "late"), (4, None, "no time"), (None, day(2025), "no key either"), (5, day(2025, 6), "d")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed.change_feed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "id", "ts", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    read = lambda: sorted((tuple(r) for r in feed.rows(spark, f"{tmp_path}/out", schema).select("id", "v").collect()), key=str)
    want = [(1, "a"), (2, "c"), (3, "late"), (4, "late"), (5, "d"), (None, "no key"), (None, "no key"), (None, "no key either")]
    assert read() == sorted(want, key=str)
    # A batch that was committed, but whose offsets were not, comes again.
    feed.take(spark.createDataFrame(batches[2], schema), "id", "ts", f"{tmp_path}/out", f"{tmp_path}/cp", 2)
    assert read() == sorted(want, key=str)
    assert feed.rows(spark, f"{tmp_path}/nothing", schema).count() == 0


def test_a_failed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    schema = "id int, ts timestamp"
    batch = lambda *ids: spark.createDataFrame([(i, dt.datetime(2024, 1, 1)) for i in ids], schema)
    out = f"{tmp_path}/out"
    feed.take(batch(1, 2), "id", "ts", out, "run", 0)
    real = feed.write_small
    monkeypatch.setattr(feed, "write_small", lambda *_: (_ for _ in ()).throw(OSError("no commit")))
    with pytest.raises(OSError, match="no commit"):
        feed.take(batch(2, 3, None), "id", "ts", out, "run", 1)
    assert sorted(r.id for r in feed.rows(spark, out, schema).collect()) == [1, 2]
    monkeypatch.setattr(feed, "write_small", real)
    feed.take(batch(2, 3, None), "id", "ts", out, "run", 1)
    feed.take(batch(3, 4), "id", "ts", out, "run", 2)
    assert sorted((r.id for r in feed.rows(spark, out, schema).collect()), key=str) == [1, 2, 3, 4, None]


def test_a_batch_of_one_key_reads_one_bucket(spark, tmp_path):
    schema, out = "id int, ts timestamp", f"{tmp_path}/out"
    at = dt.datetime(2024, 1, 1)
    for n in (0, 1):
        feed.take(spark.range(3000 * n, 3000 * n + 3000).select(F.col("id").cast("int"), F.lit(at).alias("ts")), "id", "ts", out, "run", n)
    assert feed.last_commit(spark, out)["read"] == [] or len(feed.last_commit(spark, out)["read"]) < 20  # hardly a filter answers for a new key
    assert len(feed.last_commit(spark, out)["buckets"]) == feed.BUCKETS
    one = lambda i: spark.createDataFrame([(i, at)], schema)
    feed.take(one(77), "id", "ts", out, "run", 2)
    bucket = one(77).select(F.pmod(F.xxhash64("id"), F.lit(feed.BUCKETS))).first()[0]
    assert feed.last_commit(spark, out)["read"] == [bucket] and feed.last_commit(spark, out)["buckets"] == []
    feed.take(one(999_999), "id", "ts", out, "run", 3)
    assert feed.last_commit(spark, out)["read"] == [] and len(feed.last_commit(spark, out)["buckets"]) == 1
    assert feed.rows(spark, out, schema).count() == 6001
    # Compacted, a bucket's keys are one file, and nothing is forgotten.
    assert feed.compact(spark, out) == 4 and feed.compact(spark, out) == 0
    files = spark.read.parquet(f"{feed._at(out, 'keys', feed.last_commit(spark, out)['version'])}/bucket={bucket}").inputFiles()
    assert len(files) == 1 and not list((tmp_path / "out/keys/000000001").glob("*"))
    feed.take(spark.createDataFrame([(77, at), (5999, at), (7_000_000, at)], schema), "id", "ts", out, "run", 4)
    assert feed.rows(spark, out, schema).count() == 6002 and sorted(r.id for r in feed.rows(spark, out, schema).where("id > 6000").collect()) == [999_999, 7_000_000]


def walk(items):
    lines, top = [], None
    for i in sorted(items, key=lambda i: (-i[1], i[0], i[3])):
        if top is None or abs(i[1] - top) > 2:
            lines.append([])
            top = i[1]
        lines[-1].append(i)
    return ["  ".join(i[2] for i in sorted(line, key=lambda i: (i[0], -i[1], i[3]))) for line in lines]


def test_lines_of_positioned_items(spark):
    slope = [(float(x), 700 - 0.9 * x, f"s{x}", x) for x in range(8)]  # each is near the one before it, not near the first
    ties = [(5.0, 100.0, "b", 2), (5.0, 100.0, "a", 1), (1.0, 99.0, "left", 3), (2.0, 102.0, "up", 4), (0.0, 97.9, "below", 5)]
    g = random.Random(1)
    rough = [(float(g.randrange(5)), g.randrange(400) / 10, f"t{i}", i) for i in range(80)]
    pages = {"slope": slope, "ties": ties, "rough": rough}
    rows = [(p, *i) for p, items in pages.items() for i in items] + [("ties", None, 5.0, "no place", 9), ("none", None, None, "x", 1)]
    items = spark.createDataFrame(rows, "page string, x double, y double, text string, ord int")
    got = {}
    for r in positioned.lines(items, ["page"]).orderBy("page", "line").collect():
        got.setdefault(r.page, []).append(r.text)
    assert got == {p: walk(i) for p, i in pages.items()} and got["slope"][0] == "s0  s1  s2" and got["ties"] == ["up  a  b", "below  left"]
    assert {r.page: r.text for r in positioned.page_text(items, ["page"]).collect()} == {p: "\n".join(x) for p, x in got.items()}


def test_contracts_name_every_place(spark):
    day = DAY("2026-01-01")
    good = ("S", 2, 1, 1, 0, None, [("M000001", "Al", "R", "holds", (1, 2), [day]), ("D000002", "Di", "D", "stale", (0, 0), []), ("D000003", "Ed", "D", "sold", (5, 9), [])])
    bad = ("", 1, 1, 0, None, day, [("x", None, "X", "gone", (3, 2), [day] * 11), (None, "", "D", "sold", (-1, None), None), ("M000001", "Al", "R", None, None, [])])
    kinds = "security string, owners_count int, party_r int, party_d int, party_i int, latest_buy date, owners array<struct<member: string, name: string, party: string, status: string, range: struct<lo: int, hi: int>, buy_dates: array<date>>>"
    rows = spark.createDataFrame([good, bad, (*good[:1], 3, *good[2:]), (*good[:6], None)], kinds)
    sound, broken = contract.checked(rows, contract.COMMON)
    assert sound.columns == rows.columns and sound.count() == 1
    got = [sorted(r.faults) for r in broken.collect()]
    assert got[0] == sorted([
        "security: must have 1 letters or more", "owners_count: must be 2 or more", "party_i: is missing", "owners[0].member: must be a letter and six digits", "owners[0].name: is missing", "owners[0].party: must be one of R, D, I",
        "owners[0].status: must be one of holds, sold, stale", "owners[0].range: hi must not be below lo", "owners[0].buy_dates: must have 10 or fewer", "owners[1].member: is missing", "owners[1].name: must have 1 letters or more",
        "owners[1].range.lo: must be 0 or more", "owners[1].range.hi: is missing", "owners[1].buy_dates: is missing", "owners[2].status: is missing", "owners[2].range: is missing",
    ])
    assert got[1] == ["row: owners_count must be the number of owners that have not sold", "row: the parties must sum to owners_count"] and got[2] == ["owners: is missing"]


def test_contracts_of_documents_and_entries(spark):
    day = DAY("2026-01-02")
    trade = lambda filed, **k: {"asset": "a", "security": None, "side": "buy", "owner": None, "range": (1, 2), "traded": day, "filed": filed} | k
    kinds = """member string, name string, positions array<struct<security: string, owner: string, status: string, range: struct<lo: int, hi: int>, as_of: date>>,
    trades array<struct<asset: string, security: string, side: string, owner: string, range: struct<lo: int, hi: int>, traded: date, filed: date>>, series array<struct<date: date, value: double>>"""
    tup = lambda t: tuple(t.values())
    docs = [("M000001", "Al", [("S", "self", "holds", (1, 2), day)], [tup(trade(day))], [(day, 1.5)]), ("M000001", "Al", [], [tup(trade(DAY("2026-01-01"), side="swap")), None], [(None, -1.0)]), ("M000001", "Al", [], [], [])]
    told = [r.f for r in spark.createDataFrame(docs, kinds).select(contract.faults(contract.PORTFOLIO, name="portfolio").alias("f")).collect()]
    assert told == [[], ["portfolio.trades[0].side: must be one of buy, sell", "portfolio.trades[0]: filed before it was traded", "portfolio.trades[1]: is missing", "portfolio.series[0].date: is missing", "portfolio.series[0].value: must be 0 or more"], ["portfolio.trades: must have 1 or more"]]
    entry = spark.createDataFrame([("M000001", "Al", "R", "house", "TX", True, 3, day, False), ("M1", "", "Q", "moon", "TXX", None, -1, None, None)], "member string, name string, party string, chamber string, state string, active boolean, trades int, last_trade date, on_roster boolean")
    struct = entry.select(F.struct("*").alias("e")).select(F.size(contract.faults(contract.DIRECTORY, F.col("e"))).alias("n"))
    assert [r.n for r in struct.collect()] == [0, 9] == [len(r.f) for r in entry.select(contract.faults(contract.DIRECTORY).alias("f")).collect()]


def cells(number, day, link="ptr"):
    return ["A", "B", "Senator", f'<a href="/search/view/{link}/00000000-0000-0000-0000-{number:012d}/">Periodic</a>' if link else "none", day]


def test_pages_of_a_search_add_up(spark, tmp_path):
    def land(search, page, total, *rows):
        (tmp_path / search).mkdir(exist_ok=True)
        (tmp_path / search / f"{page}.json").write_text(json.dumps({"recordsTotal": total, "data": rows}) if total is not None else "<html>")

    land("whole", 1, 3, cells(1, "1/5/2026"), cells(2, "1/6/2026"))
    land("whole", 2, 3, cells(3, "1/6/2026", None))
    land("short", 1, 3, cells(4, "1/6/2026"))
    land("drift", 1, 1, cells(5, "1/6/2026"))
    land("drift", 2, 2, cells(6, "1/6/2026"))
    land("ill", 1, None)
    land("same", 1, 1, cells(2, "1/6/2026"))
    land("none", 1, 0)
    pages = searches.pages(searches.answers(spark, str(tmp_path)))
    assert {r.search: r.reason for r in searches.unfinished(pages).collect()} == {"short": "1 rows of 3", "drift": "pages name totals from 1 to 2", "ill": "1 pages without an answer"}
    found, bad = searches.hits(pages)
    assert sorted((r.search, int(r.filing[-4:])) for r in found.collect()) == [("same", 2), ("whole", 1), ("whole", 2)] and [(r.page, r.reason) for r in bad.collect()] == [("2", "no link to a filing: none")]
    state = spark.createDataFrame([], "filing string")
    numbers = lambda last, state=state: sorted(int(r.filing[-4:]) for r in searches.due(found, state, last).collect())
    assert numbers(None) == [1, 2] and numbers(F.lit(None).cast("date")) == [1, 2] and numbers(F.lit("2026-01-06").cast("date")) == [2]
    assert numbers(F.lit("2026-01-05").cast("date"), found.where("filing like '%1'").select("filing")) == [2]
    # A stream reads the same pages, each once.
    seen = []
    for search, page in (("whole", 3), ("late", 1)):
        q = searches.pages(searches.answers(spark, str(tmp_path), stream=True)).writeStream.foreachBatch(lambda df, n: seen.extend((r.search, r.page, r.total, str(r.cells), r.fault) for r in df.collect()))
        q.option("checkpointLocation", str(tmp_path.parent / "pages_cp")).trigger(availableNow=True).start().awaitTermination()
        land(search, page, 3)
    whole = [(r.search, r.page, r.total, str(r.cells), r.fault) for r in searches.pages(searches.answers(spark, str(tmp_path))).collect()]
    assert sorted(map(str, seen)) == sorted(str(r) for r in whole if r[:2] != ("late", "1"))


def test_a_page_reads_few_row_groups(spark, tmp_path):
    g = random.Random(3)
    rows = [(m, dt.date(2020, 1, 1) + dt.timedelta(g.randrange(200)), dt.date(2021, 1, 1) + dt.timedelta(g.randrange(9)), i, "x" * 50) for i in range(40_000) for m in [min(39, int(g.expovariate(0.15)))]]
    df = spark.createDataFrame(rows, "member int, traded date, filed date, ord int, text string")
    path = str(tmp_path / "trades")
    lookup.write(df, path, group_bytes=20_000, files=6)
    want = sorted(((r[1], r[2], r[3]) for r in rows if r[0] == 7), key=lambda r: (-r[0].toordinal(), -r[1].toordinal(), r[2]))
    got, after = [], None
    while page := [tuple(r)[1:4] for r in lookup.page(spark, path, 7, after, 300).collect()]:
        got += page
        after = page[-1]
    assert got == want
    third = lookup.page(spark, path, 7, want[599], 300)
    assert [r.ord for r in third.collect()] == [r[2] for r in want[600:900]]
    plan = third._jdf.queryExecution().executedPlan()
    read = 0
    stack = [plan]
    while stack:
        node = stack.pop()
        node = node.executedPlan() if "AdaptiveSparkPlan" in node.getClass().getName() else node
        if node.nodeName().startswith("Scan parquet"):
            read += node.metrics().apply("numOutputRows").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    assert 300 <= read < 6000  # of 40,000 rows; the member has a few thousand
    assert lookup.last_of(lookup.page(spark, path, 999)) is None


def test_answers_are_checked_before_they_land(spark, tmp_path):
    folder = f"{tmp_path}/copies"
    at = lambda h: F.lit(f"2026-01-01 {h:02d}:00:00").cast("timestamp")
    fetched = lambda *rows: spark.createDataFrame(rows, "name string, body string")
    wanted = spark.createDataFrame([(n,) for n in ("a", "a", "b", "c", None)], "name string")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(caches.due(wanted, caches.copies(spark, folder), at(1))) == ["a", "b", "c"]
    bad = caches.land(fetched(("a", "[1]"), ("b", "<html>"), ("c", " "), ("d", None)), folder, at(1))
    assert {r.name: r.reason for r in bad.collect()} == {"b": "no JSON", "c": "an empty answer", "d": "an empty answer"}
    # A broken answer does not take the good copy's place, and the old copy serves when it is stale.
    assert names(caches.land(fetched(("a", "{"), ("b", '{"x": 2}')), folder, at(9))) == ["a"]
    copies = caches.copies(spark, folder)
    assert sorted((r.name, r.body, r.fresh) for r in caches.serving(copies, at(22)).collect()) == [("a", "[1]", False), ("b", '{"x": 2}', True)]
    assert names(caches.due(wanted, copies, at(22))) == ["a", "c"] and names(caches.due(wanted, copies, at(22), hours=12)) == ["a", "b", "c"]


def test_each_chart_is_asked_for_once(spark):
    buys = spark.createDataFrame([("ibit", False), (" IBIT ", None), ("SPY", False), (None, False), ("", False), ("X", True)], "ticker string, options boolean")
    none = spark.createDataFrame([], caches.COPY)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    assert sorted(r.name for r in caches.charts_due(buys, none, now).collect()) == ["IBIT", "SPY"]
    assert caches.charts_due(buys.where("options"), none, now).count() == 0


def test_recent_rows_come_before_histories(spark):
    recent = spark.createDataFrame([("t1", "new"), ("t2", "b"), (None, "x")], "id string, v string")
    histories = spark.createDataFrame([("t1", "old", 1), ("t3", "c", 2)], "id string, v string, more int")
    rows = sorted(((r.ord, r.id, r.v, r.more) for r in caches.both(recent, histories).collect()))
    assert [r[1:3] for r in rows][:2] == [("t1", "new"), ("t2", "b")] and {r[1:] for r in rows} == {("t1", "new", None), ("t2", "b", None), ("t1", "old", 1), ("t3", "c", 2)}
