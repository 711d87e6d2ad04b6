"""Registered queries and operators over all of their rows, on small tables with values worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import positions, pricing, resolve
from tidemark.plans.queries import QUERIES


def test_verification_state_counts_every_event(spark, tmp_path):
    rows = [(1, 1, "view"), (2, 1, "error"), (30, 2, "error"), (31, 2, "purchase"), (32, 3, "purchase"), (49, 4, "error"), (50, 5, "view")]
    events = [(i, u, t, 1.0, dt.datetime(2024, 1, 1)) for i, u, t in rows]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: (r.state, r.seen) for r in QUERIES["s5_verification_state"](spark, str(tmp_path)).collect()}
    assert got == {1: ("conflict", 2), 2: ("conflict", 2), 3: ("corroborated", 1), 4: ("conflict", 1), 5: ("unverified", 1)}


def test_exact_snapshots_and_price_chain(spark):
    day = dt.date.fromisoformat
    snapshot = lambda *rows: spark.createDataFrame([(s, day(d), c) for s, d, c in rows], "s string, date date, close double")
    month, previous, latest = snapshot(("A", "2024-01-31", 1.0), ("B", "2024-01-31", None)), snapshot(("A", "2024-01-31", 2.0), ("A", "2024-02-01", 3.0), ("B", "2024-01-31", 4.0)), snapshot(("A", "2024-02-02", 5.0))
    asked = spark.createDataFrame([("A", day(f"2024-{d}")) for d in ("01-30", "01-31", "02-01", "02-02")] + [("B", day("2024-01-31")), ("C", day("2024-02-02"))], "s string, d date")
    found = pricing.exact_snapshot(asked, [month, previous, latest], "s", "d")
    assert {(r.s, str(r.d)[5:]): r.entry for r in found.collect()} == {("A", "01-30"): None, ("A", "01-31"): 1.0, ("A", "02-01"): 3.0, ("A", "02-02"): 5.0, ("B", "01-31"): 4.0, ("C", "02-02"): None}
    chain = pricing.price_chain({"one": F.col("k"), "two": F.col("y")}).alias("p")
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, None, None)], "i int, k double, y double").select("i", chain).orderBy("i").collect()
    assert [tuple(r.p) for r in rows] == [(1.0, "one", None), (2.0, "two", None), (None, None, "no price from one, two")]


def test_a_sold_baseline_starts_as_sold(spark):
    day = dt.date.fromisoformat
    base = [("A", 1, 2, "2023-12-31", False, "pdf-ocr"), ("A", 3, 4, "2024-12-31", True, "pdf-text"), ("A", 5, 6, "2024-12-31", True, "efd-html"), ("B", 1, 2, "2024-12-31", True, "efd-html"), ("B", 1, 2, "2024-12-31", False, "pdf-ocr")]
    reports = spark.createDataFrame([("m", s, "self", lo, hi, day(d), sold, x) for s, lo, hi, d, sold, x in base], "member string, security string, owner string, lo long, hi long, as_of date, sold boolean, extraction string")
    latest = positions.latest_baseline(reports)
    assert {r.security: (r.lo, r.hi, r.n_reports, r.sold, r.extraction) for r in latest.collect()} == {"A": (8, 10, 2, True, "pdf-text"), "B": (2, 4, 2, False, "pdf-ocr")}
    none = spark.createDataFrame([], "member string, security string, owner string, side string, partial boolean, lo long, hi long, traded date, filed date, ord long")
    assert {r.security: r.status for r in positions.fold(none, latest).collect()} == {"A": "sold", "B": "holds"}


def test_names_of_all_lengths_match(spark):
    names = ["a" * n + " corp" for n in range(1, 301)]
    universe = spark.createDataFrame([(f"s{i}", f"T{i}", n, i) for i, n in enumerate(names)], "security string, ticker string, name string, ord long")
    texts = {f"x {names[-1]} y": "s299", f"x {names[0]} y": "s0", "none": None}
    got = {r.text: r.security for r in resolve.resolve_texts(spark.createDataFrame([(t,) for t in texts], "text string"), universe).collect()}
    assert got == texts
    assert [r.security for r in resolve.resolve_texts(spark.createDataFrame([("none",)], "text string"), universe.limit(0)).collect()] == [None]


def test_labels_of_large_orders(spark, tmp_path):
    rows = [(1, 1_000_000.0), (2, 1_600_000.0), (3, 12_400_000.0), (4, 999.0), (5, 50_000.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.total for r in QUERIES["k5_k35_k42_labels"](spark, str(tmp_path)).collect()}
    assert got == {1: "$1M", 2: "$1.6M", 3: "$12M", 4: "$999", 5: "$50K"}
