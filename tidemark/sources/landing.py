"""Landed files: reads with fixed schemas, zipped entries, ledgers, states, and outputs that appear as a whole.

A published table is a folder of versions and a pointer, a small file that names the one to read. A publish writes new
versions, reads them again and checks them; only then is the pointer of all of them put in place, in one step, so readers
see the old outputs or the new ones. Old versions stay until they are pruned.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.resolve import first_by
from tidemark.shared import stored

THIRD = """id string, source_id string, transaction_date string, filing_date string, owner string, ticker string, asset_name string, asset_type string, transaction_type string,
amount_range_low double, amount_range_high double, is_late int, comment string, doc_url string, filer_id string, filer_name string, branch string, chamber string, party string, state string"""
FILER = "id string, full_name string, branch string, chamber string, party string, state string"
#: Landed files of the third party: name, and schema.
DATASETS = {
    "trades": THIRD, "filers": FILER, "tickers": "ticker string, trade_count int, filer_count int, purchases int, sales int, est_volume double",
    "returns": "id string, full_name string, scored_buys int, avg_excess double, avg_ret double, weighted_excess double",
}
_SNAPSHOT = "struct<date: string, close: double>"
_CHART = """chart struct<error: struct<code: string, description: string>, result: array<struct<timestamp: array<bigint>,
indicators: struct<quote: array<struct<close: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"""


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's path, and the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return bool(fs.globStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def read_json(spark: SparkSession, path: str, schema: str, must_exist: bool = True) -> DataFrame:
    """Rows of JSON documents; malformed ones raise. A missing path gives no rows unless it must exist; any other fault
    is no missing path and raises."""
    if not must_exist and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_inputs(spark: SparkSession, folder: str, required: dict[str, str], optional: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables by name from ``<folder>/<name>.json``; of the optional ones (previous outputs), empty tables where missing."""
    tables = {name: read_json(spark, f"{folder}/{name}.json", schema) for name, schema in required.items()}
    return tables | {name: read_json(spark, f"{folder}/{name}.json", schema, must_exist=False) for name, schema in (optional or {}).items()}


def third_party(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The third party's landed datasets, and ``prices``: ``symbol, snapshot (month, previous or latest), date, close``."""
    tables = {name: read_json(spark, f"{folder}/{name}.json", schema) for name, schema in DATASETS.items()}
    raw = spark.read.text(f"{folder}/prices.json", wholetext=True)
    by_symbol = F.from_json("value", f"map<string, struct<latest: {_SNAPSHOT}, previous: {_SNAPSHOT}, month: {_SNAPSHOT}>>", {"mode": "FAILFAST"})
    rows = raw.select(F.explode(by_symbol).alias("symbol", "s")).select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("snapshot"), F.col(f"s.{n}.date").alias("date"), F.col(f"s.{n}.close").alias("close")) for n in ("month", "previous", "latest")])).alias("p"))
    return tables | {"prices": rows.select("symbol", "p.snapshot", F.to_date("p.date").alias("date"), "p.close").where("close is not null")}


def filer_histories(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of all per-filer files that a pattern names (none is no fault), each with its filer's columns filled in."""
    docs = read_json(spark, pattern, f"filer struct<{FILER.replace(' string', ': string')}>, trades array<struct<{', '.join(c.strip().replace(' ', ': ') for c in THIRD.split(','))}>>", must_exist=False)
    rows = docs.select("filer", F.explode("trades").alias("t")).select("filer", "t.*")
    own = {"filer_id": "id", "filer_name": "full_name", "branch": "branch", "chamber": "chamber", "party": "party", "state": "state"}
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"filer.{f}")) for c, f in own.items()}).drop("filer")


def price_series(payloads: DataFrame, body: str = "body") -> DataFrame:
    """The columns of ``payloads`` but the chart's JSON, with ``date`` and ``close``: the adjusted close, else the close;
    days without one are left out. A chart with an error or without any close raises."""
    own = [c for c in payloads.columns if c != body]
    rows = payloads.withColumn("_c", F.from_json(body, _CHART, {"mode": "FAILFAST"})["chart"])
    r = F.get("_c.result", F.lit(0))
    adjusted, plain = F.get(r["indicators"]["adjclose"], F.lit(0))["adjclose"], F.get(r["indicators"]["quote"], F.lit(0))["close"]
    none = F.array().cast("array<double>")
    points = F.transform(r["timestamp"], lambda t, i: F.struct(F.to_date(F.timestamp_seconds(t)).alias("date"), F.coalesce(F.get(F.coalesce(adjusted, none), i), F.get(F.coalesce(plain, none), i)).alias("close")))
    points = F.filter(points, lambda p: p["close"].isNotNull())
    fault = F.coalesce(F.concat(F.lit("the chart has an error: "), F.col("_c.error.code")), F.lit("a chart without closes"))
    sound = F.when(F.col("_c.error").isNull() & (F.size(points) > 0), points).otherwise(F.raise_error(fault))
    return rows.select(*own, F.explode(F.array_sort(sound)).alias("p")).select(*own, "p.date", "p.close")


def search_results(payloads: DataFrame, body: str = "body") -> DataFrame:
    """The columns of ``payloads`` but a search's JSON, with ``pos``, ``title``, ``url``, ``publishedDate`` and ``text`` of
    each result; an answer without results' list raises."""
    own = [c for c in payloads.columns if c != body]
    got = F.from_json(body, "results array<struct<title: string, url: string, publishedDate: string, text: string>>", {"mode": "FAILFAST"})["results"]
    return payloads.select(*own, F.posexplode(F.when(got.isNotNull(), got).otherwise(F.raise_error(F.lit("a search's answer without results")))).alias("pos", "r")).select(*own, "pos", "r.*")


def read_zip_entries(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``path``, ``entry`` and ``text`` of the first entry of each zip file whose name ends with ``suffix``; a file that is
    no zip or has no such entry raises and names what it has."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile as e:
                    raise ValueError(f"{name} is no readable zip file") from e
                with archive:
                    entry = next((e for e in archive.namelist() if e.endswith(suffix)), None)
                    if entry is None:
                        raise ValueError(f"{name} has no {suffix} (but {', '.join(archive.namelist())})")
                    rows.append((name, entry, archive.read(entry).decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "entry", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, entry string, text string")


def newest_landed(files: DataFrame, name: str = "name", landed: str = "landed") -> DataFrame:
    """Of each file's landed copies the last, however old: where a feed fails, the last good copy serves."""
    return first_by(files, [name], [F.desc(landed)])


def stale(files: DataFrame, now: Column, hours: int = 20, landed: str = "landed") -> DataFrame:
    """Files that are to be fetched again."""
    return files.where((F.unix_timestamp(now) - F.unix_timestamp(landed)) > hours * 3600)


def unseen(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return rows.join(state.select(key), key, "left_anti")


def transaction_reports(filings: DataFrame, state: DataFrame, most: int | None = None) -> DataFrame:
    """Filings of type P that the state (``doc_id``) lacks, the oldest first; at most so many in a run, the rest stay
    unseen and come the next time."""
    rows = unseen(filings.where("filing_type = 'P'"), state, "doc_id").orderBy("filed", "doc_id")
    return rows.limit(most) if most else rows


def append_ledger(ledger: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The ledger and the first row of each key that it lacks."""
    new = first_by(rows.join(ledger.select(*key).distinct(), key, "left_anti"), key, [order])
    return ledger.unionByName(new, allowMissingColumns=True)


def keep_last(rows: DataFrame, key: str, order: list[Column | str], most: int) -> DataFrame:
    """The last ``most`` distinct keys, each at the place of its first row."""
    return first_by(rows, [key], order).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]).limit(most)


def house_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """``year`` and ``doc_id`` of all filings ever processed whole, sorted; one that failed is not among them and is read
    again."""
    return state.select("year", "doc_id").unionByName(done.select("year", "doc_id")).distinct().orderBy("year", "doc_id")


def senate_state(state: DataFrame, processed: DataFrame, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The last submitted date (one row; the next search starts there, that day included), and the last ``most`` distinct
    filings in their order. Both: ``filing, filed, ord``."""
    all_ = state.unionByName(processed.select(*state.columns))
    return all_.groupBy().agg(F.max("filed").alias("last_submitted")), keep_last(all_, "filing", ["ord"], most)


def watch_state(seen: DataFrame, hits: DataFrame) -> DataFrame:
    """Vote numbers processed so far."""
    return seen.select("number").unionByName(hits.select("number")).distinct()


def index_differs(index: DataFrame, files: DataFrame, key: str = "member") -> DataFrame:
    """Keys that only one of the index and the files has; none may be."""
    one = index.select(key, F.lit("index").alias("only")).join(files.select(key), key, "left_anti")
    return one.unionByName(files.select(key, F.lit("files").alias("only")).join(index.select(key), key, "left_anti"))


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place by one rename over the old one."""
    p, fs = _path(spark, path)
    temporary, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, p, option)


def read_small(spark: SparkSession, path: str) -> str | None:
    return "\n".join(r.value for r in spark.read.text(path).collect()) if exists(spark, path) else None


def publish(outputs: dict[str, DataFrame], folder: str, check: Callable[[str, DataFrame], list[str]]) -> str:
    """Write a new version of all outputs below ``folder``, read it again and check it; if nothing fails the pointer names
    it, in one step. The version's name. Another run writes a version of its own; a failure leaves no trace."""
    spark = next(iter(outputs.values())).sparkSession
    version = uuid.uuid4().hex
    try:
        failures = []
        for name, df in outputs.items():
            df.write.parquet(f"{folder}/versions/{version}/{name}")
            failures += [f"{name}: {x}" for x in check(name, spark.read.schema(df.schema).parquet(f"{folder}/versions/{version}/{name}"))]
        if failures:
            raise ValueError("; ".join(failures))
        write_small(spark, f"{folder}/current.json", json.dumps({"version": version, "outputs": sorted(outputs)}))
    except BaseException:
        p, fs = _path(spark, f"{folder}/versions/{version}")
        fs.delete(p, True)
        raise
    return version


def published(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A published output: that of the last good run. Before the first one, an empty table of the schema, if given."""
    pointer = read_small(spark, f"{folder}/current.json")
    if pointer is None and schema:
        return spark.createDataFrame([], schema)
    if pointer is None:
        raise FileNotFoundError(f"nothing is published below {folder}")
    return spark.read.parquet(f"{folder}/versions/{json.loads(pointer)['version']}/{name}")


def prune(spark: SparkSession, folder: str) -> int:
    """Delete all versions but the current one; how many. Not while another run may be writing or reading them."""
    pointer = read_small(spark, f"{folder}/current.json")
    p, fs = _path(spark, f"{folder}/versions/*")
    old = [s.getPath() for s in fs.globStatus(p) if pointer and s.getPath().getName() != json.loads(pointer)["version"]]
    for path in old:
        fs.delete(path, True)
    return len(old)


def report(spark: SparkSession, path: str, step: str, reason: str, stats: dict[str, float], warnings: list[str], failures: list[str] | None = None) -> None:
    """What failed, in a file of its own; the outputs stay as they are. A run that ends well removes it (``withdraw``)."""
    write_small(spark, path, json.dumps({"ok": False, "step": step, "reason": reason, "validation": failures or [], "stats": stats, "warnings": warnings}, indent=2) + "\n")


def withdraw(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, False)


class StepError(Exception):
    """A step that failed, by name."""


def step(name: str, run: Callable[[], Any]) -> Any:
    """What a step gives; a failure names it. Of steps within steps the inner one, which failed, is named."""
    try:
        return run()
    except StepError:
        raise
    except Exception as e:
        raise StepError(f"{name}: {e}") from e


def or_last_good(name: str, run: Callable[[], DataFrame], last: Callable[[], DataFrame], warnings: list[str]) -> DataFrame:
    """A step's rows, or the last good ones with a warning: rows are computed when asked for, so they are computed and
    stored here, once, and the stored ones are what the step gives."""
    try:
        return stored(run())
    except Exception as e:
        warnings.append(f"{name} failed, the previous output stays: {e}")
        return last()
