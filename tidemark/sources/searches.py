"""Landed pages of a search, scanned from where the last run has stopped.

A search is a folder of pages, each a JSON answer in a file of its own (``<folder>/<search>/<page>.json``). Pages are read
by Spark's own reader wherever they lie, one file a task's record, as a batch or as a stream; a stream opens each file
once. A search is whole if its pages hold as many rows as each of them says there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.filings import hit_rows, set_aside

_ANSWER = "recordsTotal int, recordsFiltered int, data array<array<string>>"


def answers(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """``search``, ``page`` and ``body`` of each landed page."""
    reader = (spark.readStream if stream else spark.read).option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    parts = F.split(F.col("_metadata.file_path"), "/")
    page = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    return reader.text(folder).select(F.element_at(parts, -2).alias("search"), page.alias("page"), F.col("value").alias("body"))


def pages(answers_: DataFrame) -> DataFrame:
    """``search``, ``page``, ``total`` (rows that the search has in all), ``cells`` (an array of the page's rows) and
    ``fault`` (null for a sound answer). The same over a batch and a stream."""
    read = F.from_json("body", _ANSWER)
    fault = F.when(read["recordsTotal"].isNull() | read["data"].isNull(), "a search's answer without recordsTotal or data")
    total = F.coalesce(read["recordsFiltered"], read["recordsTotal"])
    return answers_.select("search", "page", F.when(fault.isNull(), total).alias("total"), F.when(fault.isNull(), read["data"]).alias("cells"), fault.alias("fault"))


def unfinished(pages_: DataFrame) -> DataFrame:
    """Searches whose pages do not add up, with ``reason``: a page without an answer, pages that name other totals, or
    more or fewer rows than these. Nothing of them is taken: the next run's pages may differ from those there are."""
    told = pages_.groupBy("search").agg(F.count("fault").alias("broken"), F.min("total").alias("least"), F.max("total").alias("most"), F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("rows"))
    reason = F.when(F.col("broken") > 0, F.format_string("%d pages without an answer", "broken")).when(F.col("least") != F.col("most"), F.format_string("pages name totals from %d to %d", "least", "most"))
    reason = reason.when(F.col("rows") != F.col("most"), F.format_string("%d rows of %d", "rows", "most"))
    return told.select("search", reason.alias("reason")).where("reason is not null")


def hits(pages_: DataFrame, base: str = "https://efdsearch.senate.gov") -> tuple[DataFrame, DataFrame]:
    """``search`` and what ``filings.hit_rows`` says of each row of the whole searches; and the rows that are no filing,
    with ``reason``."""
    whole = pages_.join(unfinished(pages_).select("search"), "search", "left_anti")
    rows = whole.select("search", "page", F.posexplode("cells").alias("place", "cells"))
    found, _, bad = set_aside(rows, "cells", lambda c: hit_rows(c, base))
    return found, bad


def due(found: DataFrame, state: DataFrame, last: Column | None, seen: str = "filing") -> DataFrame:
    """Filings from the last submitted date on, that day included, that the state has not: filings of one day may land
    in several runs. Without a date all are due. A filing that several searches name is due once."""
    rows = found if last is None else found.where(last.isNull() | (F.col("filed") >= last))
    first = rows.groupBy("filing").agg(F.min(F.struct("search", "page", "place")).alias("_at"))
    at = F.struct("search", "page", "place")
    rows = rows.withColumn("_own", at).join(first.withColumnRenamed("filing", "_filing"), (F.col("filing") == F.col("_filing")) & (F.col("_own") == F.col("_at"))).drop("_own", "_at", "_filing")
    return rows.join(state.select(seen).distinct(), seen, "left_anti")
