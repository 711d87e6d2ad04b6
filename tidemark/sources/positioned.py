"""Lines of text from positioned items, as a page's text layer gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import once

#: Items within this height of a line's first item stand on it; what stands between its items then.
TOLERANCE, GAP = 2.0, "  "


def _lines(items: Column, tolerance: float) -> Column:
    """Lines of a page's items (sorted from the top, then from the left), each an array of its items.

    An item is compared with the first one of its line, not with the one before it, so a sloping line ends where it has
    sunk by the tolerance; that is a walk along the page, and a page is small.
    """
    none = F.slice(items, 1, 0)
    start = F.struct(F.lit(None).cast("double").alias("top"), none.alias("line"), F.slice(F.array(none), 1, 0).alias("lines"))

    def step(s: Column, item: Column) -> Column:
        on = s["top"].isNotNull() & (F.abs(item["y"] - s["top"]) <= tolerance)
        ended = F.when(s["top"].isNull(), s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"])))
        return F.struct(
            F.when(on, s["top"]).otherwise(item["y"]).alias("top"), F.when(on, F.concat(s["line"], F.array(item))).otherwise(F.array(item)).alias("line"), F.when(on, s["lines"]).otherwise(ended).alias("lines"),
        )

    return once(F.aggregate(items, start, step), lambda s: F.when(s["top"].isNull(), s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))


def lines(items: DataFrame, page: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """The columns ``page`` and a row for each line of a page: ``line`` (from 0, from the top) and ``text``, its items from
    the left with a gap between them, so that columns stay apart. ``items``: those columns, ``x``, ``y`` (up), ``text``
    and ``ord`` (the order of items in one place). Items without a place are left out; a page without items has no lines."""
    placed = items.where("x is not null and y is not null")
    item = F.struct((-F.col("y")).alias("down"), F.col("x").cast("double").alias("x"), F.col("ord").alias("ord"), F.col("y").cast("double").alias("y"), F.coalesce("text", F.lit("")).alias("text"))
    walked = placed.groupBy(*page).agg(_lines(F.array_sort(F.collect_list(item)), tolerance).alias("_lines"))
    across = lambda i: F.struct(i["x"].alias("x"), i["down"].alias("down"), i["ord"].alias("ord"), i["text"].alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.transform("_line", across)), lambda i: i["text"]), GAP)
    return walked.select(*page, F.posexplode("_lines").alias("line", "_line")).select(*page, "line", text.alias("text"))


def page_text(items: DataFrame, page: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """The columns ``page`` and the ``text`` of each page, a line of text a line."""
    rows = lines(items, page, tolerance).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))
    return rows.select(*page, F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("text"))
