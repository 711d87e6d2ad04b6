"""One member's rows out of a large table, a page at a time.

The table is written in ranges of (member, newest first), sorted, in small row groups whose statistics Parquet keeps, so a
look-up opens the files and reads the row groups that may hold the member. A page starts after the last row of the one
before it, so no page sorts or skips the earlier ones.
"""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a page, and bytes of a row group.
PAGE, GROUP_BYTES = 50, 1 << 20


def write(rows: DataFrame, path: str, key: str = "member", group_bytes: int = GROUP_BYTES, files: int | None = None) -> None:
    """``rows`` have the key and ``traded, filed, ord``; the newest come first, of one day the last filed, then by ``ord``."""
    order = [F.col(key), F.desc("traded"), F.desc("filed"), F.col("ord")]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 1000).mode("overwrite").parquet(path)


def page(spark: SparkSession, path: str, member: Any, after: tuple[date, date, Any] | None = None, size: int = PAGE, key: str = "member") -> DataFrame:
    """The next rows of a member after the one with that (traded, filed, ord), the newest first."""
    own = spark.read.parquet(path).where(F.col(key) == F.lit(member))
    if after:
        traded, filed, ord_ = map(F.lit, after)
        # The first condition alone reaches the statistics; the second one is exact.
        own = own.where(F.col("traded") <= traded)
        own = own.where((F.col("traded") < traded) | (F.col("filed") < filed) | ((F.col("filed") == filed) & (F.col("ord") > ord_)))
    return own.orderBy(F.desc("traded"), F.desc("filed"), "ord").limit(size)


def last_of(rows: DataFrame) -> tuple[date, date, Any] | None:
    """Where the next page starts: the last row of a page (of ``PAGE`` rows or so)."""
    got = rows.select("traded", "filed", "ord").collect()
    return tuple(got[-1]) if got else None
