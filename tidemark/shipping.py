"""Send this package to the executors, as ``--py-files`` would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make ``tidemark`` importable in Python workers; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, Path("tidemark") / path.relative_to(here))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)
