"""Makes the package importable in Python workers, wherever the driver runs from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_ctxvote_shipped"


def ensure_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ctxvote-")) / "ctxvote_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    sc.addPyFile(str(archive))
    setattr(sc, _SHIPPED, True)
