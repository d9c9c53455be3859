"""The package itself as a file that executors load."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_floorwise_shipped", False):
        return
    place = Path(tempfile.mkdtemp(prefix="floorwise-")) / "floorwise_package.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_ROOT.rglob("*.py")):
            archive.write(file, file.relative_to(_ROOT.parent))
    context.addPyFile(str(place))
    context._floorwise_shipped = True
