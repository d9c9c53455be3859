"""Validation of maps as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from floorwise.operators import validate
from floorwise.sources.osm_xml import Maps, parse
from floorwise.sources.scratch import Written, tidy

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, pattern: str = "*.osm", files_per_batch: int = 1000) -> DataFrame:
    """(map_id, content) of new files."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("path").alias("map_id"), "content")


def validate_arriving(spark: SparkSession, path: str, findings_path: str, checkpoint: str, dialect: str = "semantic", **trigger) -> StreamingQuery:
    """Append each micro-batch's findings as Parquet. A batch that runs again replaces its own
    folder, so findings are written once. Its files are parsed once: the elements land in the shared folder
    until the findings are written."""

    def batch(files: DataFrame, number: int) -> None:
        with tidy():
            maps = Maps(Written(parse(files), "arrived").df)
            validate.findings(maps, dialect).write.mode("overwrite").parquet(f"{findings_path}/batch={number}")

    return arriving(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
