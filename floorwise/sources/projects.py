"""A registry of projects as a table: name, path, times and the status of each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, path string, created_at string, last_modified string, status map<string,string>"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def created(projects: DataFrame, name: str, path: str) -> DataFrame:
    """The registry with one more project; an existing name stays as it is."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    new = projects.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(path).alias("path"), now.alias("created_at"), now.alias("last_modified"), F.create_map().cast("map<string,string>").alias("status"))
    return projects.unionByName(new.join(projects.select("name"), "name", "left_anti"))


def with_status(projects: DataFrame, name: str, step: str, status: str) -> DataFrame:
    own = F.col("name") == name
    changed = F.map_concat(F.map_filter("status", lambda k, v: k != step), F.create_map(F.lit(step), F.lit(status)))
    return projects.withColumns({"status": F.when(own, changed).otherwise(F.col("status")), "last_modified": F.when(own, F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("last_modified"))})
