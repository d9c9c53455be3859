"""Side files: JSON, YAML, CSV and text lists, and sinks of reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOUNDS = "min_x_padded double, min_y_padded double, max_x_padded double, max_y_padded double, svg_width_px double, svg_height_px double"
TEXTS = "text string, insert_point array<double>, block_name string, attribute_tag string, entity_type string"


def json_files(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Whole-file JSON with ``file_id``, the file's path."""
    return spark.read.schema(schema).option("multiLine", "true").json(paths).withColumn("file_id", F.col("_metadata.file_path"))


def bounds_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bounds with ``file_id``, the name of the drawing that they belong to."""
    name = F.regexp_replace(F.regexp_extract("file_id", "([^/]*)$", 1), r"\.bounds\.json$", "")
    return json_files(spark, paths, BOUNDS).withColumn("file_id", name)


def layer_standards(spark: SparkSession, path: str) -> DataFrame:
    """(standard, layer) from a JSON map of standards to lists of layers."""
    entry = "struct<description:string,layers:array<string>,layers_chinese:array<string>,layers_english:array<string>>"
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("standard", "e"))
    every = F.flatten(F.filter(F.array("e.layers", "e.layers_chinese", "e.layers_english"), lambda a: a.isNotNull()))
    return parsed.select("standard", F.explode(every).alias("layer"))


def parameters(path: str | Path, custom: str | Path | None = None) -> dict:
    """YAML parameters; a custom file replaces the whole."""
    import yaml

    with open(custom or path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def translations(spark: SparkSession, languages: dict[str, dict]) -> DataFrame:
    """(lang, key, value) with dotted keys from nested dictionaries."""
    def flat(tree: dict, head: str = ""):
        for k, v in tree.items():
            if isinstance(v, dict):
                yield from flat(v, f"{head}{k}.")
            else:
                yield f"{head}{k}", str(v)

    return spark.createDataFrame([(lang, k, v) for lang, tree in languages.items() for k, v in flat(tree)], "lang string, key string, value string")


def translated(keys: DataFrame, known: DataFrame, lang: str) -> DataFrame:
    """Keys with their value in a language, else the key itself."""
    return keys.join(known.where(F.col("lang") == lang).select("key", "value"), "key", "left").withColumn("value", F.coalesce("value", "key"))


def text_lines(spark: SparkSession, paths: str | list[str], column: str = "layer") -> DataFrame:
    """(file, line, column) with line numbers from 1; a file is read whole."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("l"))
    return whole.select("file", F.posexplode("l").alias("n", column)).select("file", (F.col("n") + 1).alias("line"), column)


def room_areas(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.schema("room string, area_m2 double").csv(paths, header=False)


def matching_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files by suffix in lower or upper case."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{suffix.lower()},{suffix.upper()}}}").load(path).select("path", "length")


def write_room_areas(report: DataFrame, path: str) -> None:
    """One ordered CSV of (room, area) without a header for each map."""
    report.select("map_id", "room", "area_m2").repartition("map_id").sortWithinPartitions("map_id", F.desc("area_m2"), "room").write.mode("overwrite").partitionBy("map_id").csv(path, header=False)


def write_json(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """JSON lines; columns in ``by`` become folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder of text for each key."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
