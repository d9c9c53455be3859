"""Parameter sweeps of the segmentation over images: profiles, alphas, run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwise.functions import scalars

#: Parameters by building type: resolution, door width, corridor width, noise
#: percent, simplification tolerance, spike angle, spike distance, least room area.
PROFILES = {
    "apartment": (0.04, 0.9, 1.2, 1.5, 1.0, 15.0, 0.25, 8.0),
    "office": (0.035, 1.0, 1.5, 1.2, 1.2, 12.0, 0.20, 12.0),
    "hotel": (0.04, 0.9, 1.8, 1.5, 1.0, 15.0, 0.25, 6.0),
    "school": (0.045, 1.2, 2.5, 1.0, 1.5, 10.0, 0.15, 20.0),
    "gym": (0.05, 1.5, 3.0, 1.0, 2.0, 8.0, 0.15, 50.0),
    "residential": (0.04, 0.8, 1.0, 1.8, 0.8, 18.0, 0.30, 5.0),
    "museum": (0.04, 1.2, 2.0, 1.0, 1.5, 10.0, 0.20, 15.0),
    "monastery": (0.05, 1.0, 1.8, 1.2, 1.3, 12.0, 0.25, 10.0),
    "default": (0.044, 1.0, 1.5, 1.5, 1.3, 15.0, 0.30, 10.0),
}
COLUMNS = ["resolution", "door_width", "corridor_width", "noise_percent", "simplify_tolerance", "spike_angle", "spike_distance", "min_room_area"]
#: Words in file names by building type, in the order in which they are tried.
KEYWORDS = {
    "apartment": ["apartment", "residential", "住宅"],
    "office": ["office", "ufficio", "schema-ufficio", "办公"],
    "hotel": ["hotel", "酒店"],
    "school": ["school", "scuola", "aule", "universita", "学校", "大学"],
    "gym": ["gym", "gymnasium", "体育馆"],
    "museum": ["museum", "博物馆", "centro", "cultural", "文化中心"],
    "monastery": ["monastery", "修道院"],
}


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PROFILES.items()], "building_type string, " + ", ".join(f"{c} double" for c in COLUMNS))


def runs(images: DataFrame, alphas: str | None = None, only: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """A row of parameters for each image (file, width, height) and alpha.

    ``alphas`` is a list or range as text; without it each image runs once with its
    profile's widths. ``only`` and ``skip`` are words in file names, whatever the case.
    """
    name = F.lower("file")
    kept = images
    if only:
        kept = kept.where(F.greatest(F.lit(False), *(F.contains(name, F.lit(w.lower())) for w in only)))
    if skip:
        kept = kept.where(~F.greatest(F.lit(False), *(F.contains(name, F.lit(w.lower())) for w in skip)))
    typed = kept.withColumn("building_type", scalars.building_type(F.col("file"), KEYWORDS)).join(profiles(images.sparkSession), "building_type")
    sized = typed.withColumn("resolution", F.coalesce(scalars.sized_resolution(F.col("resolution"), F.col("width"), F.col("height")), "resolution"))
    if alphas is None:
        return sized.withColumn("alpha", scalars.alpha_of_widths(F.col("door_width"), F.col("corridor_width"), F.col("resolution")).cast("int"))
    swept = sized.withColumn("alpha", F.explode(scalars.alpha_list(F.lit(alphas))))
    door, corridor = scalars.widths_of_alpha(F.col("alpha"), F.col("resolution"))
    return swept.withColumns({"door_width": door, "corridor_width": corridor})


def records(of: DataFrame) -> DataFrame:
    """(file, alpha, json): the parameters of each run."""
    parameters = F.struct("alpha", *COLUMNS)
    derived = F.struct(scalars.alpha_of_widths(F.col("door_width"), F.col("corridor_width"), F.col("resolution")).alias("expected_alpha"))
    meta = F.struct(scalars.file_stem(F.col("file")).alias("name"), F.col("building_type"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("at"))
    return of.select("file", "alpha", F.to_json(F.struct(meta.alias("metadata"), F.struct("width", "height").alias("image_info"), parameters.alias("algorithm_parameters"), derived.alias("derived_info"))).alias("json"))


def run_statistics(log: DataFrame, by: list[str] = ("step",)) -> DataFrame:
    """Mean, median, least and most seconds of a run log (file, step, seconds)."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))


def best_settings(results: DataFrame, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """The best setting of each file, and how often each setting is best."""
    best = results.groupBy("file").agg(F.max_by("setting", F.struct(F.col(score), F.col("setting"))).alias("setting"), F.max(score).alias(score))
    return best, best.groupBy("setting").agg(F.count("*").alias("n"))
