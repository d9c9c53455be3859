"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Of repeated map keys the last wins, as with tags of an element.
SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def session(name: str = "floorwise", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
