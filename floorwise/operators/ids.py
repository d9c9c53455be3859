"""Row numbers and id allocation without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floorwise.sources.scratch import Written


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add 1, 2, ... in the order of ``order``, which should have no ties.

    Rows go to sorted range partitions and are numbered there; only one row for each
    partition is summed up in order.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    table = Written(ranged, "numbered").df.withColumn("_part", F.shiftright("_place", 33))
    parts = table.groupBy("_part").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    joined = table.join(offsets, "_part")
    within = F.col("_place").bitwiseAND((1 << 33) - 1)
    return joined.select(*df.columns, (F.col("_before") + within + 1).alias(out))


def remapped(df: DataFrame, column: str, ids: DataFrame, old: str, new: str, by: list[str] = ()) -> DataFrame:
    """Replace references by their new ids; a reference without one stays."""
    known = ids.select(*by, F.col(old).alias("_old"), F.col(new).alias("_new"))
    on = [F.col(f"d.{column}") == F.col("i._old"), *(F.col(f"d.{c}") == F.col(f"i.{c}") for c in by)]
    joined = df.alias("d").join(known.alias("i"), on, "left")
    return joined.select(*(F.coalesce("i._new", f"d.{c}").alias(c) if c == column else F.col(f"d.{c}") for c in df.columns))
