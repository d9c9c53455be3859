"""Tag maps: MAP<STRING, STRING>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(key: str, tags: Column | None = None) -> Column:
    """The value of a tag; a missing tag reads as an empty one."""
    return F.coalesce(F.try_element_at(F.col("tags") if tags is None else tags, F.lit(key)), F.lit(""))


def has_tag(key: str, tags: Column | None = None) -> Column:
    return F.map_contains_key(F.col("tags") if tags is None else tags, key)


def upserted(tags: Column, values: dict[str, Column]) -> Column:
    """``tags`` with ``values`` put in; a null value leaves its tag as it is."""
    new = F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    kept = F.map_filter(tags, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
