"""Statistics over rows: the knee of a curve, trimmed summaries, size summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.operators.ids import numbered
from floorwise.sources.scratch import Written


def knee(df: DataFrame, value: str, key: str) -> DataFrame:
    """The row of the descending curve of ``value`` that lies farthest from its chord."""
    ranked = numbered(df.select(key, value).withColumn("_down", -F.col(value)), ["_down", key], "rank")
    ends = ranked.agg(F.count("*").alias("n"), F.min_by(value, "rank").alias("first"), F.max_by(value, "rank").alias("last")).first()
    n, first, last = ends["n"], ends["first"] or 0.0, ends["last"] or 0.0
    chord = ((last - first) ** 2 + (n - 1) ** 2) ** 0.5 or 1.0
    away = F.round(F.abs((last - first) * (F.col("rank") - 1) - (n - 1) * (F.col(value) - first)) / chord, 6)
    return ranked.select(key, value, "rank", away.alias("distance")).orderBy(F.desc("distance"), "rank").limit(1)


def without_largest(df: DataFrame, value: str, n: int, by: list[str] = (), key: str | None = None) -> DataFrame:
    """Rows without the ``n`` largest values of each group, of equal ones the first by ``key``.

    Every task keeps its own ``n`` largest of a group, so no group is sorted as a whole.
    """
    if key is None:
        key = "_row"
        df = Written(df.withColumn(key, F.monotonically_increasing_id()), "rows").df
    order = [F.desc(value), F.col(key)]
    if by:
        top = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)
    else:
        top = df.orderBy(*order).limit(n)
    columns = [*by, key]
    gone = top.select(*(F.col(c).alias(f"_gone_{i}") for i, c in enumerate(columns)))
    same = reduce(Column.__and__, (df[c].eqNullSafe(gone[f"_gone_{i}"]) for i, c in enumerate(columns)))
    return df.join(gone, same, "left_anti").drop("_row")


def summary(df: DataFrame, value: str, by: list[str] = (), skip_largest: int = 0, key: str | None = None) -> DataFrame:
    """Count, minimum, maximum, mean and median, without the ``skip_largest`` largest of each group."""
    if skip_largest:
        df = without_largest(df, value, skip_largest, by, key)
    of = [F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median")]
    return df.groupBy(*by).agg(*of)


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles of all rows by linear interpolation, nulls left out.

    Values are ranked over sorted range partitions; only the two rows around each quantile
    come to the driver.
    """
    ranked = numbered(df.select(value).where(F.col(value).isNotNull()), [value], "rank")
    n = ranked.count()
    if not n:
        return []
    places = [share * (n - 1) for share in shares]
    wanted = sorted({int(p) + k for p in places for k in (1, 2) if int(p) + k <= n})
    found = {r["rank"]: float(r[value]) for r in ranked.where(F.col("rank").isin(wanted)).collect()}
    return [found[int(p) + 1] + (p - int(p)) * (found.get(int(p) + 2, found[int(p) + 1]) - found[int(p) + 1]) for p in places]


def trimmed(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Rows that lie within both percentiles on every axis, over the whole table."""
    inside = df
    for c in columns:
        ends = quantiles(df, c, [low, high])
        inside = inside.where(F.col(c).between(*ends) if ends else F.lit(False))
    return inside


def trimmed_bounds(df: DataFrame, columns: list[str], by: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Bounds of the points that lie within both percentiles on every axis (linear interpolation)."""
    cuts = df.groupBy(*by).agg(*(F.percentile(c, [low, high]).alias(f"_{c}") for c in columns))
    inside = df.join(cuts, by)
    for c in columns:
        inside = inside.where(F.col(c).between(F.col(f"_{c}")[0], F.col(f"_{c}")[1]))
    return inside.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def bar(value: Column, largest: Column, width: int = 50) -> Column:
    """A bar of ``#`` as long as the value's share of the largest."""
    return F.rpad(F.lit(""), (value / largest * width).cast("int"), "#")
