"""Drawing operators on the driver's tables, with the same in SQL.

Drawings are made from order lines, one for each line number and return flag, whose strokes are placed by keys; layers are
parts, one drawing for each brand, and what is drawn on them are order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwise.operators import drawings, raster
from floorwise.plans.registry import query, table
from floorwise.sources.scratch import Written

_AT = "2024-01-01 00:00:00"

_STROKES = """WITH placed AS (SELECT 'd' || l_linenumber || l_returnflag AS file_id, l_partkey % 400 + l_linenumber * 0.125::DOUBLE AS ax, l_suppkey % 300 + 0.5::DOUBLE AS ay, l_quantity, l_orderkey FROM lineitem),
    s AS (SELECT file_id, ax, ay, ax + (l_quantity % 21 - 10) * 0.7::DOUBLE AS bx, ay + (l_orderkey % 17 - 8) * 1.1::DOUBLE AS b_y FROM placed),
    r AS (SELECT *, unnest(generate_series(floor(least(ay, b_y))::BIGINT, floor(greatest(ay, b_y))::BIGINT)) AS y FROM s),
    e AS (SELECT *, ax + (greatest(least(ay, b_y), y::DOUBLE) - ay) * ((bx - ax) / nullif(b_y - ay, 0)) AS p, ax + (least(greatest(ay, b_y), y + 1::DOUBLE) - ay) * ((bx - ax) / nullif(b_y - ay, 0)) AS q FROM r),
    c AS (SELECT file_id, y, CASE WHEN ay = b_y THEN ax ELSE greatest(least(ax, bx), least(greatest(ax, bx), p)) END AS p, CASE WHEN ay = b_y THEN bx ELSE greatest(least(ax, bx), least(greatest(ax, bx), q)) END AS q FROM e),
    pixels AS (SELECT DISTINCT file_id, y, unnest(generate_series(floor(least(p, q))::BIGINT, floor(greatest(p, q))::BIGINT)) AS x FROM c)"""


def _placed_strokes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").selectExpr("concat('d', l_linenumber, l_returnflag) AS file_id", "l_partkey % 400 + l_linenumber * 0.125D AS ax", "l_suppkey % 300 + 0.5D AS ay", "l_quantity", "l_orderkey")
    return lines.selectExpr("file_id", "ax", "ay", "ax + (l_quantity % 21 - 10) * 0.7D AS bx", "ay + (l_orderkey % 17 - 8) * 1.1D AS by")


@query(
    "drawing_runs",
    f"""{_STROKES}, marked AS (SELECT *, lag(x) OVER (PARTITION BY file_id, y ORDER BY x) IS DISTINCT FROM x - 1 AS first FROM pixels)
    SELECT file_id, y, count(*) AS pixels, count(*) FILTER (first) AS runs, min(x) AS x0, max(x) AS x1 FROM marked GROUP BY ALL""",
)
def drawing_runs(spark: SparkSession, d: str) -> DataFrame:
    found = drawings.joined(drawings.runs(_placed_strokes(spark, d)))
    return found.groupBy("file_id", "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"), F.count("*").alias("runs"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(
    "drawing_thick_runs",
    f"""{_STROKES}, wide AS (SELECT DISTINCT file_id, y + b AS y, x + a AS x FROM pixels, range(3) AS t(a), range(3) AS u(b))
    SELECT file_id, count(*) AS pixels, count(DISTINCT y) AS rows, min(x) AS x0, max(x) AS x1 FROM wide GROUP BY file_id""",
)
def drawing_thick_runs(spark: SparkSession, d: str) -> DataFrame:
    found = drawings.joined(drawings.runs(_placed_strokes(spark, d)), 3)
    of_row = found.groupBy("file_id", "y").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return of_row.groupBy("file_id").agg(F.sum("pixels").alias("pixels"), F.count("*").alias("rows"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(
    "drawing_images",
    f"""{_STROKES}, seen AS (SELECT * FROM pixels WHERE x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 199)
    SELECT f.file_id AS file, 256 AS width, 200 AS height, count(x) AS black, coalesce(sum(x + 256 * y), 0)::BIGINT AS places FROM (SELECT DISTINCT file_id FROM s) f LEFT JOIN seen USING (file_id) GROUP BY ALL""",
)
def drawing_images(spark: SparkSession, d: str) -> DataFrame:
    """The images' black pixels, counted and placed, as read from the images."""
    placed = _placed_strokes(spark, d)
    sizes = placed.select("file_id", F.lit(256).alias("width"), F.lit(200).alias("height")).distinct()
    made = Written(drawings.images(drawings.joined(drawings.runs(placed)), sizes), "images").df
    black = raster.sites(made).groupBy("file").agg(F.count("*").alias("black"), F.sum(F.col("x").cast("long") + 256 * F.col("y").cast("long")).alias("places"))
    return made.select("file", "width", "height").join(black, "file", "left").fillna(0, ["black", "places"])


@query(
    "drawing_layer_reports",
    f"""SELECT p_brand AS file_id, '{drawings.REPORT_HEAD[0]}' || chr(10) || '{drawings.REPORT_HEAD[1]}{_AT}' || chr(10) || '{drawings.REPORT_HEAD[2]}' || p_brand || chr(10) || '{drawings.REPORT_HEAD[3]}' || count(*) || chr(10)
        || chr(10) || '{drawings.REPORT_HEAD[4].strip()}' || chr(10) || string_agg(p_name, chr(10) ORDER BY p_name) AS text FROM part GROUP BY p_brand""",
)
def drawing_layer_reports(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_brand").alias("file_id"), F.col("p_name").alias("decoded_name"))
    return drawings.layer_reports(names, _AT)


@query(
    "drawing_filter_logs",
    f"""WITH l AS (SELECT p_brand AS file_id, p_partkey || '-' || p_type AS layer, p_size % 4 = 1 AS kept, p_partkey FROM part),
    c AS (SELECT file_id, count(*) AS n FROM l JOIN lineitem ON l_partkey = p_partkey WHERE kept GROUP BY file_id)
    SELECT file_id, concat_ws(chr(10), '{drawings.LOG_HEAD[0]}', '{drawings.LOG_HEAD[1]}{_AT}', '{drawings.LOG_HEAD[2]}' || file_id, '{drawings.LOG_HEAD[3]}' || count(*), '{drawings.LOG_HEAD[4]}' || count(*) FILTER (kept),
        chr(10) || '{drawings.LOG_HEAD[5].strip()}', string_agg('- ' || layer, chr(10) ORDER BY layer) FILTER (kept), chr(10) || '{drawings.LOG_END[0].strip()} ' || coalesce(any_value(n), 0) || '{drawings.LOG_END[1]}', '{drawings.LOG_END[2]}' || file_id) AS text
    FROM l LEFT JOIN c USING (file_id) GROUP BY file_id""",
)
def drawing_filter_logs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_brand").alias("file_id"), F.concat_ws("-", "p_partkey", "p_type").alias("raw_name"), "p_partkey", "p_size")
    drawn = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").select("file_id", F.col("raw_name").alias("layer"))
    return drawings.filter_logs(parts, parts.where("p_size % 4 = 1"), drawn, _AT)
