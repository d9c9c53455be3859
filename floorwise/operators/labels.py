"""Labelling rooms with drawing text: extraction, coordinates, matching, renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.functions import kernels, projection, rings
from floorwise.functions.scalars import without_subsumed
from floorwise.functions.tags import tag, upserted
from floorwise.operators.merge import ring_points
from floorwise.operators.spatial import points_by_rings
from floorwise.sources.osm_xml import Maps

#: A text that contains one of these is no room label.
BLACKLIST = ["特级防火卷帘", "防火卷帘", "暖水", "残疾人出入口", "特级", "防火", "送风", "排风", "挡烟垂壁", "上", "下", "自动玻璃门", "入口", "排烟井", "弱电间", "储藏室", "强电间", "水井", "电梯厅"]
NEARBY, CENTRE_RATIO, GOOD_SCORE = 50.0, 0.7, 70.0


def extracted_texts(entities: DataFrame, layer: str, exact: bool = False) -> DataFrame:
    """Texts of a layer: block attributes and text entities, trimmed, without blacklisted ones."""
    texts = entities.where(F.col("etype").isin("ATTRIB", "TEXT", "MTEXT") & (F.col("layer") == layer)).withColumn("text", F.trim("text")).where("text <> ''")
    words = F.array(*map(F.lit, BLACKLIST))
    dropped = F.array_contains(words, F.col("text")) if exact else F.exists(words, lambda w: F.contains(F.col("text"), w))
    attribute = F.col("etype") == "ATTRIB"
    return texts.where(~dropped).select("file_id", F.col("eid").alias("ord"), "text", F.col("pts")[0].alias("insert_point"), F.when(attribute, F.col("block_name")).alias("block_name"), F.when(attribute, F.col("tag")).alias("attribute_tag"), F.when(~attribute, F.col("etype")).alias("entity_type"))


def pixel_texts(texts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Texts with their place in the image of their file; ``bounds`` has a row for each file."""
    joined = texts.join(bounds.select("file_id", F.struct(*(c for c in bounds.columns if c != "file_id")).alias("_b")), "file_id")
    return joined.withColumn("pixel_point", projection.drawing_to_pixel(F.col("insert_point.x"), F.col("insert_point.y"), F.col("_b"))).drop("_b")


def room_polygons(maps: Maps, padding: float = 0.03, size: int = 4000) -> DataFrame:
    """Rooms with rings in pixels and in degrees, in one image frame for each map.

    The frame takes the bounds of all rooms in metres around the map's root node (else its
    first node), grown by ``padding``.
    """
    is_room = (tag("indoor") == "room") & (tag("osmAG:areaType") != "structure")
    rooms = ring_points(maps.ways.where(is_room), maps.nodes, "latlon").where(F.size("latlon") > 0)
    order = F.struct(tag("name") != "root", "ord")
    root = maps.nodes.groupBy("map_id").agg(F.min_by(F.struct(F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")), order).alias("root"))
    placed = rooms.join(root, "map_id").withColumn("metres", F.transform("latlon", lambda p: projection.to_metres(F.col("root.lat"), F.col("root.lon"), p["y"], p["x"])))
    boxed = placed.withColumn("b", rings.bounds(F.col("metres")))
    frame = boxed.groupBy("map_id").agg(F.min("b.min_x").alias("x0"), F.min("b.min_y").alias("y0"), F.max("b.max_x").alias("x1"), F.max("b.max_y").alias("y1"))
    frame = frame.select("map_id", projection.padded_bounds(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), padding, size).alias("boundary"))
    joined = boxed.join(frame, "map_id")
    pixels = F.transform("metres", lambda p: projection.drawing_to_pixel(p["x"], p["y"], F.col("boundary")))
    return joined.select("map_id", "ord", "id", tag("name").alias("name"), tag("osmAG:areaType").alias("type"), pixels.alias("ring"), "latlon", "boundary")


def matches(texts: DataFrame, rooms: DataFrame, nearby: float = NEARBY, centre_ratio: float = CENTRE_RATIO) -> DataFrame:
    """The best room of each text (map_id, ord, text, p) among those that hold it or lie near.

    Inside, the score falls with the distance from the room's inscribed-circle centre in
    units of the radius of a circle of its area; outside, with the distance to the
    boundary, and small rooms score higher. Of equal scores the first room wins.
    """
    shaped = rooms.withColumn("ring", rings.closed(F.col("ring"))).where("ring is not null")
    shaped = shaped.withColumns({"area": rings.area(F.col("ring")), "centre": kernels.inscribed_centre(F.col("ring"))}).select("map_id", F.col("ord").alias("room_ord"), F.col("id").alias("room_id"), "ring", "area", "centre")
    pairs = points_by_rings(texts, shaped, nearby, 2 * nearby, ["map_id"])
    met = pairs.withColumns({"_met": kernels.against_ring("ring", "p"), "center_distance": rings.distance(F.col("p"), F.col("centre"))}).drop("ring", "centre")
    measured = met.withColumn("inside", F.col("_met.odd") & (F.col("_met.away") > 1e-12))
    measured = measured.withColumn("distance", F.when(F.col("inside"), 0.0).otherwise(F.col("_met.away"))).where(F.col("distance") <= nearby)
    ratio = F.col("center_distance") / F.sqrt(F.col("area") / 3.141592653589793)
    of_inside = F.when(ratio <= centre_ratio, 100 - 50 * ratio).otherwise(50 - 25 * (ratio - centre_ratio))
    size = 1 / (1 + F.log10(1 + F.col("area") / 10000))
    of_near = 40 + 30 * size + 20 * (1 - F.col("distance") / nearby)
    scored = measured.withColumns({"score": F.when(F.col("inside"), of_inside).otherwise(of_near), "match_type": F.when(F.col("inside"), "inside").otherwise("nearby"), "distance_ratio": F.when(F.col("inside"), ratio)})
    best = Window.partitionBy("map_id", "ord").orderBy(F.desc("score"), "room_ord")
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("map_id", "ord", "text", F.col("p").alias("pixel_point"), "room_id", "match_type", "score", "center_distance", "distance_ratio", F.when(~F.col("inside"), F.col("distance")).alias("distance"))


def unmatched(texts: DataFrame, matched: DataFrame) -> DataFrame:
    return texts.join(matched, ["map_id", "ord"], "left_anti").withColumn("reason", F.lit("no room holds it or lies near"))


def match_statistics(texts: DataFrame, matched: DataFrame) -> DataFrame:
    total = texts.groupBy("map_id").agg(F.count("*").alias("total"))
    found = matched.groupBy("map_id").agg(F.count("*").alias("matched"), F.count_if(F.col("score") >= GOOD_SCORE).alias("high_quality"))
    joined = total.join(found, "map_id", "left").na.fill(0, ["matched", "high_quality"])
    return joined.withColumns({"unmatched": F.col("total") - F.col("matched"), "match_rate": F.col("matched") / F.col("total")})


def new_names(matched: DataFrame, first_only: bool = False) -> DataFrame:
    """A name for each matched room: its inside texts by score, or else the best nearby one."""
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("match_type") == kind, F.struct((-F.col("score")).alias("s"), "ord", "text")))), lambda x: x["text"])
    rooms = matched.groupBy("map_id", "room_id").agg(ordered("inside").alias("inside"), ordered("nearby").alias("nearby"))
    several = without_subsumed(F.array_distinct(F.col("inside")))
    name = F.when(F.size("inside") > 0, F.get("inside", F.lit(0)) if first_only else several).otherwise(F.get("nearby", F.lit(0)))
    return rooms.select("map_id", F.col("room_id").alias("id"), name.alias("new_name")).where("new_name <> ''")


def renamed(ways: DataFrame, names: DataFrame) -> DataFrame:
    """Rooms with their new names, and passages whose ends had the old names (``room_<id>`` for
    an unnamed room). Of several changes of one old name the last in document order counts."""
    joined = ways.join(names, ["map_id", "id"], "left")
    is_room = (tag("osmAG:type") == "area") & (tag("osmAG:areaType") != "structure")
    old = F.when(tag("name") != "", tag("name")).otherwise(F.concat(F.lit("room_"), "id"))
    changes = joined.where(is_room & F.col("new_name").isNotNull()).groupBy("map_id", old.alias("old")).agg(F.max_by("new_name", "ord").alias("new"))
    out = joined.withColumn("tags", F.when(is_room & F.col("new_name").isNotNull(), upserted(F.col("tags"), {"name": F.col("new_name")})).otherwise(F.col("tags"))).drop("new_name")
    passage = tag("osmAG:type") == "passage"
    for end in ("osmAG:from", "osmAG:to"):
        to = changes.select("map_id", F.col("old").alias("_old"), F.col("new").alias("_new"))
        out = out.withColumn("_old", F.when(passage, tag(end))).join(to, ["map_id", "_old"], "left")
        out = out.withColumn("tags", F.when(F.col("_new").isNotNull(), upserted(F.col("tags"), {end: F.col("_new")})).otherwise(F.col("tags"))).drop("_old", "_new")
    return out.select(ways.columns)


def mapping_json(matched: DataFrame, texts: DataFrame) -> DataFrame:
    """(map_id, json): matches by room, unmatched texts and statistics."""
    rows = matched.groupBy("map_id", "room_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "pixel_point", "match_type", "score", "center_distance"))).alias("m"))
    by_map = rows.groupBy("map_id").agg(F.map_from_entries(F.collect_list(F.struct("room_id", "m"))).alias("matches"))
    rest = unmatched(texts, matched).groupBy("map_id").agg(F.collect_list(F.struct("text", F.col("p").alias("pixel_point"), "reason")).alias("unmatched_texts"))
    stats = match_statistics(texts, matched)
    joined = stats.join(by_map, "map_id", "left").join(rest, "map_id", "left")
    return joined.select("map_id", F.to_json(F.struct("matches", F.col("unmatched_texts").alias("unmatched"), F.struct(*(c for c in stats.columns if c != "map_id")).alias("match_statistics"))).alias("json"))
