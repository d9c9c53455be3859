"""Area-graph rooms: duplicates, small-room merging, passage end points, outlines, export.

``rooms`` has (map_id, room_id, ring); ``bridge`` has (map_id, passage_id, room_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.functions import kernels, rings
from floorwise.functions.tags import tag
from floorwise.operators.merge import ring_points
from floorwise.operators.spatial import within_distance
from floorwise.operators.statistics import bar
from floorwise.sources.osm_xml import Maps, elements_of


def without_duplicates(rooms: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One room of each set of equal rings, the one with the smallest id; passages move to it."""
    hashed = rooms.withColumn("_h", rings.signature(F.col("ring")))
    first = hashed.groupBy("map_id", "_h").agg(F.min_by(F.struct("room_id", "ring"), "room_id").alias("f"))
    same = rings.same_ring(F.col("ring"), F.col("f.ring"))
    targets = hashed.join(first, ["map_id", "_h"]).select("map_id", "room_id", F.when(same, F.col("f.room_id")).otherwise(F.col("room_id")).alias("kept"))
    return rooms.join(targets.where("room_id = kept").select("map_id", "room_id"), ["map_id", "room_id"], "left_semi"), moved(bridge, targets)


def moved(bridge: DataFrame, targets: DataFrame) -> DataFrame:
    """Passages at the rooms that theirs became; both ends in one room is no passage any more."""
    new = bridge.join(targets, ["map_id", "room_id"], "left").select("map_id", "passage_id", F.coalesce("kept", "room_id").alias("room_id")).distinct()
    ends = new.groupBy("map_id", "passage_id").agg(F.count("*").alias("n"))
    return new.join(ends.where("n > 1").select("map_id", "passage_id"), ["map_id", "passage_id"], "left_semi")


def neighbours(rooms: DataFrame, bridge: DataFrame, epsilon: float = rings.EPSILON) -> DataFrame:
    """(map_id, a, b) of rooms that share a passage or a vertex."""
    a, b = bridge.select("map_id", "passage_id", F.col("room_id").alias("a")), bridge.select("map_id", "passage_id", F.col("room_id").alias("b"))
    by_passage = a.join(b, ["map_id", "passage_id"]).where("a <> b").select("map_id", "a", "b")
    vertices = rooms.select("map_id", "room_id", F.explode("ring").alias("p")).select("map_id", "room_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    by_vertex = within_distance(vertices, vertices, "room_id", epsilon, ["map_id"]).where("a <> b").select("map_id", "a", "b")
    return by_passage.union(by_vertex).distinct()


def merge_small(rooms: DataFrame, bridge: DataFrame, min_area: float, most_distance: float) -> tuple[DataFrame, DataFrame]:
    """Rooms under ``min_area`` merged into a neighbour, smallest first, until none can be.

    A neighbour scores 10 times the share that its centre is nearer than ``most_distance``
    and 5 if it is itself under 1.5 times the least area. The order of merges within a map
    matters, so each map is one group; maps are independent.
    """
    links = neighbours(rooms, bridge).groupBy("map_id", F.col("a").alias("room_id")).agg(F.collect_set("b").alias("near"))
    rows = rooms.join(links, ["map_id", "room_id"], "left")
    id_type = dict(rooms.dtypes)["room_id"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shape = {r.room_id: [kernels.to_array(r.ring)] for r in group.itertuples()}
        near = {r.room_id: set(r.near if r.near is not None else ()) & set(group.room_id) for r in group.itertuples()}
        kept = {i: i for i in shape}
        whole = {i: s[0] for i, s in shape.items()}
        while True:
            small = sorted((i for i in whole if kernels.polygon_area(whole[i]) < min_area), key=lambda i: (kernels.polygon_area(whole[i]), i))
            step = None
            for i in small:
                centre = whole[i].mean(0)
                scored = []
                for j in sorted(near[i]):
                    away = float(((whole[j].mean(0) - centre) ** 2).sum() ** 0.5)
                    if away <= most_distance:
                        scored.append((10 * (most_distance - away) / most_distance + (5 if kernels.polygon_area(whole[j]) < 1.5 * min_area else 0), j))
                if scored:
                    step = (i, max(scored, key=lambda s: s[0])[1])
                    break
            if step is None:
                break
            i, j = step
            merged = kernels.largest(kernels.ring_union([whole[i], whole[j]]))
            whole[j] = merged if kernels.polygon_area(merged) > 0 else kernels.hull(pd.concat([pd.DataFrame(whole[i]), pd.DataFrame(whole[j])]).to_numpy())
            near[j] = (near[j] | near[i]) - {i, j}
            for k in near.pop(i) - {j}:
                near[k] = (near[k] - {i}) | {j}
            near[j].discard(i)
            del whole[i]
            kept = {k: (j if v == i else v) for k, v in kept.items()}
        return pd.DataFrame({"map_id": group.map_id.iloc[0], "room_id": list(kept), "kept": list(kept.values()), "ring": [kernels.to_ring(whole[k]) if v == k else None for k, v in kept.items()]})

    done = rows.groupBy("map_id").applyInPandas(run, f"map_id string, room_id {id_type}, kept {id_type}, ring array<struct<x:double,y:double>>")
    return done.where("ring is not null").select("map_id", "room_id", "ring"), moved(bridge, done.select("map_id", "room_id", "kept"))


def large_enough(rooms: DataFrame, bridge: DataFrame, min_area_m2: float, resolution: float) -> tuple[DataFrame, DataFrame]:
    """Rooms of at least an area in square metres, and the passages all of whose rooms stay."""
    kept = rooms.where(rings.area(F.col("ring")) >= min_area_m2 / resolution**2)
    known = kept.select("map_id", "room_id").withColumn("_in", F.lit(1))
    whole = bridge.join(known, ["map_id", "room_id"], "left").groupBy("map_id", "passage_id").agg(F.bool_and(F.col("_in").isNotNull()).alias("ok")).where("ok")
    return kept, bridge.join(whole.select("map_id", "passage_id"), ["map_id", "passage_id"], "left_semi")


def end_points(a: Column, b: Column, position: Column, line: Column, epsilon: float = 0.5) -> Column:
    """Two points where a passage ends, from its rooms' rings.

    Of the ten vertices of each ring nearest to the passage those of one ring that lie close
    to the other's are shared: two or more give the farthest pair, one gives itself and the
    farthest vertex of the second ring, none the nearest of each; a passage without rings
    takes its line's ends, and a single point is spread by 0.01.
    """
    near_a, near_b = rings.nearest_points(a, position), rings.nearest_points(b, position)
    shared = F.filter(near_a, lambda p: F.exists(near_b, lambda q: rings.distance(p, q) < epsilon))
    pair = rings.farthest_pair(shared)
    one = F.get(shared, F.lit(0))
    far = lambda from_: F.get(F.reverse(F.array_sort(F.transform(from_, lambda q: F.struct(rings.distance(one, q).alias("d"), q.alias("q"))))), F.lit(0))["q"]
    second = F.when(rings.distance(one, far(near_b)) < 0.01, far(near_a)).otherwise(far(near_b))
    shifted = lambda p, by: rings.point(p["x"] + by, p["y"])
    nearest = F.array(F.get(near_a, F.lit(0)), F.get(near_b, F.lit(0)))
    ends = F.when(F.size(shared) >= 2, F.array(pair["a"], pair["b"])).when(F.size(shared) == 1, F.array(one, second)).when((F.size(a) > 0) & (F.size(b) > 0), nearest).otherwise(F.array(F.element_at(line, 1), F.element_at(line, -1)))
    return F.when(rings.distance(ends[0], ends[1]) < 1e-9, F.array(shifted(ends[0], -0.01), shifted(ends[1], 0.01))).otherwise(ends)


def outlines(maps: Maps, method: str = "boundary", squared_radius: float = 1e-6) -> DataFrame:
    """(map_id, ring) of each building: the union of its rooms, their hull or alpha shape."""
    rooms = ring_points(maps.ways.where(tag("osmAG:areaType") == "room"), maps.nodes).where(F.size("ring") > 3)
    grouped = rooms.groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ring"))), lambda r: r["ring"]).alias("g"))
    outline = {"boundary": kernels.union_outline(F.col("g")), "convex_hull": kernels.hull_outline(F.col("g")), "alpha_shape": kernels.alpha_outline(F.col("g"), F.lit(squared_radius))}[method]
    return grouped.select("map_id", rings.counter_clockwise(outline).alias("ring"))


def with_outlines(maps: Maps, found: DataFrame) -> Maps:
    """Maps with a building outline: new nodes and a closed way that uses its first node twice."""
    low = maps.elements.groupBy("map_id").agg(F.least(F.lit(0), F.min(F.when(F.col("kind") == "node", F.col("id").try_cast("long")))).alias("n"), F.least(F.lit(0), F.min(F.when(F.col("kind") == "way", F.col("id").try_cast("long")))).alias("w"), F.max("ord").alias("o"))
    joined = found.where(F.size("ring") > 2).join(low, "map_id")
    node = lambda k: (F.col("n") - k - 1).cast("string")
    vertices = joined.select("map_id", "n", "o", F.posexplode("ring").alias("k", "p"))
    nodes = vertices.select("map_id", (F.col("o") + F.col("k") + 1).cast("int").alias("ord"), node(F.col("k")).alias("id"), F.format_string("%.12f", F.col("p.y")).alias("lat"), F.format_string("%.12f", F.col("p.x")).alias("lon"), F.lit("modify").alias("action"), F.lit("true").alias("visible"), F.create_map().cast("map<string,string>").alias("tags"))
    refs = F.transform(F.concat(F.sequence(F.lit(0), F.size("ring") - 1), F.array(F.lit(0))), node)
    tags = F.create_map(*map(F.lit, ("building", "Architecture", "osmAG:type", "building_outline")))
    ways = joined.select("map_id", (F.col("o") + F.size("ring") + 1).cast("int").alias("ord"), (F.col("w") - 1).cast("string").alias("id"), F.lit("modify").alias("action"), F.lit("true").alias("visible"), refs.alias("nds"), tags.alias("tags"))
    return Maps(elements_of(maps.nodes.unionByName(nodes, allowMissingColumns=True), maps.ways.unionByName(ways, allowMissingColumns=True), maps.documents, maps.relations))


def area_report(rooms: DataFrame, resolution: float) -> DataFrame:
    """Rooms by area in square metres, the largest first in each map, with a bar for each."""
    sized = rooms.select("map_id", F.concat(F.lit("room_"), "room_id").alias("room"), F.round(rings.area(F.col("ring")) * resolution**2, 2).alias("area_m2"))
    most = F.max("area_m2").over(Window.partitionBy("map_id"))
    return sized.withColumn("bar", bar(F.col("area_m2"), most)).orderBy("map_id", F.desc("area_m2"), "room")


def vertex_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """By how many percent simplification cut each map's vertices."""
    count = lambda df, name: df.groupBy("map_id").agg(F.sum(F.size("ring")).alias(name))
    return count(before, "before").join(count(after, "after"), "map_id").withColumn("reduction_percent", F.round((1 - F.col("after") / F.col("before")) * 100, 2))


def export(rooms: DataFrame, bridge_ends: DataFrame, root_lat: float, root_lon: float, resolution: float, origin: tuple[float, float], level: int = 1, height_per_level: float = 3.2, decimals: int = 11) -> Maps:
    """Rooms and passages (map_id, passage_id, a, b, ends) in pixels as area-graph maps.

    Equal points become one node; ids count down over nodes and ways; a root node anchors
    the frame. Passages are named by their rooms and lie at the level's height.
    """
    from floorwise.functions.projection import pixel_to_metres, to_wgs84

    shapes = rooms.select("map_id", F.lit(0).alias("k"), F.col("room_id").cast("string").alias("key"), rings.closed(F.col("ring")).alias("ring"), F.concat(F.lit("room_"), "room_id").alias("name"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    lines = bridge_ends.select("map_id", F.lit(1).alias("k"), F.col("passage_id").cast("string").alias("key"), F.col("ends").alias("ring"), F.concat(F.lit("room_"), "a", F.lit("_to_room_"), "b").alias("name"), F.concat(F.lit("room_"), "a").alias("a"), F.concat(F.lit("room_"), "b").alias("b"))
    ways = shapes.unionByName(lines).where("ring is not null").withColumn("n", F.row_number().over(Window.partitionBy("map_id").orderBy("k", "key")))
    points = ways.select("map_id", "n", F.posexplode("ring").alias("pos", "p")).withColumns({"qx": F.round("p.x", 6), "qy": F.round("p.y", 6)})
    first = points.groupBy("map_id", "qx", "qy").agg(F.min(F.struct("n", "pos")).alias("f"))
    numbered = first.withColumn("id", (-1 - F.row_number().over(Window.partitionBy("map_id").orderBy("f"))).cast("string"))
    metres = numbered.withColumn("m", pixel_to_metres(F.col("qx"), F.col("qy"), origin[0], origin[1], resolution)).withColumn("w", to_wgs84(F.lit(root_lat), F.lit(root_lon), F.col("m.x"), F.col("m.y")))
    blank = F.create_map().cast("map<string,string>")
    state = [F.lit("modify").alias("action"), F.lit("true").alias("visible")]
    fixed = f"%.{decimals}f"
    nodes = metres.select("map_id", (1 - F.col("id").cast("int")).alias("ord"), "id", F.format_string(fixed, "w.lat").alias("lat"), F.format_string(fixed, "w.lon").alias("lon"), *state, blank.alias("tags"))
    roots = ways.select("map_id").distinct().select("map_id", F.lit(1).alias("ord"), F.lit("-1").alias("id"), F.format_string(fixed, F.lit(root_lat)).alias("lat"), F.format_string(fixed, F.lit(root_lon)).alias("lon"), *state, F.create_map(F.lit("name"), F.lit("root")).alias("tags"))
    refs = points.join(numbered.select("map_id", "qx", "qy", "id"), ["map_id", "qx", "qy"]).groupBy("map_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("nds"))
    last = numbered.groupBy("map_id").agg(F.count("*").alias("nodes"))
    values = {"name": F.col("name"), "level": F.lit(str(level)), "height": F.format_string("%.2f", F.lit(height_per_level * level)), "osmAG:type": F.when(F.col("k") == 0, "area").otherwise("passage"), "osmAG:areaType": F.when(F.col("k") == 0, "room"), "indoor": F.when(F.col("k") == 0, "room").otherwise("door"), "osmAG:from": F.col("a"), "osmAG:to": F.col("b")}
    tags = F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    out = ways.join(refs, ["map_id", "n"]).join(last, "map_id").select("map_id", (F.col("nodes") + 2 + F.col("n")).cast("int").alias("ord"), (-1 - F.col("nodes") - F.col("n")).cast("string").alias("id"), *state, "nds", tags.alias("tags"))
    documents = ways.select("map_id").distinct().withColumns({"root_tag": F.lit("osm"), "version": F.lit("0.6"), "generator": F.lit("floorwise")})
    return Maps(elements_of(nodes.unionByName(roots), out, documents))
