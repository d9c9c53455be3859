"""From obstacle pixels to an area graph: furniture, walls, Voronoi graph, rooms, passages.

Stages before the rooms take one image as a group (triangulation); everything after is
relational over all images and parameter settings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorwise.functions import kernels, rings
from floorwise.operators import graph, halfedges, rooms
from floorwise.operators.spatial import points_by_rings
from floorwise.sources.osm_xml import Maps
from floorwise.sources.scratch import Written

RING = "array<struct<x:double,y:double>>"
#: Thresholds of the clean-up: dead ends shorter than these go, one after the other.
DEAD_ENDS = (5.0, 10.0, 20.0, 40.0)


def alpha_polygons(points: DataFrame, squared_radius: float) -> DataFrame:
    """(map_id, polygon_id, ring) of the alpha shape of each map's points (map_id, x, y)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = kernels.alpha_rings(group[["x", "y"]].to_numpy(dtype=float), squared_radius)
        return pd.DataFrame({"map_id": group.map_id.iloc[0], "polygon_id": range(len(found)), "ring": [kernels.to_ring(r) for r in found]})

    return points.select("map_id", "x", "y").groupBy("map_id").applyInPandas(run, f"map_id string, polygon_id long, ring {RING}")


def outermost(polygons: DataFrame) -> DataFrame:
    """Polygons that do not begin inside another one of their map."""
    size = polygons.select(F.avg(F.sqrt(rings.area(F.col("ring"))))).first()[0] or 1.0
    starts = polygons.select("map_id", F.col("polygon_id").alias("inner"), F.element_at("ring", 1).alias("p"))
    nested = points_by_rings(starts, polygons, 0.0, max(size, 1e-9), ["map_id"]).where((F.col("inner") != F.col("polygon_id")) & rings.contains(F.col("ring"), F.col("p")))
    return polygons.join(nested.select("map_id", F.col("inner").alias("polygon_id")).distinct(), ["map_id", "polygon_id"], "left_anti")


def largest_polygon(polygons: DataFrame, by_perimeter: bool = False) -> DataFrame:
    measure = rings.perimeter(F.col("ring")) if by_perimeter else rings.area(F.col("ring"))
    return polygons.groupBy("map_id").agg(F.max_by("ring", measure).alias("ring"))


def without_furniture(points: DataFrame, squared_radius: float, most_perimeter: float = 80.0) -> DataFrame:
    """Points that lie in no alpha polygon whose perimeter is at most ``most_perimeter``."""
    small = alpha_polygons(points, squared_radius).where(rings.perimeter(F.col("ring")) <= most_perimeter)
    placed = points.withColumn("p", rings.point(F.col("x"), F.col("y")))
    touching = points_by_rings(placed, small, 0.5, most_perimeter / 2, ["map_id"]).where(rings.polygon_distance(F.col("p"), F.col("ring")) < 1e-9)
    return points.join(touching.select("map_id", "x", "y").distinct(), ["map_id", "x", "y"], "left_anti")


def cleaned(edges: DataFrame, dead_ends: tuple[float, ...] = DEAD_ENDS) -> DataFrame:
    """The graph's largest component without loops, rays and short dead ends, chains joined.

    A dead end is measured as a whole chain, so chains are joined before the first removal and
    again after each. The first two removals come before the largest component is chosen.
    """

    def joined(df: DataFrame) -> DataFrame:
        return Written(graph.joined_chains(df).drop("edges"), "graph").df

    now = joined(graph.without_rays(graph.without_loops(edges)).select("map_id", "edge_id", "a", "b", "length", "path"))
    for shorter_than in dead_ends[:2]:
        now = joined(graph.without_dead_ends(now, shorter_than))
    now = graph.largest_component(now)
    for shorter_than in dead_ends[2:]:
        now = joined(graph.without_dead_ends(now, shorter_than))
    return now


def segment(points: DataFrame, clear_of_walls: float = 3.0, alpha: float = 3600.0, dead_ends: tuple[float, ...] = DEAD_ENDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph pieces, rooms and the bridge of passages to rooms of obstacle points (map_id, x, y).

    Rooms are the alpha polygons of the graph's vertices that stay clear of walls; edges
    are cut where they cross rooms, and pieces of one room become that room.
    """
    edges = graph.voronoi(points).withColumn("edge_id", F.concat_ws("-", "a", "b"))
    boundary = largest_polygon(alpha_polygons(points, alpha))
    clear = Written(graph.clipped(graph.away_from_obstacles(edges, clear_of_walls), boundary), "clear").df
    kept = Written(cleaned(clear, dead_ends), "kept").df
    vertices = kept.select("map_id", F.explode("path").alias("p")).select("map_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    shapes = Written(outermost(Written(alpha_polygons(vertices, alpha), "alpha").df), "shapes").df.withColumnRenamed("polygon_id", "room_id")
    pieces = Written(graph.cut_by_rooms(kept, shapes.select("map_id", "room_id", "ring")), "pieces").df
    at = lambda i: F.concat_ws(",", F.format_string("%.3f", F.element_at("path", i)["x"]), F.format_string("%.3f", F.element_at("path", i)["y"]))
    pieces = pieces.withColumns({"a": at(1), "b": at(-1)})
    _, bridge = graph.area_graph(pieces)
    return pieces, shapes.select("map_id", "room_id", "ring"), bridge


@dataclass
class AreaGraph:
    """Half edges with their faces and rooms, the rooms' shapes, rooms as vertices, the edges between them, and what was cut when."""

    halves: DataFrame
    shapes: DataFrame
    rooms: DataFrame
    joints: DataFrame
    rounds: DataFrame


def area_graph(points: DataFrame, clear_of_walls: float = 3.0, alpha: float = 3600.0, dead_ends: tuple[float, ...] = DEAD_ENDS, short_dead_end: float = 20.0, cuts_in_round: int | None = 1, room_alpha: float | None = None) -> AreaGraph:
    """The area graph of obstacle points (map_id, x, y) by half edges that keep their faces.

    Voronoi edges clear of walls and inside the largest alpha polygon become paths; dead ends leave their
    polygons to their neighbours; the largest component is cut at the rooms' boundaries until nothing crosses any more;
    dead ends are merged in their rooms, and rooms become the vertices of a graph. Rooms are the alpha polygons of
    the graph's own points, by ``room_alpha`` if it is another one.
    """
    landed = lambda df, name: Written(df, name).df
    clear = halfedges.without_loops(halfedges.voronoi(points)).where(F.col("obstacle") > clear_of_walls).drop("obstacle")
    boundary = landed(largest_polygon(alpha_polygons(points, alpha)), "boundary")
    now = landed(halfedges.without_rays(halfedges.clipped(clear, boundary)), "clear")
    paths = lambda df: landed(halfedges.joined(df, df.select("map_id", F.col("source").alias("node"))), "paths")
    now = paths(now)
    for shorter_than in dead_ends:
        now = paths(landed(halfedges.without_dead_ends(now, shorter_than).drop("next"), "cleaned"))
    edges = now.where("half_id < twin").select("map_id", "edge_id", F.col("source").alias("a"), F.col("target").alias("b"), rings.length(F.col("path")).alias("length"))
    now = landed(now.join(graph.largest_component(edges).select("map_id", "edge_id"), ["map_id", "edge_id"], "left_semi"), "largest")
    vertices = now.select("map_id", F.explode("path").alias("p")).select("map_id", F.col("p.x").alias("x"), F.col("p.y").alias("y")).distinct()
    shapes = landed(outermost(landed(alpha_polygons(vertices, alpha if room_alpha is None else room_alpha), "alpha")), "shapes").withColumnRenamed("polygon_id", "room_id").select("map_id", "room_id", "ring")
    cut, rounds = halfedges.rooms_cut(now, shapes, cuts_in_round, short_dead_end)
    merged = landed(halfedges.merged_dead_ends(halfedges.in_rooms(cut, shapes)), "merged")
    found, joints = halfedges.quotient(merged)
    return AreaGraph(halfedges.linked(merged), shapes, found, joints, rounds)


def star_rooms(pieces: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each room as a star: edges from its centre to the vertices where its passages are."""
    centres = shapes.select("map_id", "room_id", rings.centroid(F.col("ring")).alias("centre"))
    doors = graph.passage_vertices(pieces).select("map_id", "node")
    ends = pieces.where("room_id is not null").select("map_id", "room_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.element_at("path", 1).alias("p")), F.struct(F.col("b").alias("node"), F.element_at("path", -1).alias("p")))).alias("e")).select("map_id", "room_id", "e.*").dropDuplicates(["map_id", "room_id", "node"])
    return ends.join(doors, ["map_id", "node"]).join(centres, ["map_id", "room_id"]).select("map_id", "room_id", "node", F.array("centre", "p").alias("path"), rings.distance(F.col("centre"), F.col("p")).alias("length"))


def nearest_edges(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(map_id, point_id, edge_id, distance) of the nearest edge within ``reach`` of each point (map_id, point_id, p)."""
    legs = edges.select("map_id", "edge_id", F.col("path").alias("ring"))
    near = points_by_rings(points, legs, reach, 4 * reach, ["map_id"])
    away = F.array_min(F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring")), lambda a, b: rings.segment_distance(F.col("p"), a, b)))
    return near.withColumn("distance", away).where(F.col("distance") <= reach).groupBy("map_id", "point_id").agg(F.min(F.struct("distance", "edge_id")).alias("m")).select("map_id", "point_id", "m.edge_id", "m.distance")


def to_maps(pieces: DataFrame, shapes: DataFrame, bridge: DataFrame, resolution: float, root: tuple[float, float], origin: tuple[float, float], min_area_m2: float = 10.0, tolerance: float = 1.3, spike_angle: float = 15.0, spike_distance: float = 0.3) -> Maps:
    """Rooms cleaned, merged, filtered and simplified, and exported with their passages."""
    kept, moved = rooms.without_duplicates(shapes, bridge)
    kept, moved = (Written(df, "rooms").df for df in (kept, moved))
    kept, moved = rooms.merge_small(kept, moved, min_area_m2 / resolution**2, 3.0 / resolution)
    kept, moved = (Written(df, "rooms").df for df in (kept, moved))
    kept, moved = rooms.large_enough(kept, moved, min_area_m2, resolution)
    position = pieces.select("map_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.element_at("path", 1).alias("p")), F.struct(F.col("b").alias("node"), F.element_at("path", -1).alias("p")))).alias("e")).select("map_id", F.col("e.node").alias("passage_id"), F.col("e.p").alias("p")).dropDuplicates(["map_id", "passage_id"])
    of = lambda side, pick: moved.groupBy("map_id", "passage_id").agg(pick("room_id").alias("room_id")).join(kept, ["map_id", "room_id"]).select("map_id", "passage_id", F.col("room_id").alias(side), F.col("ring").alias(f"ring_{side}"))
    pairs = of("a", F.min).join(of("b", F.max), ["map_id", "passage_id"]).where("a <> b").join(position, ["map_id", "passage_id"])
    pairs = Written(pairs.select("map_id", "passage_id", "a", "b", rooms.end_points(F.col("ring_a"), F.col("ring_b"), F.col("p"), F.array("p", "p")).alias("ends")), "passages").df
    ends = pairs.select("map_id", F.explode(F.array("a", "b")).alias("room_id"), "ends").groupBy("map_id", "room_id").agg(F.collect_list("ends").alias("lines"))
    snapped = kept.join(ends, ["map_id", "room_id"], "left").withColumn("ring", kernels.snap_passages(F.col("ring"), F.col("lines")))
    held = F.coalesce(F.flatten("lines"), F.array().cast(RING))
    simple = snapped.withColumn("held", held).withColumn("ring", kernels.simplify(F.col("ring"), F.lit(tolerance), F.col("held")))
    simple = simple.withColumn("ring", kernels.without_spikes(F.col("ring"), F.lit(spike_angle), F.lit(spike_distance), F.col("held"))).select("map_id", "room_id", "ring")
    return rooms.export(Written(simple, "rooms").df, pairs, *root, resolution, origin)


def grid_sites(walls: list[tuple[float, float, float, float]], step: float) -> np.ndarray:
    """Points along wall segments, for examples and tests."""
    out = []
    for x0, y0, x1, y1 in walls:
        n = max(1, int(np.hypot(x1 - x0, y1 - y0) / step))
        out += [(x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n) for k in range(n + 1)]
    return np.unique(np.round(out, 6), axis=0)
