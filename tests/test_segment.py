from floorwise.operators import segment
from floorwise.sources import projects

WALLS = [(0, 0, 60, 0), (60, 0, 60, 30), (60, 30, 0, 30), (0, 30, 0, 0), (30, 0, 30, 11), (30, 19, 30, 30)]


def test_two_rooms_and_a_door(spark):
    points = [("m", float(x), float(y)) for x, y in segment.grid_sites(WALLS, 2.0)]
    df = spark.createDataFrame(points, "map_id string, x double, y double")
    pieces, shapes, bridge = segment.segment(df, clear_of_walls=2.0, alpha=400.0, dead_ends=(3.0,))
    assert pieces.count() > 0 and shapes.count() >= 1 and pieces.where("room_id is not null").count() > 0
    assert bridge.columns == ["map_id", "passage_id", "room_id"]
    hull = segment.largest_polygon(segment.alpha_polygons(df, 1e6))
    from pyspark.sql import functions as F

    from floorwise.functions import rings

    assert round(hull.select(rings.area(F.col("ring"))).first()[0]) == 1800
    table = df.union(spark.createDataFrame([("m", 10.0 + x, 10.0 + y) for x in range(3) for y in range(3)], df.schema))
    assert segment.without_furniture(table, 4.0, 20.0).count() <= df.count() + 1
    near = segment.nearest_edges(spark.createDataFrame([("m", 1, (15.0, 15.0))], "map_id string, point_id int, p struct<x:double,y:double>"), pieces, 30.0)
    assert near.count() == 1


def test_projects(spark):
    table = projects.created(projects.created(projects.empty(spark), "a", "/a"), "a", "/b")
    assert [(r.name, r.path) for r in table.collect()] == [("a", "/a")]
    assert projects.with_status(table, "a", "dxf", "done").first().status == {"dxf": "done"}


def test_an_area_graph_keeps_its_faces(spark):
    from pyspark.sql import functions as F

    from floorwise.functions import rings
    from floorwise.operators import halfedges

    points = [("m", float(x), float(y)) for x, y in segment.grid_sites(WALLS, 2.0)] + [("n", float(x) + 5, float(y)) for x, y in segment.grid_sites(WALLS, 2.0)]
    found = segment.area_graph(spark.createDataFrame(points, "map_id string, x double, y double"), clear_of_walls=2.0, alpha=400.0, dead_ends=(3.0,), short_dead_end=3.0, room_alpha=20.0)
    assert halfedges.inconsistencies(found.halves).count() == 0
    rows = found.halves.where("half_id < twin").select("map_id", "room_id", rings.length(F.col("path")).alias("l")).collect()
    assert {r.map_id for r in rows} == {"m", "n"} and sum(r.room_id is not None for r in rows) >= 2
    lengths = {m: round(sum(r.l for r in rows if r.map_id == m), 3) for m in "mn"}
    assert lengths["m"] == lengths["n"] > 30  # a shifted map has the same graph
    assert found.rooms.where("area > 0").count() >= 4
    crossing = {m: [r.crossing for r in found.rounds.where(F.col("map_id") == m).orderBy("round").collect()] for m in "mn"}
    assert 1 < len(crossing["m"]) < 8 and crossing["m"][-1] < crossing["m"][0]  # it ends, though rooms' boundaries lie along the paths
    joints = found.joints.where("map_id = 'm'").collect()
    assert joints and all(r.a < r.b and r.length >= 0 for r in joints)
