import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floorwise.functions import kernels, projection, rings, scalars
from floorwise.operators import graph, ids, layers, raster, rooms, segment, spatial, statistics, sweep
from floorwise.sources import dxf

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
ROUND = [(10 * math.cos(2 * math.pi * k / 24), 10 * math.sin(2 * math.pi * k / 24)) for k in range(24)]


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def frame(spark, **shapes):
    return spark.createDataFrame([(k, ring(v)) for k, v in shapes.items()], "name string, ring array<struct<x:double,y:double>>")


def test_ring_folds(spark):
    df = frame(spark, square=SQUARE, turned=SQUARE[::-1], l=L_SHAPE, round=ROUND, empty=[])
    r = F.col("ring")
    got = {x.name: x for x in df.select("name", rings.signed_area(r).alias("a"), rings.perimeter(r).alias("p"), rings.centroid(r).alias("c"), rings.is_circular(r).alias("o"), rings.signature(r).alias("s"), rings.contains(r, rings.point(F.lit(1.0), F.lit(1.0))).alias("i"), rings.contains(r, rings.point(F.lit(4.0), F.lit(1.0))).alias("edge"), rings.polygon_distance(rings.point(F.lit(6.0), F.lit(1.0)), r).alias("d")).collect()}
    assert (got["square"].a, got["turned"].a, got["l"].a) == (16, -16, 12)
    assert got["square"].p == 16 and tuple(got["square"].c) == (2, 2)
    assert got["l"].c.x == pytest.approx(5 / 3) and got["round"].o and not got["square"].o
    assert got["square"].s == got["turned"].s and got["square"].s != got["l"].s
    assert got["square"].i and not got["square"].edge and got["square"].d == 2
    path = df.where("name = 'square'").select(rings.point_at(r, F.lit(6.0)).alias("p"), rings.length(r).alias("n"), rings.closed(r).alias("c"), rings.nearest_points(r, rings.point(F.lit(5.0), F.lit(0.5)), 2).alias("k"), rings.farthest_pair(r)["d"].alias("w")).first()
    assert tuple(path.p) == (4, 2) and path.n == 12 and len(path.c) == 5 and [tuple(p) for p in path.k] == [(4, 0), (4, 4)] and path.w == pytest.approx(math.sqrt(32))


def test_projection_goes_there_and_back(spark):
    df = spark.createDataFrame([(31.0 + k * 0.001, 121.0 - k * 0.002) for k in range(-5, 6)], "lat double, lon double")
    m = projection.to_metres(F.lit(31.0), F.lit(121.0), F.col("lat"), F.col("lon"))
    back = df.withColumn("m", m).withColumn("w", projection.to_wgs84(F.lit(31.0), F.lit(121.0), F.col("m.x"), F.col("m.y"))).collect()
    for r in back:
        assert r.w.lat == pytest.approx(r.lat, abs=1e-9) and r.w.lon == pytest.approx(r.lon, abs=1e-9)
        assert r.m.y == pytest.approx((r.lat - 31) * 110_870, rel=2e-3, abs=2) and r.m.x == pytest.approx((r.lon - 121) * 95_490, rel=2e-3, abs=2)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=25, unique=True))
def test_hull_and_triangles(points):
    p = np.array(points, dtype=float)
    h = kernels.hull(p)
    if len(h) < 3 or kernels.polygon_area(h) == 0:
        return
    t = kernels.delaunay(p)
    centre, radius = kernels.circumcentres(p, t)
    assert (np.hypot(*(p[None] - centre[:, None]).transpose(2, 0, 1)) >= radius[:, None] * (1 - 1e-9)).all()
    areas = np.abs(np.cross(np.c_[p[t[:, 1]] - p[t[:, 0]], np.zeros(len(t))], np.c_[p[t[:, 2]] - p[t[:, 0]], np.zeros(len(t))])[:, 2]) / 2
    assert areas.sum() == pytest.approx(kernels.polygon_area(h), rel=1e-9)


def test_kernels():
    a, b = np.array(SQUARE, float), np.array([(4, 0), (8, 0), (8, 4), (4, 4)], float)
    u = kernels.ring_union([a, b])
    assert len(u) == 1 and kernels.polygon_area(u[0]) == 32
    assert kernels.polygon_area(kernels.largest(kernels.alpha_rings(np.vstack([a, b, [(2, 2), (6, 2)]]), 100.0))) == 32
    x, y = kernels.inscribed(np.array([(0, 0), (100, 0), (100, 100), (0, 100)], float))
    assert (x, y) == (50, 50)
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 3), (4, 0)], float)
    keep = np.zeros(5, bool)
    assert kernels.simplified(line, 0.5, keep).tolist() == [True, False, True, True, True]
    keep[1] = True
    assert kernels.simplified(line, 0.5, keep)[1]
    assert kernels.cut_distances(np.array([(-2, 2), (6, 2)], float), a) == pytest.approx([2, 6], abs=1e-3)
    assert kernels.polygon_area(kernels.snapped(a, np.array([4.0, 1]), np.array([4.0, 3]))) == 16
    spiky = np.array([(0, 0), (4, 0), (4.05, 9), (4.1, 0), (8, 0), (8, 4), (0, 4)], float)
    assert kernels.spikes(spiky, 15, 0.3)[2] and not kernels.spikes(spiky, 15, 0.3)[5]


def test_names_levels_and_scores(spark):
    df = spark.createDataFrame([("E1a-F2-01", "lift 3", "E1_st 7", "ground", "a to B", "A-WALL-家具 fooBar")], "n string, l string, s string, g string, p string, layer string")
    r = df.select(
        scalars.inferred_level(F.col("n")).alias("level"), scalars.inferred_type(F.col("l")).alias("type"), scalars.standard_name(F.col("s"), F.lit("stairs")).alias("name"), scalars.repaired_level(F.col("g")).alias("fixed"),
        scalars.formatted_passage_name(F.col("p")).alias("passage"), scalars.layer_tokens(F.col("layer")).alias("tokens"), scalars.score(scalars.layer_tokens(F.col("layer")), layers.WEIGHTS).alias("score"),
        scalars.alpha_list(F.lit("100-500")).alias("range"), scalars.alpha_list(F.lit("600, 200")).alias("list"), scalars.decoded_drawing_text(F.lit("a\\M+1B0A1\\M+4E2D")).alias("text"), scalars.without_subsumed(F.array(F.lit("101"), F.lit("Room 101"))).alias("names"),
    ).first()
    assert (r.level, r.type, r.name, r.fixed, r.passage) == ("2", "elevator", "E1-ST-07", "0", "a_to_b")
    assert {"A", "WALL", "家具", "FOOBAR", "FOO", "BAR"} <= set(r.tokens) and r.score == 2
    assert r.range == list(range(100, 501, 57)) and r.list == [200, 600]
    assert r.text == "a啊中" and r.names == "Room 101"


def test_layers(spark):
    names = ["0", "A-WALL", "x-Wall2", "I-FURN-WINDOW", "GRID", "S-COLS", "misc"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = {r.n for r in df.where(layers.keeps(F.col("n"), F.col("n"))).collect()}
    assert kept == {"0", "A-WALL", "x-Wall2", "S-COLS"}
    a, b = (spark.createDataFrame([(x,) for x in s], "layer string") for s in (["a-1", "b", "b"], ["b", "c_2"]))
    assert {(r.layer, r.side) for r in layers.compared(a, b).collect()} == {("a-1", "first"), ("b", "both"), ("c_2", "second")}
    assert [(r.token, r.n) for r in layers.most_common(layers.token_frequency(a), 1).collect()] == [("B", 2)]
    assert ("position", "1:1", 1) in {(r.kind, r.key, r.n) for r in layers.name_analysis(a).collect()}


def test_rooms(spark):
    shapes = {1: SQUARE, 2: SQUARE[2:] + SQUARE[:2], 3: [(4, 0), (5, 0), (5, 4), (4, 4)], 4: [(5, 0), (9, 0), (9, 4), (5, 4)]}
    df = spark.createDataFrame([("m", k, ring(v)) for k, v in shapes.items()], "map_id string, room_id long, ring array<struct<x:double,y:double>>")
    bridge = spark.createDataFrame([("m", 10, 1), ("m", 10, 2), ("m", 11, 2), ("m", 11, 3), ("m", 12, 3), ("m", 12, 4)], "map_id string, passage_id long, room_id long")
    kept, moved = rooms.without_duplicates(df, bridge)
    assert {r.room_id for r in kept.collect()} == {1, 3, 4}
    assert {(r.passage_id, r.room_id) for r in moved.collect()} == {(11, 1), (11, 3), (12, 3), (12, 4)}
    merged, bridge = rooms.merge_small(kept, moved, 6, 10)
    areas = {r.room_id: r.a for r in merged.select("room_id", rings.area(F.col("ring")).alias("a")).collect()}
    assert areas in ({1: 20.0, 4: 16.0}, {1: 16.0, 4: 20.0})
    assert {r.room_id for r in bridge.collect()} == {1, 4}
    ends = df.where("room_id = 1").select(rooms.end_points(F.col("ring"), F.lit(None).cast("array<struct<x:double,y:double>>"), rings.point(F.lit(4.0), F.lit(2.0)), F.col("ring")).alias("e"))
    assert ends.count() == 1
    a, b = df.where("room_id = 1").select("map_id", F.col("ring").alias("a")), df.where("room_id = 3").select("map_id", F.col("ring").alias("b"))
    e = a.join(b, "map_id").select(rooms.end_points(F.col("a"), F.col("b"), rings.point(F.lit(4.0), F.lit(2.0)), F.col("a")).alias("e")).first().e
    assert {tuple(p) for p in e} == {(4.0, 0.0), (4.0, 4.0)}
    pairs = spark.createDataFrame([("m", 11, 1, 3, ring([(4, 0), (4, 4)]))], "map_id string, passage_id long, a long, b long, ends array<struct<x:double,y:double>>")
    out = rooms.export(df.where("room_id in (1, 3)"), pairs, 31.0, 121.0, 0.05, (0.0, 0.0))
    assert out.nodes.count() == 7 and out.ways.count() == 3
    assert [len(r.nds) for r in out.ways.orderBy("ord").collect()] == [5, 5, 2]


def test_graphs(spark):
    e = spark.createDataFrame([("m", 1, "a", "b", 1.0), ("m", 2, "b", "c", 1.0), ("m", 3, "c", "d", 5.0), ("m", 4, "c", "e", 0.5), ("m", 5, "x", "y", 2.0), ("m", 6, "d", "f", 1.0), ("m", 7, "d", "g", 1.0)], "map_id string, edge_id long, a string, b string, length double")
    assert {r.edge_id for r in graph.largest_component(e).collect()} == {1, 2, 3, 4, 6, 7}
    assert {r.edge_id for r in graph.dead_ends(e).where("dead_end").collect()} == {1, 4, 5, 6, 7}
    assert {r.edge_id for r in graph.without_dead_ends(e, 0.9).collect()} == {1, 2, 3, 5, 6, 7}
    chains = {(r.a, r.b, r.length) for r in graph.joined_chains(e).collect()}
    assert chains == {("a", "c", 2.0), ("c", "d", 5.0), ("c", "e", 0.5), ("x", "y", 2.0), ("d", "f", 1.0), ("d", "g", 1.0)}
    far = {r.node: (r.distance, r.hops) for r in graph.distances_from(e, spark.createDataFrame([("m", "a")], "map_id string, start string")).collect()}
    assert far["g"] == (8.0, 4) and far["e"] == (2.5, 3) and "x" not in far
    assert {r.node for r in graph.propagated(e, spark.createDataFrame([("m", "x")], "map_id string, node string")).collect()} == {"x", "y"}
    assert graph.line_graph(e).count() == 7
    left, groups = graph.contracted(e, spark.createDataFrame([("m", n, 0.0, float(i)) for i, n in enumerate("abcdefgxy")], "map_id string, node string, x double, y double"), 0.6)
    assert left.count() == 6 and groups.count() == 8
    sites = spark.createDataFrame([("m", float(x), float(y)) for x in range(4) for y in range(3)], "map_id string, x double, y double").withColumn("x", F.col("x") + F.col("y") * 0.01)
    assert graph.voronoi(sites).where("length > 0.5").count() >= 5


def test_a_spur_of_many_segments_goes_as_one(spark):
    """A square of two-leg sides, a spur of six legs of length 1 at one corner, and a longer arm at another."""
    path = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    line = lambda *xy: [(f"{p}", f"{q}", path(p, q), math.dist(p, q)) for p, q in zip(xy, xy[1:])]
    square = line((0, 0), (5, 0), (10, 0), (10, 5), (10, 10), (5, 10), (0, 10), (0, 5), (0, 0))
    spur, arm, far = line(*((-k, -1 * (k > 0)) for k in range(7))), line((10, 10), (14, 14), (30, 14)), line((50, 50), (51, 50))
    rows = [("m", i, *e) for i, e in enumerate([*square, *spur, *arm, *far, ("(5, 0)", "(5, 0)", path((5, 0)), 0.0)])]
    edges = spark.createDataFrame(rows, "map_id string, edge_id long, a string, b string, path array<struct<x:double,y:double>>, length double")
    chains = {frozenset((r.a, r.b)): r for r in graph.joined_chains(edges.where("length > 0")).collect()}
    assert round(chains[frozenset(("(-6, -1)", "(0, 0)"))].length, 3) == round(math.sqrt(2) + 5, 3)
    walked = [(p.x, p.y) for p in chains[frozenset(("(-6, -1)", "(0, 0)"))].path]
    assert walked in ([(-k, -1.0 * (k > 0)) for k in range(7)], [(-k, -1.0 * (k > 0)) for k in range(6, -1, -1)])
    left = {round(r.length, 6): len(r.path) for r in segment.cleaned(edges, (3.0, 7.0, 20.0)).collect()}
    assert left == {40.0: 9, round(math.hypot(4, 4) + 16, 6): 3}
    ring, = segment.cleaned(edges, (3.0, 7.0, 50.0)).collect()
    assert ring.length == 40.0 and ring.a == ring.b and len(ring.path) == 9


def test_numbers_and_neighbours(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = sorted((r.n, r.k) for r in ids.numbered(df, ["k"], "n").collect())
    assert got == [(i + 1, k) for i, k in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))]
    points = spark.createDataFrame([(i, (i * 37 % 100) / 10, (i * 61 % 100) / 10) for i in range(100)], "id long, x double, y double")
    rows = points.collect()
    expected = {(a.id, b.id) for a in rows for b in rows if math.hypot(a.x - b.x, a.y - b.y) < 1.5}
    assert {(r.a, r.b) for r in spatial.within_distance(points, points, "id", 1.5).collect()} == expected
    t = statistics.summary(points, "x", skip_largest=3, key="id").first()
    assert t.n == 97 and t.max == 9.6


def test_sweeps(spark):
    images = spark.createDataFrame([("Office_1.png", 5000, 3000), ("scuola.png", 3000, 2500), ("other.png", 1000, 1000)], "file string, width int, height int")
    got = {(r.file, r.alpha): r for r in sweep.runs(images, "200,600", skip=["other"]).collect()}
    assert len(got) == 4 and got[("Office_1.png", 200)].resolution == pytest.approx(0.028)
    assert got[("scuola.png", 600)].door_width == pytest.approx(math.sqrt(600 * 4 * 0.045**2) - 0.1)
    for alpha in (200, 600):
        r = got[("scuola.png", alpha)]
        assert math.ceil((min(r.door_width, r.corridor_width) + 0.1) ** 2 * 0.25 / r.resolution**2 - 1e-9) == alpha


def test_rasters(spark):
    grey = np.full((30, 40), 255, np.uint8)
    grey[10:13, 2:18] = 0
    grey[10:13, 21:38] = 0
    grey[25, 30] = 0
    content = raster.encode_png(grey)
    assert (raster.decode_png(content)[..., 0] == grey).all()
    files = spark.createDataFrame([("a", content)], "file string, content binary")
    assert tuple(raster.dimensions(files).first()) == ("a", 40, 30)
    images = raster.read(files)
    assert raster.sites(images).count() == (grey == 0).sum()
    assert raster.pixel_shares(images).first().three_values
    mask = grey == 0
    assert raster.labelled(mask).max() == 3
    assert raster.directional(mask, "small")[11, 19] and not mask[11, 19]
    assert not raster.without_noise(mask, 20)[25, 30]
    inverse = raster.mapped(images, lambda m: 255 - m)
    assert {r.area for r in raster.components(inverse).collect()} == {48, 51, 1}
    assert {r.area for r in raster.large_components(raster.components(inverse), 20).collect()} == {48, 51}
    assert raster.gaps_filled(grey, "small", 20)[11, 19] == 0
    assert raster.edges(grey).any() and len(raster.segments(mask, 10)) >= 6
    points = raster.sites(images)
    kept = raster.without_outliers(points, 5, 1.0)
    assert kept.count() == points.count() - 1 and kept.where("y = 25").count() == 0


DXF = """0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nLAYER\n0\nLAYER\n2\nA-WALL\n62\n3\n6\nCONT\n0\nENDTAB\n0\nENDSEC
0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB\n0\nLINE\n8\n0\n10\n0\n20\n0\n11\n1\n21\n0\n0\nENDBLK\n0\nENDSEC
0\nSECTION\n2\nENTITIES\n0\nLINE\n8\nA-WALL\n10\n0\n20\n0\n11\n4\n21\n3\n0\nCIRCLE\n8\nA-WALL\n10\n1\n20\n1\n40\n2
0\nLWPOLYLINE\n8\nX\n90\n2\n70\n1\n10\n0\n20\n0\n10\n5\n20\n0\n10\n5\n20\n5\n0\nINSERT\n8\nA-WALL\n2\nB\n10\n10\n20\n10\n41\n2\n42\n1\n50\n90
0\nTEXT\n8\nT\n10\n7\n20\n8\n1\n Room 5 \n0\nENDSEC\n0\nEOF\n"""


def test_drawings(spark):
    from floorwise.operators import labels

    found = dxf.read(spark.createDataFrame([("f", DXF.encode())], "file_id string, content binary")).cache()
    assert [(r.raw_name, r.color) for r in dxf.layers(found).collect()] == [("A-WALL", 3)]
    drawn = dxf.exploded(found).cache()
    lines = {tuple((round(p.x, 6), round(p.y, 6)) for p in r.pts): r.layer for r in drawn.where("etype = 'LINE'").collect()}
    assert lines == {((0, 0), (4, 3)): "A-WALL", ((10, 10), (10, 12)): "A-WALL"}
    assert drawn.where("etype = 'INSERT'").count() == 0
    points = dxf.bound_points(drawn)
    assert points.agg(F.min("x"), F.max("y")).first() == (-1.0, 12.0)
    texts = labels.extracted_texts(dxf.entities(found), "T")
    assert [(r.text, r.entity_type) for r in texts.collect()] == [("Room 5", "TEXT")]
    bounds = points.groupBy("file_id").agg(projection.padded_bounds(F.min("x"), F.min("y"), F.max("x"), F.max("y")).alias("b")).select("file_id", "b.*")
    svg = dxf.svg(drawn, bounds).first().svg
    assert svg.count("<polyline") == 2 and svg.count("<circle") == 1 and svg.count("<polygon") == 1
    assert labels.pixel_texts(texts, bounds).count() == 1


def test_exits_and_passages(spark):
    e = spark.createDataFrame([("m", 1, "a", "b", 1.0), ("m", 2, "b", "c", 2.0), ("m", 3, "c", "d", 4.0), ("m", 4, "x", "y", 1.0)], "map_id string, edge_id long, a string, b string, length double")
    exits = spark.createDataFrame([("m", 1, "a"), ("m", 2, "c"), ("m", 3, "d"), ("m", 4, "x")], "map_id string, exit_id int, node string")
    got = {(r.exit_id, r.other): (r.distance, r.hops, r.nearest) for r in graph.exit_distances(e, exits).collect()}
    assert got == {(1, 2): (3.0, 2, True), (1, 3): (7.0, 3, False), (2, 1): (3.0, 2, True), (2, 3): (4.0, 1, False), (3, 1): (7.0, 3, False), (3, 2): (4.0, 1, True)}
    bridge = spark.createDataFrame([("m", "p", 1), ("m", "q", 1), ("m", "q", 2)], "map_id string, passage_id string, room_id int")
    ways = spark.createDataFrame([("m", 1, "p", "x", 2.0, 1), ("m", 2, "x", "q", 2.5, 1), ("m", 3, "p", "q", 9.0, 1), ("m", 4, "p", "q", 0.5, 2), ("m", 5, "q", "p", 0.1, None)], "map_id string, edge_id int, a string, b string, length double, room_id int")
    assert [tuple(r) for r in graph.passage_edges(ways, bridge).collect()] == [("m", 1, "p", "q", 4.5, 2, ["p", "x", "q"])]
    values = spark.createDataFrame([(float(x * 37 % 101),) for x in range(100)] + [(None,)], "v double")
    want = np.percentile([x * 37 % 101 for x in range(100)], [0, 0.5, 50, 99.5, 100])
    assert statistics.quantiles(values, "v", [0, 0.005, 0.5, 0.995, 1]) == pytest.approx(list(want)) and statistics.quantiles(values.limit(0), "v", [0.5]) == []
    assert [r[0] for r in spark.createDataFrame([(0.5,), (-0.5,), (1.4,)], "v double").select(scalars.nearest_int(F.col("v"))).collect()] == [1, 0, 1]


def test_inserts_of_any_depth(spark):
    block = lambda name, inner: f"0\nBLOCK\n2\n{name}\n{inner}\n0\nENDBLK\n"
    insert = lambda name: f"0\nINSERT\n8\n0\n2\n{name}\n10\n1\n20\n0\n41\n1\n42\n1\n50\n0"
    blocks = "".join(block(f"B{i}", insert(f"B{i + 1}")) for i in range(9)) + block("B9", "0\nLINE\n8\n0\n10\n0\n20\n0\n11\n1\n21\n0")
    cycle = block("C", insert("D")) + block("D", insert("C"))
    text = f"0\nSECTION\n2\nBLOCKS\n{blocks}{cycle}0\nENDSEC\n0\nSECTION\n2\nENTITIES\n{insert('B0')}\n{insert('C')}\n0\nENDSEC\n0\nEOF\n"
    drawn = dxf.exploded(dxf.read(spark.createDataFrame([("f", text.encode())], "file_id string, content binary")).cache()).collect()
    assert [[(p.x, p.y) for p in r.pts] for r in drawn if r.etype == "LINE"] == [[(10.0, 0.0), (11.0, 0.0)]]
    assert [r.name for r in drawn if r.etype == "INSERT"] == ["C"]


def test_rings_that_overlap_are_united():
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    area = lambda rings: sum(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1)) for r in rings) / 2
    assert area(kernels.ring_union([box(0, 0, 4, 4), box(2, 2, 4, 4)])) == pytest.approx(28)
    assert area(kernels.ring_union([box(0, 0, 9, 9), box(2, 2, 3, 3)])) == pytest.approx(81)
    frame = kernels.ring_union([box(0, 0, 9, 2), box(0, 7, 9, 2), box(0, 0, 2, 9), box(7, 0, 2, 9)])
    assert area(frame) == pytest.approx(81 - 25) and len(frame) == 2 and kernels.polygon_area(kernels.largest(frame)) == pytest.approx(81)
    draw = np.random.default_rng(8)
    for _ in range(40):
        boxes = [box(*draw.integers(0, 12, 2), *draw.integers(1, 8, 2)) for _ in range(5)]
        grid = np.stack(np.meshgrid(np.arange(20) + 0.5, np.arange(20) + 0.5), axis=-1).reshape(-1, 2)
        assert area(kernels.ring_union(boxes)) == pytest.approx(np.any([kernels.inside(grid, b) for b in boxes], axis=0).sum())


def test_distances_do_not_stop_silently(spark):
    e = spark.createDataFrame([("m", i, f"n{i}", f"n{i + 1}", 1.0) for i in range(4)], "map_id string, edge_id long, a string, b string, length double")
    start = spark.createDataFrame([("m", "n0")], "map_id string, start string")
    assert graph.distances_from(e, start, most_rounds=5).count() == 5
    with pytest.raises(ValueError):
        graph.distances_from(e, start, most_rounds=2)


def random_graph(seed, nodes=14, edges=20):
    draw = np.random.default_rng(seed)
    pairs = {tuple(sorted(draw.choice(nodes, 2, replace=False).tolist())) for _ in range(edges)}
    return [(f"m{seed}", i, f"n{a:02d}", f"n{b:02d}", float(draw.integers(1, 40)) / 4) for i, (a, b) in enumerate(sorted(pairs))]


def all_ways(rows, start, home=None):
    """{node: (distance, hops)} by relaxing until nothing changes; ``home`` is reached and not passed."""
    best, moved = dict(start), True
    while moved:
        moved = False
        for _, _, a, b, length in rows:
            for u, v in ((a, b), (b, a)):
                if u in best and u != home and (best[u][0] + length, best[u][1] + 1) < best.get(v, (math.inf, 0)):
                    best[v], moved = (best[u][0] + length, best[u][1] + 1), True
    return best


def test_paths_between_all_vertices(spark):
    rows = random_graph(1) + random_graph(2, 20, 26)
    df = spark.createDataFrame(rows, "map_id string, edge_id int, a string, b string, length double")
    starts = df.select("map_id", F.col("a").alias("start")).distinct()
    found = graph.shortest_paths(graph.distances_from(df, starts, predecessors=True)).collect()
    lengths = {(m, *e): x for m, _, a, b, x in rows for e in ((a, b), (b, a))}
    for r in found:
        best = all_ways([e for e in rows if e[0] == r.map_id], {r.start: (0.0, 0)})
        assert (r.distance, r.hops) == best[r.node] and r.path[0] == r.start and r.path[-1] == r.node and len(r.path) == r.hops + 1
        assert sum(lengths[r.map_id, a, b] for a, b in zip(r.path, r.path[1:])) == r.distance
    assert len(found) == sum(len(all_ways([e for e in rows if e[0] == m], {s: (0.0, 0)})) for m, s in {(e[0], e[2]) for e in rows})


def test_searches_from_exits(spark):
    rows = random_graph(3, 12, 12) + random_graph(4, 16, 20)
    df = spark.createDataFrame(rows, "map_id string, edge_id int, a string, b string, length double")
    features = spark.createDataFrame([("m4", "n03"), ("m4", "n05")], "map_id string, node string")
    far, exits, loops = graph.exit_searches(df, features)
    distances = {(r.map_id, r.exit_id, r.other): (r.distance, r.hops) for r in far.collect()}
    loops = {(r.map_id, r.node, r.first, r.second): (r.distance, r.hops) for r in loops.collect()}
    expected, back = {}, {}
    for r in exits.collect():
        mine = [e for e in rows if e[0] == r.map_id]
        _, _, a, b, length = next(e for e in mine if e[1] == r.edge_id)
        other = b if r.node == a else a
        best = all_ways(mine, {other: (length, 1)}, home=r.node)
        best.pop(r.node, None)
        expected |= {(r.map_id, r.exit_id, n): d for n, d in best.items()}
        beyond = [e for e in mine if e[2] in best and e[3] in best]
        leads_back = [(e, n) for e in mine if e[1] != r.edge_id and r.node in e[2:4] for n in e[2:4] if n != r.node and n in best]
        assert r.loop_back == bool(leads_back) and r.loop == (bool(leads_back) or len(beyond) >= len(best))
        for e, n in leads_back:
            second = f"{e[1]}@{r.node}"
            if r.exit_id < second:
                back[r.map_id, r.node, r.exit_id, second] = (best[n][0] + e[4], best[n][1] + 1)
        degree = lambda n: sum(n in e[2:4] for e in mine)
        major = min(((d[0], n) for n, d in best.items() if degree(n) > 1 and (r.map_id, n) not in (("m4", "n03"), ("m4", "n05"))), default=(None, None))
        assert (r.next_major_distance, r.next_major) == major
    assert distances == expected and loops == back and back


def test_nearest_neighbours_are_exact(spark):
    """Clusters of very different density, a far point, copies, a group of one, and groups smaller than k."""
    from floorwise.operators import spatial

    draw = np.random.default_rng(4)
    rows = [("a", i, *map(float, draw.normal(0, 1, 2))) for i in range(80)] + [("a", 100 + i, *map(float, 500 + draw.normal(0, 60, 2))) for i in range(30)] + [("a", 900, 1e6, -1e6)]
    rows += [("b", i, float(i % 3), 0.0) for i in range(9)] + [("c", 1, 5.0, 5.0)] + [("d", i, float(i), 2.0) for i in range(3)]
    df = spark.createDataFrame(rows, "map_id string, id int, x double, y double")
    got = {(r.map_id, r.id): (r.found, r["mean"], r.kth) for r in spatial.nearest(df, 5, ["map_id"]).collect()}
    assert len(got) == len(rows)
    for m, i, x, y in rows:
        away = sorted(math.dist((x, y), q[2:]) for q in rows if q[0] == m and q[1] != i)[:5]
        found, mean, kth = got[m, i]
        assert found == len(away) and (mean, kth) == (pytest.approx(np.mean(away)), pytest.approx(away[-1])) if away else (found, mean, kth) == (0, None, None)
    alone = {r.id: r["mean"] for r in spatial.nearest(df.where("map_id = 'd'").drop("map_id"), 2, []).collect()}
    assert alone == {0: 1.5, 1: 1.0, 2: 1.5}


def test_slanted_lines(spark):
    """Lines of several slopes are found within a pixel and a degree; a gap divides one."""
    rows, lines = [], {}
    for n, (degrees, length) in enumerate([(0, 60), (90, 50), (33, 70), (120, 64), (171, 80)]):
        a = math.radians(degrees)
        ends = ((100, 100), (100 + length * math.cos(a), 100 + length * math.sin(a)))
        lines[f"i{n}"] = (degrees, ends)
        rows += [(f"i{n}", float(round(100 + k / 4 * math.cos(a))), float(round(100 + k / 4 * math.sin(a)))) for k in range(4 * length + 1)]
    rows += [("gap", float(x), 7.0) for x in [*range(40), *range(60, 110)]] + [("noise", float(37 * i % 101), float(53 * i % 89)) for i in range(60)]
    df = spark.createDataFrame(rows, "file string, x double, y double")
    found = raster.hough_segments(df).collect()
    for file, (degrees, (p, q)) in lines.items():
        s, = (r for r in found if r.file == file)
        a, b = (s.x0, s.y0), (s.x1, s.y1)
        away = min(max(math.dist(a, p), math.dist(b, q)), max(math.dist(a, q), math.dist(b, p)))
        assert away <= 1.5 and abs((s.theta - 90 - degrees + 90) % 180 - 90) <= 1, (file, s)
        normal = math.radians(s.theta)
        assert all(abs(x * math.cos(normal) + y * math.sin(normal) - s.rho) <= 1.5 for x, y in (p, q))
    assert sorted((r.x0, r.x1) if r.x0 < r.x1 else (r.x1, r.x0) for r in found if r.file == "gap") == [(0.0, 39.0), (60.0, 109.0)]
    assert not [r for r in found if r.file == "noise"]
    assert raster.hough_segments(df.limit(0)).count() == 0


def test_points_of_two_rings_are_merged(spark):
    """As sorting and dropping what equals the last one kept, also where equality is not transitive."""
    draw = np.random.default_rng(6)
    rows = []
    for n in range(40):
        made = [[(float(round(x)), float(round(y)) + float(draw.choice([0, 4e-7, 8e-7, 1.6e-6]))) for x, y in draw.uniform(0, 3, (int(draw.integers(0, 9)), 2))] for _ in range(2)]
        rows.append((n, *(ring(m) for m in made)))
    df = spark.createDataFrame(rows, "id int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    for r in df.withColumn("m", rings.merged_points(F.col("a"), F.col("b"))).collect():
        kept = []
        for p in sorted((q.x, q.y) for q in [*r.a, *r.b]):
            if not kept or abs(p[0] - kept[-1][0]) >= 1e-6 or abs(p[1] - kept[-1][1]) >= 1e-6:
                kept.append(p)
        assert [(q.x, q.y) for q in r.m] == kept


def test_summaries_without_the_largest(spark):
    rows = [(g, k, float(v)) for g, values in ((None, [5, 5, 1]), ("a", [3, 9, 9, 9, 2]), ("b", [4])) for k, v in enumerate(values)] + [("a", 9, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {r.g: (r.n, r["min"], r["max"], r["median"]) for r in statistics.summary(df, "v", ["g"], 2, "k").collect()}
    assert got == {None: (1, 1.0, 1.0, 1.0), "a": (4, 2.0, 9.0, 3.0)}
    assert [tuple(r) for r in statistics.summary(df.where("g is not null").drop("g"), "v", [], 3).collect()] == [(4, 2.0, 4.0, pytest.approx(3.0), 3.0)]


def test_image_formats(spark):
    """The same picture in every format that is read."""
    import struct
    import zlib

    draw = np.random.default_rng(2)
    grey = draw.integers(0, 256, (5, 7)).astype(np.uint8)
    colour = np.repeat(grey[..., None], 3, axis=2)

    def png(depth, kind, rows, *chunks):
        chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, depth, kind, 0, 0, 0))
        return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunk(*c) for c in chunks) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")

    palette = b"".join(bytes([v] * 3) for v in range(256))
    bmp = lambda bits, rows, table=b"": b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(table)) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, bits, 0, 0, 0, 0, 0, 0) + table + b"".join(r + b"\0" * (-len(r) % 4) for r in rows)
    files = {
        "grey.png": raster.encode_png(grey),
        "palette.png": png(8, 3, [r.tobytes() for r in grey], (b"PLTE", palette)),
        "clear.png": png(8, 3, [r.tobytes() for r in grey], (b"PLTE", palette), (b"tRNS", b"\xff" * 9)),
        "deep.png": png(16, 0, [b"".join(bytes([v, 9]) for v in r.tolist()) for r in grey]),
        "24.bmp": bmp(24, [r.tobytes() for r in colour[::-1]]),
        "32.bmp": bmp(32, [np.dstack([colour, grey[..., None] * 0])[y].tobytes() for y in range(4, -1, -1)]),
        "8.bmp": bmp(8, [r.tobytes() for r in grey[::-1]], b"".join(bytes([v, v, v, 0]) for v in range(256))),
        "raw.pgm": b"P5 # a map\n7 5\n255\n" + grey.tobytes(),
        "plain.pgm": b"P2\n7 5\n255\n" + " ".join(map(str, grey.ravel().tolist())).encode(),
        "raw.ppm": b"P6\n7 5\n255\n" + colour.tobytes(),
        "plain.ppm": b"P3\n7 5\n255\n" + " ".join(map(str, colour.ravel().tolist())).encode(),
    }
    rows = raster.read(spark.createDataFrame(list(files.items()), "file string, content binary")).collect()
    assert len(rows) == len(files)
    for r in rows:
        assert (r.width, r.height) == (7, 5) and bytes(r.pixels) == grey.tobytes(), r.file
    bits = grey < 128
    two = np.where(bits, 0, 255).astype(np.uint8)
    packed = [np.packbits(b).tobytes() for b in bits]
    assert (raster.grey(raster.decode(b"P4\n7 5\n" + b"".join(packed))) == two).all()
    assert (raster.grey(raster.decode(b"P1\n7 5\n" + "".join(str(int(v)) for v in bits.ravel()).encode())) == two).all()
    assert (raster.grey(raster.decode(png(1, 0, [np.packbits(~b).tobytes() for b in bits]))) == two).all()
    with pytest.raises(ValueError):
        raster.decode(b"GIF89a")


def test_resizing():
    flat = np.full((9, 13), 77, np.uint8)
    assert (raster.resized(flat, 31, 4) == 77).all() and raster.resized(flat, 31, 4).shape == (4, 31)
    image = np.random.default_rng(3).integers(0, 256, (12, 8)).astype(np.uint8)
    assert (raster.resized(image, 8, 12) == image).all()  # the kernel is one at its own pixel and zero at all others
    ramp = np.tile(np.arange(0, 240, 2, dtype=np.uint8), (6, 1))
    half = raster.resized(ramp, 60, 6).astype(int)
    assert np.abs(half[0, 5:-5] - (ramp[0, 10:-10:2].astype(int) + 1)).max() <= 1
    assert raster.fitted(image, 100, 30).shape == (30, 20) and raster.fitted(image.T, 100, 300).shape == (66, 100)


def test_votes_are_not_joined(spark):
    """Lines come from one aggregate of votes, so no table of votes can be sent to the driver."""
    rows = [(f"f{n}", float(x), float((n * x) // 4)) for n in range(4) for x in range(50)]
    lines = raster.hough_lines(spark.createDataFrame(rows, "file string, x double, y double"))
    assert "Join" not in lines._jdf.queryExecution().optimizedPlan().toString()
    found = lines.collect()
    assert {r.file for r in found} == {"f0", "f1", "f2", "f3"} and all(r.votes >= 30 for r in found)
    assert [(r.theta, r.rho, r.votes) for r in found if r.file == "f0"] == [(90, 0, 50)]


def test_flags_are_landed_once_for_each_node(spark, monkeypatch):
    landed = []
    written = graph.Written

    def counted(df, name, *keep):
        made = written(df, name, *keep)
        landed.append((name, made.df.count()))
        return made

    monkeypatch.setattr(graph, "Written", counted)
    e = spark.createDataFrame([("m", f"{i}", f"{i + 1}") for i in range(6)] + [("m", "a", "b")], "map_id string, a string, b string")
    nodes = spark.createDataFrame([("m", f"{i}") for i in range(5)], "map_id string, node string")
    found = graph.propagated(e, nodes.where("node = '0'"), nodes).collect()
    assert sorted(r.node for r in found) == ["0", "1", "2", "3", "4", "5"]
    assert sum(n for name, n in landed if name == "flags") == 6


def test_components_within_a_block_need_no_rounds(spark, monkeypatch):
    def labels(edges, kind, block):
        return {r.node: r.label for r in graph.components(spark.createDataFrame(edges, f"a {kind}, b {kind}"), block).collect()}

    chain = [(i + i % 2, i + 1 - i % 2) for i in range(1000)]
    far = [((i * 7919) % 1009, (i * 104729 + 13) % 1009) for i in range(400)]
    want: dict = {}
    for a, b in chain + far + [(5000, 5000), (6000, 6000), (6000, 6001)]:
        x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
        if x is not y:
            x |= y
            want.update((n, x) for n in y)
    edges = chain + far + [(5000, 5000), (6000, 6000), (6000, 6001), (None, 3), (4, None)]
    assert labels(edges, "long", 50) == {n: min(group) for n, group in want.items()}  # blocks that nodes join
    text = lambda n: None if n is None else f"é{n}"
    assert labels([(text(a), text(b)) for a, b in edges], "string", 70) == {text(n): min(map(text, group)) for n, group in want.items()}
    monkeypatch.setattr(graph, "_labelled", None)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert labels(chain, "long", 2000) == {n: 0 for n in range(1001)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chained_paths_of_a_whole_batch(spark):
    assert kernels.chained([(4, "b", "c"), (5, "b", "a"), (6, "c", "d")], "a") == [(5, True), (4, False), (6, False)]
    p = lambda *xs: [{"x": float(x), "y": 0.0} for x in xs]
    leg = lambda a, b, *xs: {"a": a, "b": b, "path": p(*xs)}
    chains = [
        ([leg("b", "c", 2, 2.5, 3), leg("b", "a", 2, 1), leg("c", "d", 3, 4)], "a", [1, 2, 2.5, 3, 4]),
        ([leg("x", "y", 7, 8)], "y", [8, 7]),
        ([], "z", []),
        ([leg("u", "u", 1, 5, 1)], "u", [1, 5, 1]),
        ([leg("e", "f"), leg("f", "g", 3, 4), leg("g", "h"), leg("h", "i", 4, 9)], "e", [3, 4, 9]),  # nothing is dropped behind no points
    ]
    df = spark.createDataFrame([(n, legs, start) for n, (legs, start, _) in enumerate(chains)], "n int, legs array<struct<a string, b string, path array<struct<x double, y double>>>>, start string").coalesce(1)
    got = {r.n: [q.x for q in r.path] for r in df.select("n", kernels.chained_path("legs", "start").alias("path")).collect()}
    assert got == {n: xs for n, (_, _, xs) in enumerate(chains)}


def test_distances_by_rounds_put_their_logs_together(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_ARCS", 0)
    monkeypatch.setattr(graph, "MOST_LOGS", 2)
    edges = spark.createDataFrame([("m", 1, 1, 2, 1.0), ("m", 2, 2, 3, 1.0), ("m", 3, 1, 3, 5.0), ("m", 4, 3, 4, 1.0), ("m", 5, 4, 5, 0.0), ("m", 6, 1, 6, 2.0), ("m", 7, 6, 3, 0.0), ("n", 1, 1, 2, 1.0)], "map_id string, edge_id int, a int, b int, length double")
    starts = spark.createDataFrame([("m", 1), ("m", 4)], "map_id string, start int")
    got = {(r.start, r.node): (r.distance, r.hops, r.via) for r in graph.distances_from(edges, starts, predecessors=True).collect()}
    assert got == {
        (1, 1): (0, 0, None), (1, 2): (1, 1, 1), (1, 3): (2, 2, 2), (1, 4): (3, 3, 3), (1, 5): (3, 4, 4), (1, 6): (2, 1, 1),
        (4, 4): (0, 0, None), (4, 5): (0, 1, 4), (4, 3): (1, 1, 4), (4, 6): (1, 2, 3), (4, 2): (2, 2, 3), (4, 1): (3, 3, 2),
    }


def test_votes_of_small_files_do_not_move(spark, monkeypatch):
    rows = [(f"f{n}", float(x), float((n * x) // 4)) for n in range(5) for x in range(50 + n) if not 20 < x < 36] + [("f9", float(x * 7919 % 100_003), float(x)) for x in range(40)]
    points = spark.createDataFrame(rows, "file string, x double, y double")
    votes = {(r.file, r.theta, r.rho, r.votes) for r in raster._votes(points).groupBy("file", "theta", "rho").count().withColumnRenamed("count", "votes").where("votes >= 12").collect()}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for batch in ("7", before):
        spark.conf.set(name, batch)
        assert {tuple(r) for r in raster._counted(points.repartition(2, "file"), 12).collect()} == votes and votes
    spark.conf.set(name, before)
    found = [sorted(map(tuple, raster.hough_segments(points, 20, 5.0).collect()))]
    monkeypatch.setattr(raster, "FEW_POINTS", 45)
    found.append(sorted(map(tuple, raster.hough_segments(points, 20, 5.0).collect())))
    assert found[0] == found[1] and len(found[0]) >= 5
