import numpy as np
import pytest
from pyspark.sql import functions as F

from floorwise.functions import kernels, rings
from floorwise.operators import labels, rooms
from floorwise.sources import files
from floorwise.sources.osm_xml import Maps, parse
from tests import maps as M

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def maps_of(spark, **contents):
    return Maps(parse(spark.createDataFrame([(k, v) for k, v in contents.items()], "map_id string, content binary")).cache())


def test_texts_find_their_rooms(spark):
    shapes = [("m", 1, "r1", ring([(0, 0), (100, 0), (100, 100), (0, 100)])), ("m", 2, "r2", ring([(200, 0), (300, 0), (300, 100), (200, 100)]))]
    room = spark.createDataFrame(shapes, f"map_id string, ord int, id string, ring {RING}")
    texts = spark.createDataFrame([("m", 1, "A", (50.0, 50.0)), ("m", 2, "B", (190.0, 50.0)), ("m", 3, "C", (150.0, 400.0)), ("m", 4, "D", (95.0, 95.0))], "map_id string, ord int, text string, p struct<x:double,y:double>")
    got = {r.text: r for r in labels.matches(texts, room).collect()}
    assert set(got) == {"A", "B", "D"}
    assert (got["A"].room_id, got["A"].match_type, got["A"].score) == ("r1", "inside", 100)
    assert (got["B"].room_id, got["B"].match_type, got["B"].distance) == ("r2", "nearby", 10)
    ratio = (2 * 45**2) ** 0.5 / (10000 / 3.141592653589793) ** 0.5
    assert got["D"].score == pytest.approx(50 - 25 * (ratio - 0.7))
    matched = labels.matches(texts, room)
    assert [r.text for r in labels.unmatched(texts, matched).collect()] == ["C"]
    assert tuple(labels.match_statistics(texts, matched).select("total", "matched", "unmatched", "high_quality").first()) == (4, 3, 1, 2)
    assert {r.id: r.new_name for r in labels.new_names(matched).collect()} == {"r1": "A D", "r2": "B"}
    assert {r.id: r.new_name for r in labels.new_names(matched, first_only=True).collect()} == {"r1": "A", "r2": "B"}


def test_new_names_go_on_to_passages(spark):
    ways = [(-10, M.RING_A, M.area("Old A")), (-11, M.RING_B, {k: v for k, v in M.area("").items() if k != "name"}), (-12, M.RING_B, M.area("Same")), (-13, [-2, -3], M.passage("Old A", "room_-11")), (-14, [-2, -3], M.passage("Same", "Old A"))]
    maps = maps_of(spark, m=M.osm(M.GRID, ways))
    names = spark.createDataFrame([("m", "-10", "New A"), ("m", "-11", "New B")], "map_id string, id string, new_name string")
    got = {r.id: r.tags for r in labels.renamed(maps.ways, names).collect()}
    assert got["-10"]["name"] == "New A" and got["-11"]["name"] == "New B" and got["-12"]["name"] == "Same"
    assert (got["-13"]["osmAG:from"], got["-13"]["osmAG:to"]) == ("New A", "New B")
    assert (got["-14"]["osmAG:from"], got["-14"]["osmAG:to"]) == ("Same", "New A")


def test_room_polygons_and_outline(spark):
    maps = maps_of(spark, ok=M.OK)
    found = labels.room_polygons(maps).collect()
    assert len(found) == 2 and max(p.x for r in found for p in r.ring) <= 4000
    assert found[0].boundary.svg_width_px == 4000 or found[0].boundary.svg_height_px == 4000
    for method in ("boundary", "convex_hull"):
        outline = rooms.outlines(maps, method)
        xs = {round(p.x, 6) for p in outline.first().ring}
        assert min(xs) == 121.0 and max(xs) == 121.0002
    built = rooms.with_outlines(maps, rooms.outlines(maps, "convex_hull"))
    way = [r for r in built.ways.collect() if r.tags.get("building")][0]
    assert way.nds[0] == way.nds[-1] and set(way.nds) <= {r.id for r in built.nodes.collect()}


def test_side_files(spark, tmp_path):
    (tmp_path / "a.bounds.json").write_text('{\n"min_x_padded": 0, "min_y_padded": 0, "max_x_padded": 10, "max_y_padded": 5, "svg_width_px": 4000, "svg_height_px": 2000}')
    assert files.bounds_of(spark, str(tmp_path / "a.bounds.json")).first().file_id == "a"
    (tmp_path / "s.json").write_text('{"GB": {"description": "d", "layers_chinese": ["墙"], "layers_english": ["A-WALL"]}, "N": {"layers": ["x"]}}')
    assert {(r.standard, r.layer) for r in files.layer_standards(spark, str(tmp_path / "s.json")).collect()} == {("GB", "墙"), ("GB", "A-WALL"), ("N", "x")}
    (tmp_path / "l.txt").write_text("title\nA\n\nB---\n")
    lines = files.text_lines(spark, str(tmp_path / "l.txt"))
    from floorwise.operators import layers

    assert [r.layer for r in layers.without_first_line(lines).orderBy("line").collect()] == ["A"]
    (tmp_path / "p.yaml").write_text("a:\n  b: 1\n")
    tree = files.parameters(tmp_path / "p.yaml")
    known = files.translations(spark, {"en": tree})
    keys = spark.createDataFrame([("a.b",), ("c",)], "key string")
    assert {r.key: r.value for r in files.translated(keys, known, "en").collect()} == {"a.b": "1", "c": "c"}
    report = rooms.area_report(spark.createDataFrame([("m", 1, ring([(0, 0), (2, 0), (2, 2), (0, 2)])), ("m", 2, ring([(0, 0), (4, 0), (4, 4), (0, 4)]))], f"map_id string, room_id int, ring {RING}"), 0.5)
    assert [(r.room, r.area_m2, len(r.bar)) for r in report.collect()] == [("room_2", 4.0, 50), ("room_1", 1.0, 12)]
    files.write_room_areas(report, str(tmp_path / "csv"))
    assert [r.room for r in files.room_areas(spark, str(tmp_path / "csv")).collect()] == ["room_2", "room_1"]


def test_maps_are_validated_as_they_arrive(spark, tmp_path):
    from floorwise.streaming.validation import validate_arriving

    source, found = tmp_path / "in", tmp_path / "found"
    source.mkdir()
    (source / "a.osm").write_bytes(M.osm(M.GRID, [], "<osm version='0.5' generator='x'>"))
    validate_arriving(spark, str(source), str(found), str(tmp_path / "state")).awaitTermination()
    (source / "b.osm").write_bytes(b"<broken")
    validate_arriving(spark, str(source), str(found), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.category for r in spark.read.parquet(str(found)).collect()) == ["ROOT", "XML"]


def test_entry_registers_matching_names(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 2


def test_rooms_and_texts_are_measured_many_at_once(spark):
    """Inscribed centres equal those of single rings to the last bit; texts lie in and near rooms as the folds over rings say."""
    r = np.random.default_rng(7)
    for n in (3, 4, 7):
        turns = np.sort(r.uniform(0, 6.28, (30, n)), axis=1)[:, :, None]
        made = np.concatenate([np.cos(turns), np.sin(turns)], axis=2) * r.choice([0.5, 20, 300], (30, 1, 1)) + r.uniform(-1000, 1000, (30, 1, 2))
        assert (kernels.inscribed_many(made) == [kernels.inscribed(ring) for ring in made]).all()
    xy = lambda p: {"x": float(p[0]), "y": float(p[1])}
    shapes = [[], [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 0), (6, 0), (3, 3), (6, 6), (0, 6)], None]
    rows = [(None if s is None else [xy(p) for p in s], xy(p)) for s in shapes for p in [(1, 2), (4, 2), (5, 3), (-1, -1), (3, 4)]]
    df = spark.createDataFrame(rows, "ring array<struct<x double, y double>>, p struct<x double, y double>")
    ring, p, met = F.col("ring"), F.col("p"), kernels.against_ring("ring", "p")
    got = df.select(met["odd"].alias("odd"), F.coalesce(rings.odd_crossings(ring, p), F.lit(False)).alias("o"), met["away"].alias("away"), rings.boundary_distance(p, ring).alias("a")).collect()
    assert len(got) == 25 and all(x.odd == x.o and (x.away == x.a or abs(x.away - x.a) < 1e-12) for x in got)
