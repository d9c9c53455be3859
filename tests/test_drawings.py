"""Strokes, their pixels, images, reports, and pre-processing by steps."""

import shlex
import sys
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorwise import cli
from floorwise.operators import drawings, raster
from floorwise.sources import dxf
from tests.test_geometry import DXF

STROKE = "file_id string, ax double, ay double, bx double, by double"
SIZE = "file_id string, width int, height int"


def plain(ax, ay, bx, by):
    """Pixels that a stroke's part in each row covers, in fractions."""
    ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
    if ay == by:
        return {(x, floor(ay)) for x in range(floor(min(ax, bx)), floor(max(ax, bx)) + 1)}
    found = set()
    for y in range(floor(min(ay, by)), floor(max(ay, by)) + 1):
        ends = [ax + (v - ay) * (bx - ax) / (by - ay) for v in (max(min(ay, by), y), min(max(ay, by), y + 1))]
        found |= {(x, y) for x in range(floor(min(ends)), floor(max(ends)) + 1)}
    return found


def test_runs_cover_the_pixels_of_strokes(spark):
    r = np.random.default_rng(7)
    made = [tuple(int(v) / 4 for v in r.integers(-40, 120, 4)) for _ in range(60)] + [(1.0, 2.0, 1.0, 2.0), (3.5, 4.25, 9.5, 4.25), (5.0, 9.0, 5.0, 1.0)]
    # slopes of such strokes are not exact, so ends that lie on a border may go to either side of it
    found = drawings.runs(spark.createDataFrame([(str(i), *map(float, s)) for i, s in enumerate(made)], STROKE)).collect()
    for i, s in enumerate(made):
        got = {(x, q.y) for q in found if q.file_id == str(i) for x in range(q.x0, q.x1 + 1)}
        assert len(got ^ plain(*s)) <= 1 and {y for _, y in got} == {y for _, y in plain(*s)}


def test_joined_runs_are_apart(spark):
    r = np.random.default_rng(8)
    rows = [("f", int(y), int(x), int(x + n)) for y, x, n in zip(r.integers(0, 6, 200), r.integers(0, 300, 200), r.integers(0, 9, 200))]
    rows += rows[:20] + [("g", 0, 0, 4), ("g", 0, 5, 6), ("g", 0, 8, 9)]
    pixels = {(f, y, x) for f, y, a, b in rows for x in range(a, b + 1)}
    df = spark.createDataFrame(rows, "file_id string, y long, x0 long, x1 long")
    for thickness in (1, 3):
        wide = {(f, y + i, x + j) for f, y, x in pixels for i in range(thickness) for j in range(thickness)}
        found = drawings.joined(df, thickness).collect()
        assert sorted((q.file_id, q.y, x) for q in found for x in range(q.x0, q.x1 + 1)) == sorted(wide)
        starts = {(q.file_id, q.y, q.x0 - 1) for q in found}
        assert not starts & wide
    assert drawings.joined(df.limit(0)).count() == 0


def test_images_of_runs(spark):
    runs = spark.createDataFrame([("a", 1, -3, 2), ("a", 3, 4, 90), ("a", -1, 0, 3), ("a", 7, 0, 3), ("c", 0, 0, 0)], "file_id string, y long, x0 long, x1 long")
    sizes = spark.createDataFrame([("a", 9, 5), ("b", 3, 2)], SIZE)
    found = {q.file: np.frombuffer(bytes(q.pixels), np.uint8).reshape(q.height, q.width) for q in drawings.images(runs, sizes).collect()}
    want = np.full((5, 9), 255)
    want[1, :3] = want[3, 4:] = 0
    assert set(found) == {"a", "b"} and (found["a"] == want).all() and (found["b"] == 255).all()
    again = raster.read(drawings.pngs(drawings.images(runs, sizes))).where("file = 'a'").first()
    assert bytes(again.pixels) == want.astype(np.uint8).tobytes()


def test_strokes_of_entities(spark):
    rows = [
        ("f", "LINE", [(0.0, 0.0), (2.0, 1.0)], None, None, None, None, None, None),
        ("f", "LWPOLYLINE", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], None, None, None, None, None, True),
        ("f", "POLYLINE", [(0.0, 0.0), (1.0, 0.0)], None, None, None, None, None, False),
        ("f", "LWPOLYLINE", [(5.0, 5.0)], None, None, None, None, None, True),
        ("c", "CIRCLE", None, 1.0, 2.0, 3.0, None, None, None),
        ("r", "ARC", None, 0.0, 0.0, 1.0, 350.0, 80.0, None),
        ("f", "TEXT", [(0.0, 0.0), (1.0, 0.0)], None, None, None, None, None, None),
    ]
    drawn = spark.createDataFrame(rows, "file_id string, etype string, pts array<struct<x:double,y:double>>, cx double, cy double, r double, a0 double, a1 double, closed boolean")
    found = drawings.strokes(drawn).cache()
    assert {r.file_id: r["count"] for r in found.groupBy("file_id").count().collect()} == {"f": 5, "c": 180, "r": 45}
    assert found.where("file_id = 'f' and ax = 1 and ay = 1 and bx = 0 and by = 0").count() == 1
    assert found.where("file_id = 'c'").agg(F.max(F.abs(F.hypot(F.col("ax") - 1, F.col("ay") - 2) - 3))).first()[0] < 1e-9
    ends = found.where("file_id = 'r'").agg(F.min("ay"), F.max("by")).first()
    assert tuple(ends) == pytest.approx((np.sin(np.radians(-10)), np.sin(np.radians(80))))


def test_reports(spark):
    names = spark.createDataFrame([("x/a.dxf", "WALL", "WALL"), ("x/a.dxf", "DOOR", "DOOR"), ("x/b.dxf", "0", "0")], "file_id string, raw_name string, decoded_name string")
    found = {r.file_id: r.text for r in drawings.layer_reports(names, "T").collect()}
    assert found["x/a.dxf"] == "DXF文件图层信息报告\n生成时间: T\nDXF文件: a.dxf\n图层总数: 2\n\n图层列表:\nDOOR\nWALL"
    drawn = spark.createDataFrame([("x/a.dxf", "WALL"), ("x/a.dxf", "WALL"), ("x/a.dxf", "DOOR")], "file_id string, layer string")
    logs = {r.file_id: r.text for r in drawings.filter_logs(names, names.where("raw_name = 'WALL'"), drawn, "T").collect()}
    assert logs["x/a.dxf"].split("\n") == ["DXF文件图层过滤报告", "处理时间: T", "输入文件: a.dxf", "原始图层数: 2", "保留图层数: 1", "", "保留的图层列表:", "- WALL", "", "总共复制了 2 个实体到新文件。", "输出文件: a.dxf"]
    assert "保留图层数: 0" in logs["x/b.dxf"] and "总共复制了 0 个" in logs["x/b.dxf"]


def test_preprocessing_goes_on_past_failures(spark):
    bad = "import sys; sys.exit(3) if b'broken' in open(sys.argv[1], 'rb').read() else open(sys.argv[2], 'wb').write(open(sys.argv[1], 'rb').read())"
    plans = spark.createDataFrame([("a.dxf", DXF.encode()), ("b.DWG", DXF.encode()), ("c.dwg", b"broken"), ("d.dxf", b"nothing")], "file_id string, content binary")
    made = drawings.preprocessed(plans, [sys.executable, "-c", bad, "{input}", "{output}"], size=200, gap=None)
    assert {(r.file_id, r.step) for r in made.errors.collect()} == {("c.dwg", "convert"), ("d.dxf", "filter")}
    assert [(r.step, r.files, r.failed) for r in made.log.collect()] == [("convert", 2, 1), ("filter", 2, 1), ("svg", 2, 0), ("png", 2, 0)]
    assert {r.file_id for r in made.svgs.collect()} == {"a.dxf", "b.DWG"}
    shown = {r.file: np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width) for r in made.images.collect()}
    assert max(shown["a.dxf"].shape) == 200 and 100 < (shown["a.dxf"] == 0).sum() < 2000 and (shown["a.dxf"] == shown["b.DWG"]).all()
    x = next(r for r in made.bounds.collect() if r.file_id == "a.dxf")
    scale = 200 / max(x.max_x_padded - x.min_x_padded, x.max_y_padded - x.min_y_padded)
    px, py = int((2 - x.min_x_padded) * scale), int(x.svg_height_px - (1.5 - x.min_y_padded) * scale)
    assert shown["a.dxf"][py - 1 : py + 2, px - 1 : px + 2].min() == 0  # the middle of the line from (0, 0) to (4, 3)
    skipped = drawings.preprocessed(plans.where("file_id in ('a.dxf', 'b.DWG')"), skip=(2, 4))
    assert skipped.images is None and skipped.kept is None and skipped.svgs.count() == 1
    assert [(r.file_id, r.error) for r in skipped.errors.collect()] == [("b.DWG", "there is no converter")]
    assert drawings.preprocessed(plans.limit(0)).errors.count() == 0


def test_flattened_drawings(spark):
    found = dxf.read(spark.createDataFrame([("f", DXF.encode())], "file_id string, content binary"))
    again = dxf.read(dxf.to_dxf(drawings.flattened(found)).select("file_id", F.col("dxf").cast("binary").alias("content"))).cache()
    assert again.where("etype = 'INSERT' or block is not null").count() == 0
    assert again.where("etype = 'LINE'").count() == 2 and dxf.layers(again).count() == 1


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dxf").write_text(DXF)
    command = ["preprocess", str(tmp_path / "in"), "--size", "150", "--gap", "none", "--output", str(tmp_path / "out")]
    assert cli.main(command) == 0
    assert "png\t1\t0" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out" / "png")).count() == 1
    assert "总共复制了 3 个实体" in spark.read.text(str(tmp_path / "out" / "logs"), wholetext=True).first().value
    for folder in ("svg", "dxf", "bounds"):
        assert (tmp_path / "out" / folder).exists()
    (tmp_path / "in" / "b.dwg").write_bytes(b"x")
    assert cli.main([*command, "--converter", shlex.join([sys.executable, "-c", "raise SystemExit(4)"])]) == 1
    assert "the converter ended with 4" in capsys.readouterr().out
    assert cli.main(["layers", str(tmp_path / "in"), "--output", str(tmp_path / "report")]) == 0
    assert "图层总数: 1\n" in spark.read.text(str(tmp_path / "report"), wholetext=True).first().value
    assert cli.main(["flatten", str(tmp_path / "in"), "--output", str(tmp_path / "flat")]) == 0
    assert cli.main(["layers", str(tmp_path / "report"), "--output", str(tmp_path / "none")]) == 2
