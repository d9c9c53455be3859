from floorwise import cli
from floorwise.sources.osm_xml import Maps
from tests import maps as M
from tests.test_maps import floors


def test_commands_and_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "ok.osm").write_bytes(M.OK)
    (tmp_path / "bad.osm").write_bytes(M.BAD)
    assert cli.main(["validate", str(tmp_path / "ok.osm"), "-s", str(tmp_path / "report")]) == 0
    assert "statistics" in spark.read.text(str(tmp_path / "report")).first().value
    assert cli.main(["validate", str(tmp_path), "-v"]) == 1
    assert "the latitude is out of range" in capsys.readouterr().out
    assert cli.main(["repair", str(tmp_path / "bad.osm"), "--output", str(tmp_path / "fixed"), "--enable-moderate"]) == 0
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "fixed"), wholetext=True).collect())
    assert text.count("<osm ") == 1 and 'v="stairs"' in text
    (tmp_path / "empty").mkdir()
    assert cli.main(["validate", str(tmp_path / "empty")]) == 2


def test_merging_by_command(spark, tmp_path):
    for name, content in floors(2).items():
        (tmp_path / f"{name}.osm").write_bytes(content)
    assert cli.main(["merge", "--reference", str(tmp_path / "f0.osm"), "--target", str(tmp_path / "f1.osm"), "--output", str(tmp_path / "out")]) == 0
    assert cli.main(["concat", str(tmp_path / "f0.osm"), str(tmp_path / "f1.osm"), "--output", str(tmp_path / "all")]) == 0
    merged, both = (Maps.read(spark, str(tmp_path / f), "*.txt") for f in ("out", "all"))
    assert merged.nodes.count() == 7 + 6 + 4 and both.nodes.count() == 14


def test_the_reference_is_the_named_map(spark, tmp_path, capsys):
    """A name that ends like another one's, a relative path, a folder of several maps."""
    import os

    made = floors(2)
    (tmp_path / "f1.osm").write_bytes(made["f1"])
    (tmp_path / "bf1.osm").write_bytes(made["f0"])
    maps = Maps.read(spark, str(tmp_path))
    assert cli.reference_map(maps, str(tmp_path / "f1.osm")).endswith("/f1.osm")
    assert cli.reference_map(maps, str(tmp_path / "bf1.osm")).endswith("/bf1.osm")
    assert cli.reference_map(maps, os.path.relpath(tmp_path / "f1.osm")).endswith("/f1.osm")
    assert cli.reference_map(maps, f"file:{tmp_path}/f1.osm").endswith("/f1.osm")
    command = ["merge", "--target", str(tmp_path / "bf1.osm"), "--output", str(tmp_path / "out"), "--reference"]
    assert cli.main([*command, str(tmp_path)]) == 2 and "several maps" in capsys.readouterr().err
    assert cli.main([*command, str(tmp_path / "f1.osm")]) == 0


def test_outlines_and_directions_by_command(spark, tmp_path):
    square = lambda i, x: [(i, x, 0.0), (i + 1, x + 1, 0.0), (i + 2, x + 1, 1.0), (i + 3, x, 1.0)]
    nodes = "".join(f'<node id="-{i}" lat="{y}" lon="{x}"/>' for i, x, y in square(1, 0.0) + square(5, 1.0))
    way = lambda i, refs: f'<way id="-{i}">' + "".join(f'<nd ref="-{r}"/>' for r in refs) + '<tag k="osmAG:type" v="area"/><tag k="osmAG:areaType" v="room"/><tag k="indoor" v="room"/></way>'
    (tmp_path / "a.osm").write_text(f'<osm version="0.6">{nodes}{way(20, [1, 4, 3, 2, 1])}{way(21, [5, 6, 7, 8, 5])}</osm>')
    assert cli.main(["direction", str(tmp_path / "a.osm"), "--output", str(tmp_path / "turned")]) == 0
    turned = {r.id: r.nds for r in Maps.read(spark, str(tmp_path / "turned"), "*.txt").ways.collect()}
    assert turned == {"-20": ["-1", "-2", "-3", "-4", "-1"], "-21": ["-5", "-6", "-7", "-8", "-5"]}
    for method in ("boundary", "convex_hull"):
        assert cli.main(["outline", str(tmp_path / "a.osm"), "--method", method, "--output", str(tmp_path / method)]) == 0
        ways = Maps.read(spark, str(tmp_path / method), "*.txt").ways
        assert ways.where("tags['osmAG:type'] = 'building_outline'").count() == 1 and ways.count() == 3


def test_texts_are_matched_by_command(spark, tmp_path, capsys):
    nodes = "".join(f'<node id="-{i}" lat="{31 + y / 1e5}" lon="{121 + x / 1e5}"/>' for i, (x, y) in enumerate([(0, 0), (90, 0), (90, 90), (0, 90)], 1))
    (tmp_path / "f1.osm").write_text(f'<osm version="0.6">{nodes}<way id="-9"><nd ref="-1"/><nd ref="-2"/><nd ref="-3"/><nd ref="-4"/><nd ref="-1"/><tag k="osmAG:type" v="area"/><tag k="osmAG:areaType" v="room"/><tag k="indoor" v="room"/></way></osm>')
    line = "0\nLINE\n8\nW\n10\n0\n20\n0\n11\n100\n21\n100\n"
    text = "0\nTEXT\n8\nT\n10\n50\n20\n50\n1\nRoom 5\n"
    (tmp_path / "f1.dxf").write_text(f"0\nSECTION\n2\nENTITIES\n{line}{text}0\nENDSEC\n0\nEOF\n")
    command = ["match", "--drawing", str(tmp_path / "f1.dxf"), "--layer", "T", "--output", str(tmp_path / "out"), "--renamed", str(tmp_path / "named"), "--map"]
    assert cli.main([*command, str(tmp_path / "f1.osm")]) == 0
    assert "Room 5" in spark.read.text(str(tmp_path / "out")).first().value
    assert [r.tags["name"] for r in Maps.read(spark, str(tmp_path / "named"), "*.txt").ways.collect()] == ["Room 5"]
    (tmp_path / "other.osm").write_bytes((tmp_path / "f1.osm").read_bytes())
    assert cli.main([*command, str(tmp_path / "other.osm")]) == 2


def test_floor_plans_by_command(spark, tmp_path, capsys):
    import numpy as np

    from floorwise.operators import raster

    plan = np.full((80, 120), 255, np.uint8)
    for y0, y1, x0, x1 in ((10, 12, 10, 110), (68, 70, 10, 110), (10, 70, 10, 12), (10, 70, 108, 110), (10, 30, 58, 60), (50, 70, 58, 60)):
        plan[y0:y1, x0:x1] = 0
    (tmp_path / "hotel.png").write_bytes(raster.encode_png(plan))
    settings = ["--clear", "5", "--alpha", "900", "--dead-ends", "5", "--min-room-area", "0.1", "--noise-percent", "0.1"]
    assert cli.main(["segment", str(tmp_path / "hotel.png"), "--output", str(tmp_path / "out"), *settings]) == 0
    ways = Maps.read(spark, str(tmp_path / "out"), "*.txt").ways
    assert ways.where("tags['osmAG:areaType'] = 'room'").count() >= 1
    assert cli.main(["sweep", str(tmp_path), "--alpha-values", "300,900", "--dry-run", "--output", str(tmp_path / "swept")]) == 0
    shown = [line for line in capsys.readouterr().out.splitlines() if "hotel" in line]
    assert len(shown) == 2 and not (tmp_path / "swept").exists()
    assert cli.main(["sweep", str(tmp_path), "--skip", "HOTEL", "--dry-run", "--output", str(tmp_path / "swept")]) == 0
    assert cli.main(["segment", str(tmp_path / "out"), "--output", str(tmp_path / "none")]) == 2
