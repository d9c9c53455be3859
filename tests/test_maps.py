import json
from collections import Counter

import pytest

from floorwise.operators import merge, repair, validate
from floorwise.sources import osm_xml
from floorwise.sources.osm_xml import Maps
from tests import maps as M


def read(spark, tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.osm").write_bytes(content)
    return Maps(osm_xml.parse(osm_xml.discover(spark, str(tmp_path))).cache())


def named(found):
    return Counter((r.level, r.category, r.message) for r in found.collect())


def test_a_good_map_has_no_findings(spark, tmp_path):
    maps = read(spark, tmp_path, ok=M.OK)
    assert validate.findings(maps).count() == 0
    row = validate.statistics(maps).first()
    assert (row.total_nodes, row.total_ways, row.total_areas, row.total_passages) == (6, 3, 2, 1)
    assert row.areas_by_level == {"1": 2} and row.area_connections == {"E1a-F1-01": 1, "E1a-F1-02": 1}
    assert row.semantic_name_patterns == {"area": 2, "passage": 1}
    assert validate.summary(validate.findings(maps), maps.documents).first().passed


def test_semantic_rules(spark, tmp_path):
    maps = read(spark, tmp_path, bad=M.BAD)
    found = named(validate.findings(maps))
    expected = {
        ("ERROR", "NODE", "a required attribute is missing"): 1,
        ("ERROR", "NODE", "a coordinate is no number"): 1,
        ("ERROR", "NODE", "the latitude is out of range"): 1,
        ("ERROR", "NODE", "the longitude is out of range"): 1,
        ("WARNING", "NODE", "the action is unknown"): 1,
        ("WARNING", "CLASSIFICATION", "the way's type is unknown"): 1,
        ("ERROR", "AREA", "a required tag is missing"): 1,
        ("WARNING", "AREA", "the area type is unknown"): 1,
        ("ERROR", "AREA", "the level is no integer"): 1,
        ("WARNING", "AREA", "the level is out of range"): 1,
        ("ERROR", "AREA", "an area needs three nodes"): 1,
        ("ERROR", "AREA", "the ring is not closed"): 1,
        ("ERROR", "AREA", "a node is missing"): 1,
        ("ERROR", "SEMANTIC_NAMING", "the name is missing"): 1,
        ("ERROR", "PASSAGE", "a required tag is missing"): 3,
        ("ERROR", "PASSAGE", "a passage needs two nodes"): 1,
        ("ERROR", "PASSAGE", "neither end has an area"): 1,
        ("ERROR", "SEMANTIC_REFERENCE", "the area is missing"): 1,
        ("WARNING", "LEVEL_CONSISTENCY", "the level differs from the parent's"): 1,
        ("WARNING", "VERTICAL_TRANSPORT", "it is on one level only"): 1,
        ("ERROR", "VERTICAL_TRANSPORT", "it is on a level more than once"): 1,
        ("ERROR", "CROSS_LEVEL_PASSAGE", "the level is missing"): 1,
        ("ERROR", "CROSS_LEVEL_PASSAGE", "the level is no integer"): 1,
        ("WARNING", "CROSS_LEVEL_PASSAGE", "it joins no lift or stairs"): 1,
        ("WARNING", "CROSS_LEVEL_PASSAGE", "no adjacent level has the facility"): 1,
    }
    assert found == expected


@pytest.mark.parametrize(
    ("head", "expected"),
    [
        ("<gpx version='0.6'>", ("ERROR", "ROOT", "the root element is not osm")),
        ("<osm generator='x'>", ("ERROR", "ROOT", "the version is missing")),
        ("<osm version='0.5' generator='x'>", ("WARNING", "ROOT", "the version is not 0.6")),
        ("<osm version='0.6'>", ("INFO", "ROOT", "the generator is missing")),
    ],
)
def test_root_rules(spark, tmp_path, head, expected):
    content = M.osm(M.GRID, [], head).replace(b"</osm>", b"</gpx>" if "gpx" in head else b"</osm>")
    assert named(validate.findings(read(spark, tmp_path, m=content))) == {expected: 1}


def test_a_broken_document_is_one_finding(spark, tmp_path):
    maps = read(spark, tmp_path, broken=b"<osm><node", ok=M.OK)
    assert named(validate.findings(maps)) == {("ERROR", "XML", "the document can't be parsed"): 1}


def test_fix_id_rules(spark, tmp_path):
    ways = [
        (1, M.RING_A, {"osmAG:type": "area", "osmAG:areaType": "room", "level": "1"}),
        (2, M.RING_B, {"osmAG:type": "area", "osmAG:areaType": "stairs", "level": "1", "osmAG:parent": "7"}),
        (3, [-2, -6], {"osmAG:type": "passage", "osmAG:from": "1", "osmAG:to": "1", "level": "1"}),
        (4, [-2, -3], {"osmAG:type": "passage", "osmAG:from": "1", "osmAG:to": "x", "level": "1"}),
        ("w5", [-2, -3], {}),
    ]
    found = named(validate.findings(read(spark, tmp_path, m=M.osm(M.GRID, ways)), "fix_id"))
    assert found == {
        ("WARNING", "AREA", "the area type is unknown"): 1,
        ("ERROR", "AREA", "the area is missing"): 1,
        ("ERROR", "PASSAGE", "both ends are the same area"): 1,
        ("ERROR", "PASSAGE", "a reference is no integer"): 1,
        ("ERROR", "WAY", "the id is no integer"): 1,
        ("WARNING", "CROSS_VALIDATION", "a passage's node is on neither area's boundary"): 1,
    }


def test_repair_is_idempotent_and_reports(spark, tmp_path):
    ways = [
        (-10, [-1, -2, -3, -4], {"name": "E1a-F2-01", "osmAG:type": "area"}),
        (-11, M.RING_B, area := M.area("E1_p2", "elevators", level="ground")),
        (-12, [-2, -3], {"osmAG:type": "passage", "osmAG:from": "A", "osmAG:to": "B"}),
        (-13, [-2, -3], {"osmAG:type": "passage", "name": "Big to Small", "osmAG:from": "E1-P2", "osmAG:to": "E1-P2"}),
    ]
    assert area["osmAG:areaType"] == "elevators"
    maps = read(spark, tmp_path, m=M.osm([*M.GRID, "<node id='-30' lat='95' lon='0'/>"], ways, "<osm version='0.5'>"))
    done = repair.repair(maps, moderate=True)
    tags = {r.id: r.tags for r in done.ways.collect()}
    assert tags["-10"]["osmAG:areaType"] == "room" and tags["-10"]["level"] == "2"
    assert (tags["-11"]["name"], tags["-11"]["osmAG:areaType"], tags["-11"]["level"]) == ("E1-P2", "elevator", "0")
    assert tags["-12"]["name"] == "A_to_B" and tags["-13"]["name"] == "big_to_small" and tags["-13"]["level"] == "0"
    assert {r.id: r.nds for r in done.ways.collect()}["-10"] == ["-1", "-2", "-3", "-4", "-1"]
    assert {r.id: r.lat for r in done.nodes.collect()}["-30"] == "90.0"
    counts = repair.fix_counts(done.fixes).first()
    assert counts.safe == 6 and counts.moderate == 8
    assert repair.repair(done.maps, moderate=True).fixes.count() == 0
    safe = repair.repair(maps).fixes
    assert {r.level for r in safe.collect()} == {"SAFE"}
    assert json.loads(repair.fix_report(done.fixes).first().json)["statistics"]["total"] == 14


def test_xml_round_trip(spark, tmp_path):
    maps = read(spark, tmp_path, ok=M.OK)
    text = osm_xml.to_xml(maps.elements).first().xml
    again = Maps(osm_xml.parse(spark.createDataFrame([("again", text.encode())], "map_id string, content binary")))
    rows = lambda m: [(r.id, r.nds, r.tags) for r in m.ways.orderBy("ord").collect()]
    assert rows(again) == rows(maps)
    assert again.nodes.count() == 6


def test_a_map_is_parsed_once(spark, tmp_path):
    (tmp_path / "m.osm").write_bytes(M.BAD)
    maps = Maps.read(spark, [str(tmp_path), str(tmp_path / "m.osm"), f"{tmp_path}/"])
    assert maps.documents.count() == 1
    plan = validate.findings(maps)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "binaryFile" not in plan
    assert named(validate.findings(maps)) == named(validate.findings(read(spark, tmp_path)))


RELATION = b"""<osm version='0.6'><node id='-1' version='7' user='me &amp; you' timestamp='2020' lat='1' lon='2' /><way id='-1' version='3'><nd ref='-1'/></way>
<way id='-2'><nd ref='-1'/><nd ref='-9'/></way><relation id='-4' version='2'><member type='way' ref='-2' role='outer'/><member type='node' ref='-1' role=''/>
<member type='relation' ref='-4' role='self'/><member type='way' ref='-77' role='gone'/><tag k='type' v='site'/></relation></osm>"""


def test_files_of_one_name_stay_apart_and_attributes_stay(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "F1.osm").write_bytes(RELATION)
    maps = Maps.read(spark, str(tmp_path))
    osm_xml.write(maps.elements, f"{tmp_path}/out")
    texts = [r.value for r in spark.read.text(f"{tmp_path}/out", wholetext=True).collect()]
    assert len(texts) == 2 and all(t.count("<osm ") == 1 for t in texts)
    again = Maps(osm_xml.parse(spark.createDataFrame([("again", texts[0].encode())], "map_id string, content binary")))
    node, relation = again.nodes.first(), again.relations.first()
    assert (node.version, node.attributes) == ("7", {"user": "me & you", "timestamp": "2020"}) and relation.version == "2"
    assert relation.members == maps.relations.first().members


def test_members_follow_new_ids(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.osm").write_bytes(RELATION)
    both = merge.concat_maps(Maps.read(spark, str(tmp_path)))
    ways, relations = both.ways.orderBy("ord").collect(), both.relations.orderBy("ord").collect()
    assert [w.id for w in ways] == ["-1", "-2", "-3", "-4"] and [w.nds for w in ways] == [["-1"], ["-1", "-9"], ["-2"], ["-2", "-9"]]
    assert [[tuple(m) for m in r.members] for r in relations] == [[("way", w, "outer"), ("node", n, ""), ("relation", r, "self"), ("way", "-77", "gone")] for w, n, r in (("-2", "-1", "-1"), ("-4", "-2", "-2"))]
    assert both.documents.count() == 1


def floors(n=3, step=0.001):
    out = {}
    for k in range(n):
        d = step * k
        nodes = [(i, round(lat + d, 9), round(lon + d / 2, 9)) for i, lat, lon in M.GRID]
        ways = [(-10, M.RING_A, M.area("E1-P1", "elevator", str(k + 1))), (-11, M.RING_B, M.area("E1-ST-01", "stairs", str(k + 1))), (-12, [-2, -3], M.passage("E1-P1", "E1-ST-01", str(k + 1)))]
        out[f"f{k}"] = M.osm([*nodes, (-40, 31 + d, 121, ("name", "root"))], ways)
    return out


def test_floors_merge_on_shared_lifts(spark, tmp_path):
    maps = read(spark, tmp_path, **floors())
    ids = sorted(r.map_id for r in maps.documents.collect())
    merged = merge.merge_floors(maps, ids[0])
    nodes, ways = merged.nodes.collect(), merged.ways.collect()
    assert len({r.id for r in nodes}) == len(nodes) == 7 + 2 * 6 + 2 * 4
    assert len({r.id for r in ways}) == len(ways) == 9 + 4
    known = {r.id for r in nodes}
    assert all(ref in known for w in ways for ref in w.nds)
    lats = {round(float(r.lat), 7) for r in nodes if r.tags.get("name") != "root"}
    assert lats == {31.0, 31.0001, 31.00005}
    assert merge.passage_errors(merged.ways).first().errors == 0
    tagged = merge.renderer_tags(merged.ways)
    assert merge.renderer_errors(tagged).first().errors == 0
    found = named(validate.findings(merged))
    assert not [k for k in found if k[0] == "ERROR"]
    both = merge.concat_maps(maps)
    assert both.nodes.count() == 21 and both.nodes.select("id").distinct().count() == 21


def test_winding_is_set_once(spark, tmp_path):
    ways = [(-10, M.RING_A[::-1], M.area("r")), (-11, M.RING_B, M.area("s", "structure")), (-12, [-1, -2, -3], M.area("open"))]
    maps = read(spark, tmp_path, m=M.osm(M.GRID, ways))
    turned = {r.id: r.nds for r in merge.winding(maps).collect()}
    assert turned["-10"] == [str(x) for x in M.RING_A] and turned["-11"] == [str(x) for x in M.RING_B[::-1]] and turned["-12"] == ["-1", "-2", "-3"]


def test_elements_are_not_dealt_out_by_map(spark):
    """The elements of a large map don't meet in one task because their map's document is looked up."""
    nodes = spark.createDataFrame([("a", i, f"n{i}", "1", "2") for i in range(9)] + [("b", 1, "n1", "1", None)], "map_id string, ord int, id string, lat string, lon string")
    ways = spark.createDataFrame([("a", 20, "w", ["n1", "n2"], {"osmAG:type": "passage"})], "map_id string, ord int, id string, nds array<string>, tags map<string,string>")
    documents = spark.createDataFrame([("a", "osm", "0.6", "g", None), ("b", "gpx", "0.6", "g", None)], "map_id string, root_tag string, version string, generator string, parse_error string")
    maps = Maps(osm_xml.elements_of(nodes, ways, documents))  # Spark doesn't know its size
    v = validate.views(maps)
    plan = v.ways._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(map_id" not in plan
    assert v.ways.count() == 1 and v.nodes.count() == 9 and v.good.collect() == [("a",)]
