"""Maps in parts, against whole documents."""

from floorwise.sources import osm_xml
from floorwise.sources.osm_xml import Maps, elements_of


def test_parts_are_parsed_as_the_whole(spark, monkeypatch):
    monkeypatch.setattr(osm_xml, "PART", 3)
    nodes = spark.createDataFrame([(m, i, f"n{i}", "1", "<2>", {"k": f'"{i}&'}) for m in ("a", "b") for i in range(11)], "map_id string, ord int, id string, lat string, lon string, tags map<string,string>")
    ways = spark.createDataFrame([("a", 20 + i // 4, f"w{i}", ["n1", "n2"], {"name": "R"}) for i in range(8)], "map_id string, ord int, id string, nds array<string>, tags map<string,string>")
    made = elements_of(nodes, ways)
    parts = osm_xml.to_parts(made).cache()
    whole = osm_xml.parse(osm_xml.to_xml(made).selectExpr("map_id", "xml AS content"))
    listed = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    found = osm_xml.parse_parts(parts)
    assert listed(found) == listed(whole) and found.count() == 11 * 2 + 8 + 2
    assert parts.count() >= 11 and max(r.content.count("<nd ") // 2 + r.content.count("<node") for r in parts.collect()) <= 3
    by_map = {m: "\n".join(r.content for r in sorted(parts.where(f"map_id = '{m}'").collect(), key=lambda r: r.part)) for m in ("a", "b")}
    assert {r.map_id: r.xml.split("\n", 2)[2].removesuffix("\n</osm>\n") for r in osm_xml.to_xml(made).collect()} == by_map
    assert Maps(found).documents.count() == 2
