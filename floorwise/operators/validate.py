"""Validation of area-graph maps in the two dialects, as one plan over all maps.

``semantic`` maps refer by name and have string ids; ``fix_id`` maps refer by integer id.
Every rule is a DataFrame of findings (map_id, ord, level, category, message, element_id,
details); their union is the report. A document with a fatal error yields that error alone.

First-match lookups take the first area of a name or id in document order, blank levels
included. A level counts as missing or empty alike where it is read, but not where its
presence is required.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.functions.scalars import name_pattern
from floorwise.functions.tags import has_tag, tag
from floorwise.sources.osm_xml import Maps
from floorwise.sources.scratch import Written

#: Vocabularies of the dialects.
AREA_TYPES = {"semantic": ["room", "corridor", "structure", "elevator", "stairs"], "fix_id": ["room", "corridor", "structure", "elevator", "stair"]}
REQUIRED = {
    "semantic": {"area": ["name", "osmAG:areaType", "level"], "passage": ["name", "osmAG:from", "osmAG:to", "level"]},
    "fix_id": {"area": ["osmAG:areaType", "level"], "passage": ["osmAG:from", "osmAG:to", "level"]},
}
ACTIONS = ["modify", "delete", "create"]
LEVELS = (-10, 50)
SEVERITIES = ["ERROR", "WARNING", "INFO"]


FINDING = "struct<level:string,category:string,message:string,details:map<string,string>>"


def rule(when: Column, level: str, category: str, message: str, /, **details: Column) -> Column:
    """A finding where ``when`` holds, else null."""
    values = F.create_map(*(x for k, v in details.items() for x in (F.lit(k), v.cast("string")))) if details else F.create_map().cast("map<string,string>")
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(message).alias("message"), values.alias("details")))


def checked(df: DataFrame, rules: list[Column], element: Column | None = None) -> DataFrame:
    """Findings of all rules over ``df`` (with map_id and ord) in one pass."""
    found = F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull()))
    rows = df.select("map_id", F.col("ord").cast("int").alias("ord"), (F.lit(None).cast("string") if element is None else element).alias("element_id"), found.alias("f"))
    return rows.select("map_id", "ord", "f.level", "f.category", "f.message", "element_id", F.lit(None).cast("int").alias("line_number"), "f.details")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Views:
    """Typed views of the maps that have no fatal error."""

    documents: DataFrame
    good: DataFrame
    nodes: DataFrame
    ways: DataFrame
    areas: DataFrame
    passages: DataFrame
    vertical: DataFrame
    cross_level: DataFrame


def usable_ids(df: DataFrame, dialect: str) -> Column:
    return F.col("id").isNotNull() & (F.col("id").try_cast("long").isNotNull() if dialect == "fix_id" else F.lit(True))


def views(maps: Maps, dialect: str = "semantic") -> Views:
    """Classified ways; rows that lack what they need drop out, of repeated ids the last stays in lookups.

    The list of maps is a table of its own: its size is known, so Spark deals elements out by map only where maps are many.
    """
    documents = maps.documents
    good = Written(documents.where("parse_error is null and root_tag = 'osm' and version is not null").select("map_id"), "good", keep=True).df
    nodes = maps.nodes.join(good, "map_id", "left_semi").where(usable_ids(maps.nodes, dialect) & F.col("lat").try_cast("double").isNotNull() & F.col("lon").try_cast("double").isNotNull())
    nodes = nodes.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "action": F.coalesce("action", F.lit("modify")), "visible": F.coalesce(F.lower("visible") == "true", F.lit(True))})
    ways = maps.ways.join(good, "map_id", "left_semi").where(usable_ids(maps.ways, dialect))
    kind, name, level = tag("osmAG:type"), tag("name"), tag("level")
    ways = ways.withColumns({"action": F.coalesce("action", F.lit("modify")), "kind": kind, "name": name, "level": level, "area_type": tag("osmAG:areaType"), "from": tag("osmAG:from"), "to": tag("osmAG:to"), "parent": tag("osmAG:parent")})
    areas, passages = ways.where("kind = 'area'"), ways.where("kind = 'passage'")
    stairs = AREA_TYPES[dialect][-1]
    cross = passages.where("`from` <> '' and `from` = `to`")
    return Views(documents, good, nodes, ways, areas, passages, areas.where(F.col("area_type").isin("elevator", stairs)), cross)


def first_areas(areas: DataFrame, key: str) -> DataFrame:
    """(map_id, key, level) of the first area with each key."""
    return areas.where(F.col(key) != "").groupBy("map_id", F.col(key).alias("key")).agg(F.min_by("level", "ord").alias("key_level"))


def document_rules(maps: Maps) -> list[DataFrame]:
    parsed, osm = F.col("parse_error").isNull(), F.col("root_tag") == "osm"
    right = parsed & osm & F.col("version").isNotNull()
    rules = [
        rule(~parsed, "ERROR", "XML", "the document can't be parsed", error=F.col("parse_error")),
        rule(parsed & ~osm, "ERROR", "ROOT", "the root element is not osm", root=F.col("root_tag")),
        rule(parsed & osm & F.col("version").isNull(), "ERROR", "ROOT", "the version is missing"),
        rule(right & (F.col("version") != "0.6"), "WARNING", "ROOT", "the version is not 0.6", version=F.col("version")),
        rule(right & F.col("generator").isNull(), "INFO", "ROOT", "the generator is missing"),
    ]
    return [checked(maps.documents.withColumn("ord", F.lit(0)), rules)]


def parse_rules(maps: Maps, good: DataFrame, dialect: str) -> list[DataFrame]:
    """What elements of ``good`` maps lack to be read at all."""
    rows = maps.elements.where("kind in ('node', 'way')").join(good, "map_id", "left_semi")
    node, number = F.col("kind") == "node", lambda c: F.col(c).try_cast("double").isNotNull()
    lacks = lambda c, of: rule(of & F.col(c).isNull(), "ERROR", "NODE", "a required attribute is missing", attribute=F.lit(c))
    whole = node & F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rules = [
        *(lacks(c, node) for c in ("id", "lat", "lon")),
        rule(whole & ~(number("lat") & number("lon")), "ERROR", "NODE", "a coordinate is no number", lat=F.col("lat"), lon=F.col("lon")),
        rule(~node & F.col("id").isNull(), "ERROR", "WAY", "the id is missing"),
    ]
    if dialect == "fix_id":
        odd = F.col("id").isNotNull() & F.col("id").try_cast("long").isNull()
        rules += [rule(odd & (F.col("kind") == k), "ERROR", k.upper(), "the id is no integer") for k in ("node", "way")]
        odd_refs = F.filter("nds", lambda r: r.try_cast("long").isNull())
        rules.append(rule(~node & (F.size(odd_refs) > 0), "ERROR", "WAY", "a reference is no integer", refs=F.array_join(odd_refs, ",")))
    return [checked(rows, rules, F.col("id"))]


def element_rules(v: Views, dialect: str) -> list[DataFrame]:
    """Rules that one element decides: one pass over nodes and one over ways."""
    of_nodes = [
        rule(~F.col("lat").between(-90, 90), "ERROR", "NODE", "the latitude is out of range", lat=F.col("lat")),
        rule(~F.col("lon").between(-180, 180), "ERROR", "NODE", "the longitude is out of range", lon=F.col("lon")),
        rule(~F.col("action").isin(ACTIONS), "WARNING", "NODE", "the action is unknown", action=F.col("action")),
    ]
    kind, level, number, size = F.col("kind"), F.col("level"), F.col("level").try_cast("int"), F.size("nds")
    area, passage = kind == "area", kind == "passage"
    unknown = ~area & ~passage & ((kind != "") if dialect == "semantic" else F.lit(True))
    lacks = lambda of, own, t: rule(of & ~has_tag(t), "ERROR", own, "a required tag is missing", tag=F.lit(t))
    of_ways = [
        rule(unknown, "WARNING", "CLASSIFICATION", "the way's type is unknown", type=kind),
        *(lacks(area, "AREA", t) for t in REQUIRED[dialect]["area"]),
        rule(area & (F.col("area_type") != "") & ~F.col("area_type").isin(AREA_TYPES[dialect]), "WARNING", "AREA", "the area type is unknown", type=F.col("area_type")),
        rule(area & (level != "") & number.isNull(), "ERROR", "AREA", "the level is no integer", level=level),
        rule(area & ~number.between(*LEVELS), "WARNING", "AREA", "the level is out of range", level=level),
        rule(area & (size < 3), "ERROR", "AREA", "an area needs three nodes", nodes=size),
        rule(area & (size >= 3) & (F.get("nds", F.lit(0)) != F.get("nds", size - 1)), "ERROR", "AREA", "the ring is not closed"),
        *(lacks(passage, "PASSAGE", t) for t in REQUIRED[dialect]["passage"]),
        rule(passage & (size != 2), "ERROR", "PASSAGE", "a passage needs two nodes", nodes=size),
    ]
    cross = passage & (F.col("from") != "") & (F.col("from") == F.col("to"))
    if dialect == "semantic":
        of_ways += [
            rule((area | passage) & (F.col("name") == ""), "ERROR", "SEMANTIC_NAMING", "the name is missing"),
            rule(passage & (F.col("from") == "") & (F.col("to") == ""), "ERROR", "PASSAGE", "neither end has an area"),
            rule(cross & (level == ""), "ERROR", "CROSS_LEVEL_PASSAGE", "the level is missing"),
            rule(cross & (level != "") & number.isNull(), "ERROR", "CROSS_LEVEL_PASSAGE", "the level is no integer", level=level),
        ]
    else:
        of_ways.append(rule(cross, "ERROR", "PASSAGE", "both ends are the same area", area=F.col("from")))
    return [checked(v.nodes, of_nodes, F.col("id")), checked(v.ways, of_ways, F.col("id"))]


def _own(kind: Column) -> Column:
    return F.when(kind == "area", "AREA").otherwise("PASSAGE")


def _as_findings(df: DataFrame, level: str, category: Column, message: Column, /, **details: Column) -> DataFrame:
    values = F.create_map(*(x for k, v in details.items() for x in (F.lit(k), v.cast("string"))))
    return df.select("map_id", F.col("ord").cast("int").alias("ord"), F.lit(level).alias("level"), category.alias("category"), message.alias("message"), F.col("id").alias("element_id"), F.lit(None).cast("int").alias("line_number"), values.alias("details"))


def _ends(v: Views) -> DataFrame:
    """References to areas by name or id: parents of areas, both ends of passages."""
    end = lambda name, when: F.struct(F.lit(name).alias("end"), F.when(when, F.col(name)).alias("target"))
    area, passage = F.col("kind") == "area", F.col("kind") == "passage"
    rows = v.ways.where(area | passage).select("map_id", "ord", "id", "kind", "level", (F.col("from") == F.col("to")).alias("same"), F.explode(F.array(end("parent", area), end("from", passage), end("to", passage))).alias("e"))
    return rows.select("map_id", "ord", "id", "kind", "level", "same", "e.end", "e.target").where("target <> ''")


def reference_rules(v: Views, dialect: str) -> list[DataFrame]:
    """References of ways to nodes, and of passages and children to areas."""
    known = v.nodes.select("map_id", F.col("id").alias("ref")).distinct()
    refs = v.ways.where("kind in ('area', 'passage')").select("map_id", "ord", "id", "kind", F.explode("nds").alias("ref")).join(known, ["map_id", "ref"], "left_anti")
    found = [_as_findings(refs, "ERROR", _own(F.col("kind")), F.lit("a node is missing"), ref=F.col("ref"))]
    key = "name" if dialect == "semantic" else "id"
    targets = v.areas.where(F.col(key) != "").select("map_id", F.col(key).alias("target")).distinct()
    missing = _ends(v).join(targets, ["map_id", "target"], "left_anti")
    if dialect == "semantic":
        category, message = F.lit("SEMANTIC_REFERENCE"), F.lit("the area is missing")
    else:
        category = _own(F.col("kind"))
        message = F.when(F.col("target").try_cast("long").isNull(), "a reference is no integer").otherwise("the area is missing")
    found.append(_as_findings(missing, "ERROR", category, message, end=F.col("end"), target=F.col("target")))
    return found


def level_rules(v: Views, dialect: str) -> list[DataFrame]:
    """Levels against those of the areas referred to, the first of each name or id."""
    firsts = first_areas(v.areas, "name" if dialect == "semantic" else "id").withColumnRenamed("key", "target")
    category = F.lit("LEVEL_CONSISTENCY" if dialect == "semantic" else "CROSS_VALIDATION")
    ends = _ends(v).where("`end` = 'parent' or not same") if dialect == "semantic" else _ends(v).where("`end` = 'parent'")
    differ = ends.join(firsts, ["map_id", "target"]).where("level <> '' and key_level <> '' and level <> key_level")
    message = F.when(F.col("end") == "parent", "the level differs from the parent's").otherwise(F.concat(F.lit("the level differs from the "), "end", F.lit(" area's")))
    found = [_as_findings(differ, "WARNING", category, message, level=F.col("level"), area_level=F.col("key_level"))]
    if dialect == "fix_id":  # a passage's nodes lie on the boundary of one of its areas
        rings = v.areas.groupBy("map_id", "id").agg(F.max_by("nds", "ord").alias("nds"))
        of = lambda end: rings.select("map_id", F.col("id").alias(end), F.col("nds").alias(f"{end}_nds"))
        joined = v.passages.join(of("from"), ["map_id", "from"]).join(of("to"), ["map_id", "to"])
        off = joined.select("map_id", "ord", "id", "from_nds", "to_nds", F.explode("nds").alias("ref")).where(~F.array_contains("from_nds", F.col("ref")) & ~F.array_contains("to_nds", F.col("ref")))
        found.append(_as_findings(off, "WARNING", category, F.lit("a passage's node is on neither area's boundary"), ref=F.col("ref")))
    return found


def vertical_rules(v: Views) -> list[DataFrame]:
    """Lifts and stairs over several levels, and the passages inside them."""
    named = v.vertical.where("name <> ''").select("map_id", "ord", "id", "name", "level")
    per_level = Window.partitionBy("map_id", "name", "level").orderBy("ord")
    per_name = Window.partitionBy("map_id", "name")
    marked = named.withColumns({"nth": F.row_number().over(per_level), "n": F.count("*").over(per_name)})
    rules = [
        rule(F.col("n") < 2, "WARNING", "VERTICAL_TRANSPORT", "it is on one level only", name=F.col("name")),
        rule(F.col("nth") > 1, "ERROR", "VERTICAL_TRANSPORT", "it is on a level more than once", name=F.col("name"), level=F.col("level")),
    ]
    facilities = named.groupBy("map_id", F.col("name").alias("from")).agg(F.collect_set(F.col("level").try_cast("int")).alias("levels"))  # the levels of one facility
    number = F.col("level").try_cast("int")
    cross = v.cross_level.select("map_id", "ord", "id", "from", "level").join(facilities, ["map_id", "from"], "left")
    beside = F.array_contains("levels", number - 1) | F.array_contains("levels", number + 1)
    of_cross = [
        rule(F.col("levels").isNull(), "WARNING", "CROSS_LEVEL_PASSAGE", "it joins no lift or stairs", area=F.col("from")),
        rule(F.col("levels").isNotNull() & number.isNotNull() & ~beside, "WARNING", "CROSS_LEVEL_PASSAGE", "no adjacent level has the facility", area=F.col("from")),
    ]
    return [checked(marked, rules, F.col("id")), checked(cross, of_cross, F.col("id"))]


def findings(maps: Maps, dialect: str = "semantic") -> DataFrame:
    """All findings of all maps. Land the elements as Parquet first when maps are many."""
    v = views(maps, dialect)
    parts = [*document_rules(maps), *parse_rules(maps, v.good, dialect), *element_rules(v, dialect), *reference_rules(v, dialect), *level_rules(v, dialect)]
    if dialect == "semantic":
        parts += vertical_rules(v)
    return union(parts)


def statistics(maps: Maps, dialect: str = "semantic") -> DataFrame:
    """One row for each map: counts, and maps by level, pattern and area."""
    v = views(maps, dialect)
    level = F.when(F.col("level") == "", "unknown").otherwise(F.col("level"))
    out = maps.documents.select("map_id")

    def counted(df: DataFrame, name: str) -> None:
        nonlocal out
        out = out.join(df.groupBy("map_id").agg(F.count("*").alias(name)), "map_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))

    def mapped(df: DataFrame, key: Column, value: Column, name: str) -> None:
        nonlocal out
        pairs = df.groupBy("map_id", key.alias("k")).agg(value.alias("v")).groupBy("map_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))
        out = out.join(pairs, "map_id", "left")

    for df, name in ((v.nodes, "total_nodes"), (v.ways, "total_ways"), (v.areas, "total_areas"), (v.passages, "total_passages"), (v.vertical, "total_vertical_transport"), (v.cross_level, "total_cross_level_passages")):
        counted(df, name)
    mapped(v.areas, level, F.count("*"), "areas_by_level")
    mapped(v.vertical, level, F.count("*"), "vertical_transport_by_level")
    mapped(union([v.areas, v.passages]).where("name <> ''"), name_pattern(F.col("name"), F.col("kind"), F.col("area_type")), F.count("*"), "semantic_name_patterns")
    mapped(v.areas, level, F.avg(F.size("nds")), "avg_nodes_per_area_by_level")
    kind = F.when(F.lower("from").rlike("elevator|lift|-p\\d"), "elevator").when(F.lower("from").rlike("stair|st-"), "stairs").otherwise("unknown")
    mapped(v.cross_level, kind, F.count("*"), "cross_level_passages_by_type")
    linked = v.passages.where("`from` <> '' and `to` <> ''")
    edges = linked.select("map_id", F.col("from").alias("a"), F.col("to").alias("b")).union(linked.select("map_id", F.col("to"), F.col("from")))
    degrees = edges.groupBy("map_id", "a").agg(F.count_distinct("b").alias("n"))
    mapped(degrees, F.col("a"), F.max("n"), "area_connections")
    return out.join(degrees.groupBy("map_id").agg(F.avg("n").alias("avg_connections_per_area")), "map_id", "left")


def summary(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Issues by severity for each map, and whether it passed."""
    by = found.groupBy("map_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("level") == s).alias(s) for s in SEVERITIES))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return documents.select("map_id").join(by, "map_id", "left").select("map_id", zero("n").alias("total_issues"), zero("ERROR").alias("errors"), zero("WARNING").alias("warnings"), zero("INFO").alias("infos"), (zero("ERROR") == 0).alias("passed"))


def batch_summary(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg(F.col("passed").cast("int")) * 100, 1).alias("success_rate"))


def report_lines(found: DataFrame, per_group: int = 10) -> DataFrame:
    """The first findings of each severity and category, in report order."""
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("map_id", "level", "category").orderBy("ord", "message", "element_id"))).where(F.col("n") <= per_group)
    return ranked.orderBy("map_id", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("level")), "category", "n")


def report(found: DataFrame, stats: DataFrame, summaries: DataFrame) -> DataFrame:
    """(map_id, json): statistics, results and summary of each map."""
    results = found.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level", "category", "message", "element_id", "line_number", F.to_json("details").alias("details")))).alias("results"))
    joined = stats.join(summaries, "map_id", "left").join(results, "map_id", "left")
    own = F.struct(*(c for c in stats.columns if c != "map_id"))
    return joined.select("map_id", F.to_json(F.struct(own.alias("statistics"), F.col("results"), F.struct(*(c for c in summaries.columns if c != "map_id")).alias("summary"))).alias("json"))
