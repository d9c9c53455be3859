"""Merging floors: anchors, robust offsets, id allocation, vertical passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorwise.functions import rings
from floorwise.functions.scalars import passage_suffix
from floorwise.functions.tags import has_tag, tag, upserted
from floorwise.operators.ids import numbered
from floorwise.sources.osm_xml import Maps, elements_of
from floorwise.sources.scratch import Written

#: Weights of anchors by type.
WEIGHTS = {"elevator": 2.0, "stairs": 1.5}
SIGMAS = 2.0
POINT = "struct<x:double,y:double>"


def ring_points(ways: DataFrame, nodes: DataFrame, out: str = "ring") -> DataFrame:
    """``ways`` with the coordinates of their nodes in order, x east and y north; missing nodes are passed over."""
    known = nodes.select("map_id", F.col("id").alias("ref"), rings.point(F.col("lon").try_cast("double"), F.col("lat").try_cast("double")).alias("p")).dropDuplicates(["map_id", "ref"])
    placed = ways.select("map_id", "ord", F.posexplode("nds").alias("pos", "ref")).join(known, ["map_id", "ref"])
    of_way = placed.groupBy("map_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias(out))
    return ways.join(of_way, ["map_id", "ord"], "left").withColumn(out, F.coalesce(out, F.array().cast(f"array<{POINT}>")))


def anchors(maps: Maps) -> DataFrame:
    """Lifts and stairs with a name and a level, with their rings."""
    kind, level = tag("osmAG:areaType"), tag("level")
    named = maps.ways.where(kind.isin("elevator", "stairs", "stair") & (tag("osmAG:type") == "area") & (tag("name") != "") & (level != ""))
    named = named.select("map_id", "ord", "id", "nds", tag("name").alias("name"), level.alias("level"), F.when(kind == "elevator", "elevator").otherwise("stairs").alias("type"))
    return ring_points(named, maps.nodes)


def offset_details(reference: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean vertex offsets of anchors of one name on different levels, with ``pairs``, the number of pairs of anchors of these rings; ``targets`` keep their map.

    Anchors of one name, type, level and ring are one row, so pairs are made of different rings only.
    """
    merged = lambda df, *by: df.groupBy(*by, "name", "type", "level", "ring").agg(F.count("*").alias("_n"))
    r = merged(reference).select("name", "type", F.col("level").alias("ref_level"), F.col("ring").alias("ref_ring"), F.col("_n").alias("_r"))
    t = merged(targets.where(F.size("ring") > 0), "map_id").groupBy("map_id", "name", F.col("level").alias("target_level"), F.col("ring").alias("target_ring")).agg(F.sum("_n").alias("_t"))
    joined = t.join(r, "name").where("ref_level <> target_level")
    n = F.least(F.size("ref_ring"), F.size("target_ring"))
    mean = lambda c: rings.total(F.zip_with(F.slice("ref_ring", F.lit(1), n), F.slice("target_ring", F.lit(1), n), lambda a, b: a[c] - b[c])) / n
    return joined.where(n > 0).select("map_id", "name", "type", "ref_level", "target_level", n.alias("vertex_count"), mean("y").alias("lat_offset"), mean("x").alias("lon_offset"), (F.col("_r") * F.col("_t")).alias("pairs"))


def offsets(details: DataFrame) -> DataFrame:
    """(map_id, lat_offset, lon_offset, n_names): pairs within two standard deviations on both axes, all
    pairs if fewer than half are; the mean of each name, then the mean weighted by type. A row counts as its ``pairs``."""
    details = Written(details, "details").df
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("pairs"))
    average = lambda c: F.sum(F.col(c) * F.col("pairs")) / F.sum(known(c))
    axes = ("lat_offset", "lon_offset")
    means = details.groupBy("map_id").agg(F.sum("pairs").alias("n"), *(average(c).alias(f"m_{c}") for c in axes))
    centred = details.join(means, "map_id")
    spread = centred.groupBy("map_id").agg(*(F.sqrt(F.sum(F.pow(F.col(c) - F.col(f"m_{c}"), 2) * F.col("pairs")) / F.sum(known(c))).alias(f"s_{c}") for c in axes))
    inside = reduce(Column.__and__, (F.abs(F.col(c) - F.col(f"m_{c}")) < SIGMAS * F.col(f"s_{c}") for c in axes))
    marked = centred.join(spread, "map_id").withColumn("inside", inside)
    kept = marked.groupBy("map_id").agg(F.sum(F.when(F.col("inside"), F.col("pairs")).otherwise(0)).alias("kept"))
    used = marked.join(kept, "map_id").where("inside or kept * 2 < n")
    named = used.groupBy("map_id", "name", "type").agg(average("lat_offset").alias("lat"), average("lon_offset").alias("lon"))
    weight = reduce(lambda w, kv: w.when(F.col("type") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    mean = lambda c: F.sum(F.col(c) * weight) / F.sum(weight)
    return named.groupBy("map_id").agg(mean("lat").alias("lat_offset"), mean("lon").alias("lon_offset"), F.count("*").alias("n_names"))


def shifted(nodes: DataFrame, by: DataFrame) -> DataFrame:
    """Nodes moved by their map's offset, to 12 decimals; maps without one stay."""
    joined = nodes.join(by.select("map_id", "lat_offset", "lon_offset"), "map_id", "left")
    moved = lambda c: F.coalesce(F.format_string("%.12f", F.col(c).try_cast("double") + F.col(f"{c}_offset")), F.col(c))
    return joined.select(*(F.when(F.col("lat_offset").isNotNull(), moved(c)).otherwise(F.col(c)).alias(c) if c in ("lat", "lon") else F.col(c) for c in nodes.columns))


def lowest_ids(elements: DataFrame) -> DataFrame:
    """(map_id, kind, lowest): the most negative id of each kind, zero without negative ones."""
    return elements.groupBy("map_id", "kind").agg(F.least(F.lit(0), F.min(F.col("id").try_cast("long"))).alias("lowest"))


def renumbered(elements: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """Elements with ids that count down by kind, from the ``lowest`` of ``low`` (kind, lowest),
    and references of ways and relations that follow; of a repeated id the last is meant.
    Numbers are given without gathering a kind in one task."""
    rows = numbered(elements.select("kind", "map_id", "ord", "id"), ["kind", "map_id", "ord"], "n")
    firsts = rows.groupBy("kind").agg(F.min("n").alias("first"))
    if low is not None:
        firsts = firsts.join(low, "kind", "left")
    base = F.coalesce("lowest", F.lit(0)) if low is not None else F.lit(0)
    ids = rows.join(firsts, "kind").select("kind", "map_id", "ord", "id", (base - (F.col("n") - F.col("first") + 1)).cast("string").alias("new_id"))
    ids = Written(ids, "ids").df
    known = ids.groupBy("map_id", "kind", F.col("id").alias("ref")).agg(F.max_by("new_id", "ord").alias("new_ref"))
    node_ids = known.where("kind = 'node'").drop("kind")
    refs = elements.where("kind = 'way'").select("map_id", "kind", "ord", F.posexplode("nds").alias("pos", "ref")).join(node_ids, ["map_id", "ref"], "left")
    nds = refs.groupBy("map_id", "kind", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new_ref", "ref").alias("r")))), lambda s: s["r"]).alias("new_nds"))
    listed = elements.where("kind = 'relation'").select("map_id", "kind", "ord", F.posexplode("members").alias("pos", "m"))
    parts = listed.select("map_id", "kind", "ord", "pos", "m.type", "m.ref", "m.role").join(known.withColumnRenamed("kind", "type"), ["map_id", "type", "ref"], "left")
    member = F.struct("type", F.coalesce("new_ref", "ref").alias("ref"), "role")
    members = parts.groupBy("map_id", "kind", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", member.alias("m")))), lambda s: s["m"]).alias("new_members"))
    joined = elements.join(ids.drop("id"), ["map_id", "kind", "ord"])
    joined = joined.join(nds, ["map_id", "kind", "ord"], "left").join(members, ["map_id", "kind", "ord"], "left")
    return joined.withColumns({"id": F.col("new_id"), "nds": F.coalesce("new_nds", "nds"), "members": F.coalesce("new_members", "members")}).drop("new_id", "new_nds", "new_members")


def merge_floors(maps: Maps, reference: str, merged_id: str = "merged", keep_roots: bool = False, min_matches: int = 1) -> Maps:
    """One map of the reference floor and all others, aligned by shared lifts and stairs.

    New ids of every kind go down from the reference's lowest. Floors with fewer than
    ``min_matches`` shared names stay out; root nodes of other floors do unless kept.
    """
    found = Written(anchors(maps), "anchors").df
    by = offsets(offset_details(found.where(F.col("map_id") == reference), found.where(F.col("map_id") != reference))).where(F.col("n_names") >= min_matches)
    by = Written(by.select("map_id", "lat_offset", "lon_offset"), "offsets").df
    elements = maps.elements.where("kind <> 'document'")
    own, rest = elements.where(F.col("map_id") == reference), elements.where(F.col("map_id") != reference)
    if not keep_roots:
        rest = rest.where(~((F.col("kind") == "node") & (tag("name") == "root")))
    joined = rest.join(by, "map_id")
    moved = lambda c: F.format_string("%.12f", F.col(c).try_cast("double") + F.col(f"{c}_offset"))
    rest = joined.withColumns({c: F.when(F.col("kind") == "node", moved(c)) for c in ("lat", "lon")}).drop("lat_offset", "lon_offset")
    low = own.groupBy("kind").agg(F.least(F.lit(0), F.min(F.col("id").try_cast("long"))).alias("lowest"))
    both = own.unionByName(renumbered(rest.select(own.columns), low)).withColumn("_later", F.col("map_id") != reference)
    placed = numbered(both.withColumnRenamed("ord", "_ord"), ["_later", "map_id", "_ord"], "ord").withColumn("ord", F.col("ord").cast("int")).drop("_later", "_ord")
    document = maps.documents.where(F.col("map_id") == reference).withColumns({"kind": F.lit("document"), "ord": F.lit(0)})
    merged = placed.unionByName(document, allowMissingColumns=True).withColumn("map_id", F.lit(merged_id))
    whole = with_vertical_passages(Maps(Written(merged.select(maps.elements.columns), "merged").df))
    return Maps(Written(whole.elements, "merged").df)


def concat_maps(maps: Maps, merged_id: str = "merged") -> Maps:
    """All maps in one, without alignment; ids are numbered down from -1. The document is the first map's by id."""
    merged = renumbered(maps.elements.where("kind <> 'document'"))
    placed = numbered(merged.withColumnRenamed("ord", "_ord"), ["map_id", "_ord"], "ord").withColumn("ord", F.col("ord").cast("int")).drop("_ord").withColumn("map_id", F.lit(merged_id))
    own = [c for c in maps.documents.columns if c != "map_id"]
    document = maps.documents.groupBy().agg(F.min_by(F.struct(*own), "map_id").alias("d")).where("d is not null").select("d.*")
    document = document.withColumns({"map_id": F.lit(merged_id), "kind": F.lit("document"), "ord": F.lit(0)})
    return Maps(Written(placed.unionByName(document, allowMissingColumns=True).select(maps.elements.columns), "merged").df)


def vertical_passages(maps: Maps) -> tuple[DataFrame, DataFrame]:
    """New nodes and ways that join a lift or stairs with itself one listed level up.

    Levels sort as numbers, or as text where one of a facility's levels is no number. Both
    nodes lie at the centre of the lower area's bounding box; the name is deterministic.
    """
    found = Written(anchors(maps).where(F.size("ring") > 0), "anchors").df
    numbers = found.groupBy("map_id", "type", "name").agg(F.bool_and(F.col("level").try_cast("double").isNotNull()).alias("_numeric"))
    ordered = found.join(numbers, ["map_id", "type", "name"]).withColumn("_n", F.when(F.col("_numeric"), F.col("level").try_cast("double")))
    up = Window.partitionBy("map_id", "type", "name").orderBy("_n", "level", "ord")
    pairs = ordered.select("map_id", "type", "name", "level", "ring", F.lead("level").over(up).alias("upper")).where("upper is not null")
    suffix = passage_suffix(F.col("type"), F.col("name"), F.col("level"), F.col("upper"))
    pairs = pairs.select("map_id", "type", "name", "level", "upper", rings.bbox_centre(F.col("ring")).alias("c"), F.concat("type", F.lit("_passage_"), suffix).alias("passage"))
    lows = Written(lowest_ids(maps.elements), "lows").df
    low = lambda kind: lows.where(F.col("kind") == kind).select("map_id", F.col("lowest").alias(f"_{kind}"))
    last = maps.elements.groupBy("map_id").agg(F.max("ord").alias("_ord"))
    counted = pairs.withColumn("n", F.row_number().over(Window.partitionBy("map_id").orderBy("type", "name", "level", "upper")))
    counted = counted.join(low("node"), "map_id", "left").join(low("way"), "map_id", "left").join(last, "map_id").na.fill(0, ["_node", "_way"])
    ids = F.array(*((F.col("_node") - 2 * F.col("n") + k).cast("string") for k in (1, 0)))
    counted = Written(counted.withColumn("nds", ids), "passages").df
    nodes = counted.select("map_id", (F.col("_ord") + 3 * F.col("n") - 2).cast("int").alias("ord"), F.col("c"), F.posexplode("nds").alias("k", "id"))
    nodes = nodes.select("map_id", (F.col("ord") + F.col("k")).cast("int").alias("ord"), "id", F.format_string("%.12f", F.col("c.y")).alias("lat"), F.format_string("%.12f", F.col("c.x")).alias("lon"), F.lit("modify").alias("action"), F.lit("true").alias("visible"), F.create_map().cast("map<string,string>").alias("tags"))
    tags = F.create_map(*(x for k, v in {"name": F.col("passage"), "osmAG:type": F.lit("passage"), "osmAG:from": F.col("name"), "osmAG:to": F.col("name"), "level": F.col("level"), "indoor": F.lit("yes"), "osmAG:areaType": F.col("type")}.items() for x in (F.lit(k), v)))
    ways = counted.select("map_id", (F.col("_ord") + 3 * F.col("n")).cast("int").alias("ord"), (F.col("_way") - F.col("n")).cast("string").alias("id"), F.lit("modify").alias("action"), F.lit("true").alias("visible"), "nds", tags.alias("tags"))
    return nodes, ways


def with_vertical_passages(maps: Maps) -> Maps:
    nodes, ways = vertical_passages(maps)
    return Maps(elements_of(maps.nodes.unionByName(nodes, allowMissingColumns=True), maps.ways.unionByName(ways, allowMissingColumns=True), maps.documents, maps.relations))


def passage_errors(ways: DataFrame) -> DataFrame:
    """Vertical passages that lack an end, a level, a name or their two nodes, by map."""
    vertical = tag("name").rlike(r"^(elevator|stairs)_passage_\d{4}") | ((tag("osmAG:from") != "") & (tag("osmAG:from") == tag("osmAG:to")))
    problems = sum((F.when(c, 1).otherwise(0) for c in (tag("osmAG:from") == "", tag("osmAG:to") == "", tag("level") == "", tag("name") == "", F.size("nds") != 2)), F.lit(0))
    return ways.where((tag("osmAG:type") == "passage") & vertical).groupBy("map_id").agg(F.sum(problems).alias("errors"))


def renderer_tags(ways: DataFrame) -> DataFrame:
    """Doors on ordinary passages, room tags on lifts and stairs."""
    vertical = tag("name").rlike(r"^(elevator|stairs)_passage_\d{4}") | ((tag("osmAG:from") != "") & (tag("osmAG:from") == tag("osmAG:to")))
    kind = tag("osmAG:areaType")
    door = (tag("osmAG:type") == "passage") & ~vertical
    room = F.when((tag("osmAG:type") == "area") & (kind == "elevator"), "elevator").when((tag("osmAG:type") == "area") & kind.isin("stairs", "stair"), "stairs")
    return ways.withColumn("tags", upserted(F.col("tags"), {"indoor": F.when(door, "door"), "door": F.when(door, "yes"), "room": room}))


def renderer_errors(ways: DataFrame) -> DataFrame:
    """Ways whose tags ``renderer_tags`` would still change, by map."""
    return ways.join(renderer_tags(ways).select("map_id", "ord", F.col("tags").alias("_new")), ["map_id", "ord"]).groupBy("map_id").agg(F.count_if(F.array_sort(F.map_entries("tags")) != F.array_sort(F.map_entries("_new"))).alias("errors"))


def winding(maps: Maps) -> DataFrame:
    """Ways with rooms counter-clockwise and structures clockwise; open rings and rings of
    under four references stay."""
    turned = ring_points(maps.ways, maps.nodes)
    kind = tag("osmAG:areaType")
    usable = (F.size("nds") >= 4) & (F.element_at("nds", 1) == F.element_at("nds", -1)) & (F.size("ring") == F.size("nds"))
    turn = rings.signed_area(F.col("ring"))
    wrong = F.when(kind == "structure", turn > 0).when(kind == "room", turn < 0).otherwise(False)
    return turned.withColumn("nds", F.when(usable & wrong, rings.reversed_ring(F.col("nds"))).otherwise(F.col("nds"))).select(maps.ways.columns)
