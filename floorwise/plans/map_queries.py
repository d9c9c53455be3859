"""The map operators on maps made from the driver's tables, and SQL that gives the same rows.

Twenty maps have customers as nodes and orders as ways; tags, levels, references and faults
follow from the keys. The columns of these maps are written once, in SQL that both engines
read; what the operators do is written again in ``_findings_sql`` and the queries' own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwise.functions import rings
from floorwise.operators import labels, merge, repair, rooms, validate
from floorwise.plans.registry import query, table
from floorwise.sources.osm_xml import Maps, elements_of
from floorwise.sources.scratch import Written

DOCUMENT = {
    "map_id": "'m' || n_nationkey",
    "root_tag": "CASE WHEN n_nationkey = 3 THEN NULL WHEN n_nationkey = 7 THEN 'gpx' ELSE 'osm' END",
    "version": "CASE WHEN n_nationkey IN (3, 11) THEN NULL WHEN n_nationkey % 5 = 0 THEN '0.5' ELSE '0.6' END",
    "generator": "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'hand' END",
    "parse_error": "CASE WHEN n_nationkey = 3 THEN 'broken' END",
}
NODE = {
    "map_id": "'m' || (k % 20)",
    "ord": "CAST(k AS INT)",
    "id": "CASE WHEN k % 101 = 0 THEN NULL ELSE '-' || k END",
    "lat": "CASE WHEN k % 97 = 0 THEN 'abc' WHEN k % 89 = 0 THEN NULL ELSE CAST((k * 7) % 193 - 96 AS STRING) END",
    "lon": "CASE WHEN k % 83 = 0 THEN NULL ELSE CAST((k * 13) % 401 - 200 AS STRING) END",
    "action": "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN 'foo' ELSE 'modify' END",
    "visible": "CASE WHEN k % 13 = 0 THEN NULL ELSE 'true' END",
}
WAY = {
    "map_id": "'m' || (k % 20)",
    "ord": "CAST(1000000 + k AS INT)",
    "id": "CASE WHEN k % 103 = 0 THEN 'w' || k ELSE '-' || k END",
    "action": "CASE WHEN k % 23 = 0 THEN NULL ELSE 'modify' END",
    "visible": "CASE WHEN k % 13 = 0 THEN NULL ELSE 'true' END",
    "n": "CAST(CASE WHEN k % 41 = 0 THEN 3 WHEN k % 43 = 0 THEN 1 WHEN k % 7 IN (3, 4) THEN 2 ELSE k % 6 END AS INT)",
    "closed": "k % 7 IN (0, 1, 2, 5) AND k % 3 <> 0",
    "osmAG:type": "CASE WHEN k % 7 IN (0, 1, 2, 5) THEN 'area' WHEN k % 7 IN (3, 4) THEN 'passage' WHEN k % 2 = 0 THEN 'thing' END",
    "osmAG:areaType": """CASE WHEN k % 7 NOT IN (0, 1, 2, 5) OR k % 71 = 0 THEN NULL WHEN k % 7 = 5 AND k % 2 = 0 THEN 'elevator' WHEN k % 7 = 5 THEN '{stairs}'
        WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'hall' WHEN k % 9 = 2 THEN 'structure' WHEN k % 9 = 3 THEN 'corridor' WHEN k % 9 = 4 THEN 'lobby' ELSE 'room' END""",
    "level": "CASE WHEN k % 61 = 0 THEN NULL WHEN k % 53 = 0 THEN 'first' WHEN k % 47 = 0 THEN 'x' WHEN k % 59 = 0 THEN '99' ELSE CAST(k % 4 AS STRING) END",
    "name": """CASE WHEN k % 67 = 0 THEN NULL WHEN k % 7 = 5 AND k % 2 = 0 AND k % 5 = 0 THEN 'E1_p' || (k % 12) WHEN k % 7 = 5 AND k % 2 = 0 THEN 'E1-P' || (k % 12)
        WHEN k % 7 = 5 THEN 'E1-ST-' || (k % 10) WHEN k % 7 IN (0, 1, 2) AND k % 73 = 0 THEN 'E1a-F' || (k % 4) || '-R' || (k % 300) WHEN k % 7 IN (0, 1, 2) THEN 'R' || (k % 300)
        WHEN k % 17 = 0 THEN 'R1 to R2' WHEN k % 19 = 0 THEN '' ELSE 'P' || k END""",
}
#: References by name, and by id.
REFERENCES = {
    "semantic": {
        "osmAG:parent": "CASE WHEN k % 7 IN (0, 1, 2) AND k % 5 = 0 THEN 'R' || (k % 450) END",
        "osmAG:from": "CASE WHEN k % 7 NOT IN (3, 4) OR k % 29 = 0 THEN NULL WHEN k % 4 = 0 THEN 'E1-P' || (k % 14) ELSE 'R' || (k % 330) END",
        "osmAG:to": "CASE WHEN k % 7 NOT IN (3, 4) OR k % 29 = 0 THEN NULL WHEN k % 4 = 0 THEN 'E1-P' || (k % 14) ELSE 'R' || (k * 3 % 310) END",
    },
    "fix_id": {
        "osmAG:parent": "CASE WHEN k % 7 IN (0, 1, 2) AND k % 5 = 0 THEN '-' || (k - 140 * (1 + k % 2)) END",
        "osmAG:from": "CASE WHEN k % 7 NOT IN (3, 4) OR k % 29 = 0 THEN NULL WHEN k % 31 = 0 THEN 'zz' WHEN k % 7 = 3 THEN '-' || (k - 80) ELSE '-' || (k - 60) END",
        "osmAG:to": "CASE WHEN k % 7 NOT IN (3, 4) OR k % 29 = 0 THEN NULL WHEN k % 37 = 0 THEN '-' || (k - CASE WHEN k % 7 = 3 THEN 80 ELSE 60 END) ELSE '-' || (k - 100) END",
    },
}
TAGS = ["osmAG:type", "osmAG:areaType", "level", "name", "osmAG:parent", "osmAG:from", "osmAG:to"]


def _columns(dialect: str) -> dict[str, str]:
    return {n: e.format(stairs=validate.AREA_TYPES[dialect][-1]) for n, e in (WAY | REFERENCES[dialect]).items()}


def made_maps(spark: SparkSession, d: str, dialect: str = "semantic") -> Maps:
    """The maps, landed as parsed ones are."""
    documents = table(spark, d, "nation").select(*(F.expr(e).alias(n) for n, e in DOCUMENT.items()))
    nodes = table(spark, d, "customer").selectExpr("c_custkey AS k").select(*(F.expr(e).alias(n) for n, e in NODE.items()), F.create_map().cast("map<string,string>").alias("tags"))
    ways = table(spark, d, "orders").selectExpr("o_orderkey AS k").select("k", *(F.expr(e).alias(n) for n, e in _columns(dialect).items()))
    refs = F.transform(F.slice(F.array(*map(F.lit, range(6))), F.lit(1), F.col("n")), lambda i: F.concat(F.lit("-"), (F.col("k") % 1000 + 20 * i).cast("string")))
    tags = F.map_filter(F.create_map(*(x for t in TAGS for x in (F.lit(t), F.col(f"`{t}`")))), lambda k, v: v.isNotNull())
    ways = ways.withColumns({"refs": refs, "tags": tags}).withColumn("nds", F.when(F.col("closed"), F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs")))
    return Maps(Written(elements_of(nodes, ways.select("map_id", "ord", "id", "action", "visible", "nds", "tags"), documents), "elements").df)


def maps_sql(dialect: str = "semantic") -> str:
    """CTEs docs, nodes_raw, ways_raw, good, nodes and ways: the same maps, and what of them can be used."""
    listed = lambda columns: ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    blank = ", ".join(f"coalesce(\"{t}\", '') AS {c}" for t, c in {"osmAG:type": "kind", "osmAG:areaType": "type", "level": "lvl", "name": "nm", "osmAG:parent": "parent", "osmAG:from": "f", "osmAG:to": "t"}.items())
    usable = "id IS NOT NULL" if dialect == "semantic" else "TRY_CAST(id AS BIGINT) IS NOT NULL"
    return f"""WITH docs AS (SELECT {listed(DOCUMENT)} FROM nation),
    nodes_raw AS (SELECT {listed(NODE)} FROM (SELECT c_custkey AS k FROM customer)),
    ways_cols AS (SELECT k, {listed(_columns(dialect))} FROM (SELECT o_orderkey AS k FROM orders)),
    ways_raw AS (SELECT * EXCLUDE (k, n, closed), CASE WHEN closed THEN list_concat(refs, refs[1:1]) ELSE refs END AS nds
        FROM (SELECT *, list_transform([0, 1, 2, 3, 4, 5][1:n], lambda i: '-' || CAST(k % 1000 + 20 * i AS VARCHAR)) AS refs FROM ways_cols)),
    good AS (SELECT map_id FROM docs WHERE parse_error IS NULL AND root_tag = 'osm' AND version IS NOT NULL),
    nodes AS (SELECT map_id, ord, id, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon, coalesce(action, 'modify') AS action FROM nodes_raw
        WHERE map_id IN (FROM good) AND {usable} AND TRY_CAST(lat AS DOUBLE) IS NOT NULL AND TRY_CAST(lon AS DOUBLE) IS NOT NULL),
    ways AS (SELECT *, {blank} FROM ways_raw WHERE map_id IN (FROM good) AND {usable})"""


def _findings_sql(dialect: str) -> str:
    semantic = dialect == "semantic"
    kinds = ", ".join(f"'{t}'" for t in validate.AREA_TYPES[dialect])
    rules: list[tuple[str, str, str, str, str]] = [  # table, condition, level, category, message
        ("docs", "parse_error IS NOT NULL", "ERROR", "'XML'", "'the document can''t be parsed'"),
        ("docs", "parse_error IS NULL AND root_tag <> 'osm'", "ERROR", "'ROOT'", "'the root element is not osm'"),
        ("docs", "root_tag = 'osm' AND version IS NULL", "ERROR", "'ROOT'", "'the version is missing'"),
        ("docs", "map_id IN (FROM good) AND version <> '0.6'", "WARNING", "'ROOT'", "'the version is not 0.6'"),
        ("docs", "map_id IN (FROM good) AND generator IS NULL", "INFO", "'ROOT'", "'the generator is missing'"),
        *(("nodes_raw", f"map_id IN (FROM good) AND {c} IS NULL", "ERROR", "'NODE'", "'a required attribute is missing'") for c in ("id", "lat", "lon")),
        ("nodes_raw", "map_id IN (FROM good) AND id IS NOT NULL AND lon IS NOT NULL AND lat = 'abc'", "ERROR", "'NODE'", "'a coordinate is no number'"),
        ("nodes", "abs(lat) > 90", "ERROR", "'NODE'", "'the latitude is out of range'"),
        ("nodes", "abs(lon) > 180", "ERROR", "'NODE'", "'the longitude is out of range'"),
        ("nodes", "action NOT IN ('modify', 'delete', 'create')", "WARNING", "'NODE'", "'the action is unknown'"),
        ("ways", "kind NOT IN ('area', 'passage')" + " AND kind <> ''" * semantic, "WARNING", "'CLASSIFICATION'", "'the way''s type is unknown'"),
        *(("ways", f"kind = 'area' AND \"{t}\" IS NULL", "ERROR", "'AREA'", "'a required tag is missing'") for t in ["name"] * semantic + ["osmAG:areaType", "level"]),
        ("ways", f"kind = 'area' AND type NOT IN ({kinds}, '')", "WARNING", "'AREA'", "'the area type is unknown'"),
        ("ways", "kind = 'area' AND lvl <> '' AND TRY_CAST(lvl AS INT) IS NULL", "ERROR", "'AREA'", "'the level is no integer'"),
        ("ways", "kind = 'area' AND TRY_CAST(lvl AS INT) NOT BETWEEN -10 AND 50", "WARNING", "'AREA'", "'the level is out of range'"),
        ("ways", "kind = 'area' AND len(nds) < 3", "ERROR", "'AREA'", "'an area needs three nodes'"),
        ("ways", "kind = 'area' AND len(nds) >= 3 AND nds[1] <> nds[-1]", "ERROR", "'AREA'", "'the ring is not closed'"),
        *(("ways", f"kind = 'passage' AND \"{t}\" IS NULL", "ERROR", "'PASSAGE'", "'a required tag is missing'") for t in ["name"] * semantic + ["osmAG:from", "osmAG:to", "level"]),
        ("ways", "kind = 'passage' AND len(nds) <> 2", "ERROR", "'PASSAGE'", "'a passage needs two nodes'"),
        ("missing_nodes", "true", "ERROR", "CASE kind WHEN 'area' THEN 'AREA' ELSE 'PASSAGE' END", "'a node is missing'"),
    ]
    parent = "'the level differs from the parent''s'"
    if semantic:
        rules += [
            ("ways", "kind IN ('area', 'passage') AND nm = ''", "ERROR", "'SEMANTIC_NAMING'", "'the name is missing'"),
            ("ways", "kind = 'passage' AND f = '' AND t = ''", "ERROR", "'PASSAGE'", "'neither end has an area'"),
            ("ways", "kind = 'passage' AND f <> '' AND f = t AND lvl = ''", "ERROR", "'CROSS_LEVEL_PASSAGE'", "'the level is missing'"),
            ("ways", "kind = 'passage' AND f <> '' AND f = t AND lvl <> '' AND TRY_CAST(lvl AS INT) IS NULL", "ERROR", "'CROSS_LEVEL_PASSAGE'", "'the level is no integer'"),
            ("ends", "target NOT IN (SELECT nm FROM areas a WHERE a.map_id = ends.map_id)", "ERROR", "'SEMANTIC_REFERENCE'", "'the area is missing'"),
            ("ends_known", "(e = 'parent' OR f <> t) AND lvl <> '' AND first <> '' AND lvl <> first", "WARNING", "'LEVEL_CONSISTENCY'", f"CASE e WHEN 'parent' THEN {parent} ELSE 'the level differs from the ' || e || ' area''s' END"),
            ("vertical", "(SELECT count(*) FROM vertical v WHERE v.map_id = vertical.map_id AND v.nm = vertical.nm) = 1", "WARNING", "'VERTICAL_TRANSPORT'", "'it is on one level only'"),
            ("vertical", "EXISTS (FROM vertical v WHERE v.map_id = vertical.map_id AND v.nm = vertical.nm AND v.lvl = vertical.lvl AND v.ord < vertical.ord)", "ERROR", "'VERTICAL_TRANSPORT'", "'it is on a level more than once'"),
            ("ways", "kind = 'passage' AND f <> '' AND f = t AND NOT EXISTS (FROM vertical v WHERE v.map_id = ways.map_id AND v.nm = ways.f)", "WARNING", "'CROSS_LEVEL_PASSAGE'", "'it joins no lift or stairs'"),
            ("ways", "kind = 'passage' AND f <> '' AND f = t AND TRY_CAST(lvl AS INT) IS NOT NULL AND EXISTS (FROM vertical v WHERE v.map_id = ways.map_id AND v.nm = ways.f) AND NOT EXISTS (FROM vertical v WHERE v.map_id = ways.map_id AND v.nm = ways.f AND abs(TRY_CAST(v.lvl AS INT) - TRY_CAST(ways.lvl AS INT)) = 1)", "WARNING", "'CROSS_LEVEL_PASSAGE'", "'no adjacent level has the facility'"),
        ]
    else:
        own = "CASE kind WHEN 'area' THEN 'AREA' ELSE 'PASSAGE' END"
        rules += [
            ("ways_raw", "map_id IN (FROM good) AND TRY_CAST(id AS BIGINT) IS NULL", "ERROR", "'WAY'", "'the id is no integer'"),
            ("ways", "kind = 'passage' AND f <> '' AND f = t", "ERROR", "'PASSAGE'", "'both ends are the same area'"),
            ("ends", "target NOT IN (SELECT id FROM areas a WHERE a.map_id = ends.map_id)", "ERROR", own, "CASE WHEN TRY_CAST(target AS BIGINT) IS NULL THEN 'a reference is no integer' ELSE 'the area is missing' END"),
            ("ends_known", "e = 'parent' AND lvl <> '' AND first <> '' AND lvl <> first", "WARNING", "'CROSS_VALIDATION'", parent),
            ("outside", "true", "WARNING", "'CROSS_VALIDATION'", "'a passage''s node is on neither area''s boundary'"),
        ]
    key = "nm" if semantic else "id"
    columns = lambda t: {"docs": "map_id, 0 AS ord, CAST(NULL AS VARCHAR) AS element_id"}.get(t, "map_id, ord, id AS element_id")
    union = "\n    UNION ALL ".join(f"SELECT {columns(t)}, '{level}' AS level, {category} AS category, {message} AS message FROM {t} WHERE {when}" for t, when, level, category, message in rules)
    return f"""{maps_sql(dialect)},
    areas AS (SELECT * FROM ways WHERE kind = 'area'),
    vertical AS (SELECT * FROM areas WHERE nm <> '' AND type IN ('elevator', '{validate.AREA_TYPES[dialect][-1]}')),
    missing_nodes AS (SELECT * FROM (SELECT *, unnest(nds) AS ref FROM ways WHERE kind IN ('area', 'passage')) WHERE NOT EXISTS (FROM nodes n WHERE n.map_id = map_id AND n.id = ref)),
    ends AS (SELECT * FROM (SELECT *, 'parent' AS e, parent AS target FROM areas UNION ALL SELECT *, 'from', f FROM ways WHERE kind = 'passage' UNION ALL SELECT *, 'to', t FROM ways WHERE kind = 'passage') WHERE target <> ''),
    firsts AS (SELECT map_id, {key} AS target, arg_min(lvl, ord) AS first FROM areas WHERE {key} <> '' GROUP BY ALL),
    ends_known AS (SELECT * FROM ends JOIN firsts USING (map_id, target)),
    outside AS (SELECT * FROM (SELECT p.map_id, p.ord, p.id, unnest(p.nds) AS ref, a.nds AS na, b.nds AS nb FROM ways p JOIN areas a ON a.map_id = p.map_id AND a.id = p.f JOIN areas b ON b.map_id = p.map_id AND b.id = p.t WHERE p.kind = 'passage')
        WHERE NOT list_contains(na, ref) AND NOT list_contains(nb, ref)),
    findings AS ({union})"""


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("map_id", "ord", "level", "category", "message", "element_id").agg(F.count("*").alias("n"))


_SAME = "SELECT map_id, ord, level, category, message, element_id, count(*) AS n FROM findings GROUP BY ALL"


@query("map_findings", f"{_findings_sql('semantic')} {_SAME}")
def map_findings(spark: SparkSession, d: str) -> DataFrame:
    return _counted(validate.findings(made_maps(spark, d)))


@query("map_findings_by_id", f"{_findings_sql('fix_id')} {_SAME}")
def map_findings_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _counted(validate.findings(made_maps(spark, d, "fix_id"), "fix_id"))


@query(
    "map_summary",
    f"""{_findings_sql("semantic")}, n AS (SELECT map_id, count(*) AS total_issues, count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE level = 'WARNING') AS warnings, count(*) FILTER (WHERE level = 'INFO') AS infos FROM findings GROUP BY 1)
    SELECT map_id, coalesce(total_issues, 0) AS total_issues, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos, coalesce(errors, 0) = 0 AS passed FROM docs LEFT JOIN n USING (map_id)""",
)
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    maps = made_maps(spark, d)
    return validate.summary(validate.findings(maps), maps.documents)


@query(
    "map_report_lines",
    f"""{_findings_sql("semantic")} SELECT map_id, level, category, message, element_id, n FROM
    (SELECT *, row_number() OVER (PARTITION BY map_id, level, category ORDER BY ord, message, element_id) AS n FROM findings) WHERE n <= 10""",
)
def map_report_lines(spark: SparkSession, d: str) -> DataFrame:
    found = validate.report_lines(validate.findings(made_maps(spark, d)))
    return found.select("map_id", "level", "category", "message", "element_id", F.col("n").cast("long").alias("n"))


def _entries(column: str, value: str = "v") -> F.Column:
    shown = {"v": lambda e: e["value"].cast("string"), "mean": lambda e: F.format_string("%.4f", e["value"])}[value]
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), shown(e))), ",").alias(column)


def _by(key: str, value: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT map_id, string_agg(k || '=' || v, ',' ORDER BY k) AS {name} FROM (SELECT map_id, {key} AS k, {value} AS v FROM {source} GROUP BY 1, 2) GROUP BY 1)"


_LEVEL = "CASE WHEN lvl = '' THEN 'unknown' ELSE lvl END"
_PATTERN = r"""CASE WHEN kind = 'passage' AND nm LIKE '%\_to\_%' ESCAPE '\' THEN 'passage' WHEN type = 'elevator' AND regexp_matches(nm, '^[A-Z]\d+-P\d+$') THEN 'elevator'
    WHEN type = 'stairs' AND regexp_matches(nm, '^[A-Z]\d+-ST-\d+$') THEN 'stairs' WHEN type = 'structure' AND regexp_matches(nm, '^[A-Z]\d+[a-z]?-F\d+$') THEN 'structure'
    WHEN kind = 'area' AND regexp_matches(nm, '^[A-Z]\d+[a-z]?-F\d+-.*$') THEN 'area' ELSE 'unknown' END"""
_TOTALS = {"total_nodes": "nodes", "total_ways": "ways", "total_areas": "ways WHERE kind = 'area'", "total_passages": "ways WHERE kind = 'passage'", "total_vertical_transport": "ways WHERE kind = 'area' AND type IN ('elevator', 'stairs')", "total_cross_level_passages": "ways WHERE kind = 'passage' AND f <> '' AND f = t"}


@query(
    "map_statistics",
    f"""{maps_sql()}, areas AS (SELECT * FROM ways WHERE kind = 'area'), vertical AS (SELECT * FROM areas WHERE type IN ('elevator', 'stairs')),
    linked AS (SELECT map_id, f AS a, t AS b FROM ways WHERE kind = 'passage' AND f <> '' AND t <> '' UNION SELECT map_id, t, f FROM ways WHERE kind = 'passage' AND f <> '' AND t <> ''),
    named AS (SELECT * FROM ways WHERE kind IN ('area', 'passage') AND nm <> ''), crossing AS (SELECT * FROM ways WHERE kind = 'passage' AND f <> '' AND f = t),
    {_by(_LEVEL, "count(*)", "areas", "areas_by_level")}, {_by(_LEVEL, "count(*)", "vertical", "vertical_transport_by_level")}, {_by(_PATTERN, "count(*)", "named", "semantic_name_patterns")},
    {_by(_LEVEL, "printf('%.4f', avg(len(nds)))", "areas", "avg_nodes_per_area_by_level")}, {_by("CASE WHEN f LIKE 'E1-P%' THEN 'elevator' ELSE 'unknown' END", "count(*)", "crossing", "cross_level_passages_by_type")},
    {_by("a", "count(DISTINCT b)", "linked", "area_connections")},
    mean AS (SELECT map_id, round(avg(n), 6) AS avg_connections_per_area FROM (SELECT map_id, a, count(DISTINCT b) AS n FROM linked GROUP BY ALL) GROUP BY 1)
    SELECT * FROM (SELECT map_id, {", ".join(f"(SELECT count(*) FROM (SELECT map_id AS m FROM {t}) WHERE m = map_id) AS {n}" for n, t in _TOTALS.items())} FROM docs)
    LEFT JOIN areas_by_level USING (map_id) LEFT JOIN vertical_transport_by_level USING (map_id) LEFT JOIN semantic_name_patterns USING (map_id) LEFT JOIN avg_nodes_per_area_by_level USING (map_id)
    LEFT JOIN cross_level_passages_by_type USING (map_id) LEFT JOIN area_connections USING (map_id) LEFT JOIN mean USING (map_id)""",
)
def map_statistics(spark: SparkSession, d: str) -> DataFrame:
    maps = ["areas_by_level", "vertical_transport_by_level", "semantic_name_patterns", "cross_level_passages_by_type", "area_connections"]
    found = validate.statistics(made_maps(spark, d))
    return found.select("map_id", *_TOTALS, *map(_entries, maps), _entries("avg_nodes_per_area_by_level", "mean"), F.round("avg_connections_per_area", 6).alias("avg_connections_per_area"))


_FIXES = rf"""{maps_sql()},
    typed AS (SELECT * EXCLUDE (visible), visible AS vis, coalesce("osmAG:type", '') AS k0, coalesce("osmAG:areaType", '') AS t0, coalesce("level", '') AS l0, coalesce("name", '') AS n0,
        coalesce("osmAG:parent", '') AS p0, coalesce("osmAG:from", '') AS f0, coalesce("osmAG:to", '') AS e0 FROM ways_raw),
    one AS (SELECT *, CASE WHEN k0 = 'area' AND t0 = '' THEN CASE WHEN regexp_matches(lower(n0), 'p\d+') THEN 'elevator' WHEN contains(lower(n0), 'st-') THEN 'stairs' ELSE 'room' END ELSE t0 END AS t1,
        CASE WHEN k0 = 'area' AND l0 = '' AND regexp_matches(n0, '-F\d+-') THEN regexp_extract(n0, '-F(\d+)-', 1) ELSE l0 END AS l1 FROM typed),
    two AS (SELECT *, CASE WHEN k0 = 'area' AND t1 = 'hall' THEN 'corridor' ELSE t1 END AS t2,
        CASE WHEN k0 = 'area' AND l1 = 'first' THEN '1' WHEN k0 = 'area' AND l1 = '99' THEN '1' ELSE l1 END AS l2 FROM one),
    three AS (SELECT *, CASE WHEN k0 = 'area' AND t2 = 'elevator' AND regexp_matches(n0, '^[A-Z]\d+[_\-\s]*[Pp]\d+$') THEN regexp_replace(n0, '^([A-Z]\d+)[_\-\s]*[Pp](\d+)$', '\1-P\2')
        WHEN k0 = 'area' AND t2 = 'stairs' AND regexp_matches(n0, '^E1-ST-\d$') THEN replace(n0, 'ST-', 'ST-0')
        WHEN k0 = 'passage' AND n0 = '' AND f0 <> '' AND e0 <> '' THEN f0 || '_to_' || e0 WHEN k0 = 'passage' AND n0 = 'R1 to R2' THEN 'r1_to_r2' ELSE n0 END AS n2 FROM two),
    facility AS (SELECT map_id, n2 AS f0, arg_min(l2, ord) AS fl FROM three WHERE k0 = 'area' AND n2 <> '' AND t2 IN ('elevator', 'stairs') AND l2 <> '' GROUP BY ALL),
    last AS (SELECT map_id, n2 AS p0, arg_max(l2, ord) AS pl FROM three WHERE k0 = 'area' AND n2 <> '' GROUP BY ALL),
    four AS (SELECT * FROM three LEFT JOIN facility USING (map_id, f0) LEFT JOIN last USING (map_id, p0)),
    fixes AS (
        SELECT map_id, 'SAFE' AS level, 'ROOT' AS category, 'set the version' AS description, CAST(NULL AS VARCHAR) AS element_id, version AS old_value, '0.6' AS new_value FROM docs WHERE parse_error IS NULL AND version IS DISTINCT FROM '0.6'
        UNION ALL SELECT map_id, 'SAFE', 'ROOT', 'add a generator', NULL, NULL, 'floorwise' FROM docs WHERE parse_error IS NULL AND generator IS NULL
        UNION ALL SELECT map_id, 'SAFE', 'NODE', 'set the action', id, action, 'modify' FROM nodes_raw WHERE action IS NULL OR action = 'foo'
        UNION ALL SELECT map_id, 'SAFE', 'NODE', 'add visible', id, NULL, 'true' FROM nodes_raw WHERE visible IS NULL
        UNION ALL SELECT map_id, 'MODERATE', 'NODE', 'clamp lat', id, lat, CASE WHEN TRY_CAST(lat AS INT) < 0 THEN '-90.0' ELSE '90.0' END FROM nodes_raw WHERE abs(TRY_CAST(lat AS INT)) > 90
        UNION ALL SELECT map_id, 'MODERATE', 'NODE', 'clamp lon', id, lon, CASE WHEN TRY_CAST(lon AS INT) < 0 THEN '-180.0' ELSE '180.0' END FROM nodes_raw WHERE abs(TRY_CAST(lon AS INT)) > 180
        UNION ALL SELECT map_id, 'SAFE', 'WAY', 'add an action', id, NULL, 'modify' FROM four WHERE action IS NULL
        UNION ALL SELECT map_id, 'SAFE', 'WAY', 'add visible', id, NULL, 'true' FROM four WHERE vis IS NULL
        UNION ALL SELECT map_id, 'SAFE', 'AREA', 'close the ring', id, array_to_string(nds, ','), array_to_string(list_concat(nds, nds[1:1]), ',') FROM four WHERE k0 = 'area' AND len(nds) >= 3 AND nds[1] <> nds[-1]
        UNION ALL SELECT map_id, 'MODERATE', 'AREA', 'infer the type from the name', id, "osmAG:areaType", t1 FROM four WHERE t1 <> t0
        UNION ALL SELECT map_id, 'MODERATE', 'AREA', 'infer the level from the name', id, "level", l1 FROM four WHERE l1 <> l0
        UNION ALL SELECT map_id, 'SAFE', 'AREA', 'standardise the type', id, t1, t2 FROM four WHERE t2 <> t1
        UNION ALL SELECT map_id, 'MODERATE', 'SEMANTIC_NAMING', 'standardise the name', id, n0, n2 FROM four WHERE k0 = 'area' AND n2 <> n0
        UNION ALL SELECT map_id, 'MODERATE', 'AREA', 'repair the level', id, l1, l2 FROM four WHERE l2 <> l1
        UNION ALL SELECT map_id, 'MODERATE', 'PASSAGE', CASE WHEN n0 = '' THEN 'name the passage by its ends' ELSE 'format the name' END, id, "name", n2 FROM four WHERE k0 = 'passage' AND n2 <> n0
        UNION ALL SELECT map_id, 'MODERATE', 'CROSS_LEVEL_PASSAGE', 'take the facility''s level', id, "level", fl FROM four WHERE k0 = 'passage' AND f0 <> '' AND f0 = e0 AND l2 = '' AND fl IS NOT NULL
        UNION ALL SELECT map_id, 'MODERATE', 'LEVEL_CONSISTENCY', 'take the parent''s level', id, l2, pl FROM four WHERE k0 = 'area' AND pl <> '' AND l2 <> '' AND l2 <> pl)"""


@query("map_fixes", f"{_FIXES} SELECT *, count(*) AS n FROM fixes GROUP BY ALL")
def map_fixes(spark: SparkSession, d: str) -> DataFrame:
    return _counted_fixes(repair.repair(made_maps(spark, d), moderate=True).fixes)


def _counted_fixes(fixes: DataFrame) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\[|\]$", ""), ", ", ",").alias(c)  # noqa: E731  rings as lists
    return fixes.select("map_id", "level", "category", "description", "element_id", plain("old_value"), plain("new_value")).groupBy("map_id", "level", "category", "description", "element_id", "old_value", "new_value").agg(F.count("*").alias("n"))


@query(
    "map_fix_counts",
    f"{_FIXES} SELECT map_id, count(*) AS total, count(*) FILTER (WHERE level = 'SAFE') AS safe, count(*) FILTER (WHERE level = 'MODERATE') AS moderate, count(*) FILTER (WHERE level = 'RISKY') AS risky FROM fixes GROUP BY 1",
)
def map_fix_counts(spark: SparkSession, d: str) -> DataFrame:
    return repair.fix_counts(repair.repair(made_maps(spark, d), moderate=True).fixes)


_ROOT_AND_NODES = _FIXES[_FIXES.index("SELECT map_id, 'SAFE' AS level, 'ROOT'") : _FIXES.index("UNION ALL SELECT map_id, 'SAFE', 'WAY'")]
_FIXES_BY_ID = rf"""{maps_sql("fix_id")},
    typed AS (SELECT * EXCLUDE (visible), visible AS vis, coalesce("osmAG:type", '') AS k0, coalesce("osmAG:areaType", '') AS t0, coalesce("level", '') AS l0, lower(coalesce("name", '')) AS n0 FROM ways_raw),
    one AS (SELECT *, CASE WHEN k0 <> 'area' OR t0 <> '' THEN t0 WHEN regexp_matches(n0, 'corridor|hallway') THEN 'corridor' WHEN regexp_matches(n0, 'room|office|lab') THEN 'room' WHEN regexp_matches(n0, 'elevator|lift') THEN 'elevator'
        WHEN regexp_matches(n0, 'stair|step') THEN '{validate.AREA_TYPES["fix_id"][-1]}' WHEN regexp_matches(n0, 'structure|building') THEN 'structure' ELSE 'room' END AS t1 FROM typed),
    four AS (SELECT *, CASE WHEN k0 = 'area' AND t1 = 'hall' THEN 'corridor' ELSE t1 END AS t2, CASE WHEN k0 = 'area' AND l0 IN ('first', '99') THEN '1' ELSE l0 END AS l2 FROM one),
    fixes AS ({_ROOT_AND_NODES}
        UNION ALL SELECT map_id, 'SAFE', 'WAY', 'add an action', id, NULL, 'modify' FROM four WHERE action IS NULL
        UNION ALL SELECT map_id, 'SAFE', 'WAY', 'add visible', id, NULL, 'true' FROM four WHERE vis IS NULL
        UNION ALL SELECT map_id, 'SAFE', 'AREA', 'close the ring', id, array_to_string(nds, ','), array_to_string(list_concat(nds, nds[1:1]), ',') FROM four WHERE k0 = 'area' AND len(nds) >= 3 AND nds[1] <> nds[-1]
        UNION ALL SELECT map_id, 'MODERATE', 'AREA', 'infer the type from the name', id, "osmAG:areaType", t1 FROM four WHERE t1 <> t0
        UNION ALL SELECT map_id, 'SAFE', 'AREA', 'standardise the type', id, t1, t2 FROM four WHERE t2 <> t1
        UNION ALL SELECT map_id, 'MODERATE', 'AREA', 'repair the level', id, l0, l2 FROM four WHERE l2 <> l0)"""


@query("map_fixes_by_id", f"{_FIXES_BY_ID} SELECT *, count(*) AS n FROM fixes GROUP BY ALL")
def map_fixes_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _counted_fixes(repair.repair(made_maps(spark, d, "fix_id"), "fix_id", moderate=True).fixes)


_RINGS = f"""{maps_sql()},
    places AS (SELECT w.map_id, w.ord, w.pos, TRY_CAST(n.lon AS DOUBLE) AS x, TRY_CAST(n.lat AS DOUBLE) AS y FROM (SELECT map_id, ord, unnest(nds) AS ref, generate_subscripts(nds, 1) AS pos FROM ways_raw) w JOIN nodes_raw n ON n.map_id = w.map_id AND n.id = w.ref),
    rings AS (SELECT map_id, ord, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys FROM places GROUP BY ALL),
    anchors AS (SELECT w.map_id, w.ord, w.id, w."name" AS name, w."level" AS level, CASE WHEN w."osmAG:areaType" = 'elevator' THEN 'elevator' ELSE 'stairs' END AS type, coalesce(xs, []) AS xs, coalesce(ys, []) AS ys
        FROM ways_raw w LEFT JOIN rings USING (map_id, ord) WHERE w."osmAG:type" = 'area' AND w."osmAG:areaType" IN ('elevator', 'stairs') AND w."name" <> '' AND w."level" <> ''),
    details AS (SELECT map_id, name, type, ref_level, target_level, n AS vertex_count,
            CASE WHEN len(list_filter(ry[:n], lambda v: v IS NULL)) + len(list_filter(ty[:n], lambda v: v IS NULL)) = 0 THEN (list_sum(ry[:n]) - list_sum(ty[:n])) / n END AS lat_offset,
            CASE WHEN len(list_filter(rx[:n], lambda v: v IS NULL)) + len(list_filter(tx[:n], lambda v: v IS NULL)) = 0 THEN (list_sum(rx[:n]) - list_sum(tx[:n])) / n END AS lon_offset
        FROM (SELECT t.map_id, t.name, r.type, r.level AS ref_level, t.level AS target_level, r.xs AS rx, r.ys AS ry, t.xs AS tx, t.ys AS ty, least(len(r.xs), len(t.xs)) AS n
            FROM anchors r JOIN anchors t ON t.name = r.name AND r.map_id = 'm1' AND t.map_id <> 'm1' AND r.level <> t.level) WHERE n > 0)"""


def _details(spark: SparkSession, d: str) -> DataFrame:
    found = Written(merge.anchors(made_maps(spark, d)), "anchors").df
    return merge.offset_details(found.where("map_id = 'm1'"), found.where("map_id <> 'm1'"))


@query("map_offset_details", f"{_RINGS} SELECT map_id, name, type, ref_level, target_level, vertex_count, round(lat_offset, 6) AS lat_offset, round(lon_offset, 6) AS lon_offset, count(*) AS n FROM details GROUP BY ALL")
def map_offset_details(spark: SparkSession, d: str) -> DataFrame:
    rounded = _details(spark, d).withColumns({c: F.round(c, 6) for c in ("lat_offset", "lon_offset")}).withColumn("vertex_count", F.col("vertex_count").cast("long"))
    return rounded.groupBy(*(c for c in rounded.columns if c != "pairs")).agg(F.sum("pairs").alias("n"))


@query(
    "map_offsets",
    f"""{_RINGS}, marked AS (SELECT *, abs(lat_offset - avg(lat_offset) OVER w) < 2 * stddev_pop(lat_offset) OVER w AND abs(lon_offset - avg(lon_offset) OVER w) < 2 * stddev_pop(lon_offset) OVER w AS inside FROM details WINDOW w AS (PARTITION BY map_id)),
    used AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY map_id) AS kept, count(*) OVER (PARTITION BY map_id) AS n FROM marked) WHERE inside OR kept * 2 < n),
    named AS (SELECT map_id, name, type, avg(lat_offset) AS lat, avg(lon_offset) AS lon, CASE type WHEN 'elevator' THEN 2.0 ELSE 1.5 END AS weight FROM used GROUP BY ALL)
    SELECT map_id, round(sum(lat * weight) / sum(weight), 6) AS lat_offset, round(sum(lon * weight) / sum(weight), 6) AS lon_offset, count(*) AS n_names FROM named GROUP BY 1""",
)
def map_offsets(spark: SparkSession, d: str) -> DataFrame:
    return merge.offsets(_details(spark, d)).select("map_id", F.round("lat_offset", 6).alias("lat_offset"), F.round("lon_offset", 6).alias("lon_offset"), "n_names")


@query(
    "map_vertical_passages",
    f"""{_RINGS}, ordered AS (SELECT *, CASE WHEN bool_and(TRY_CAST(level AS DOUBLE) IS NOT NULL) OVER (PARTITION BY map_id, type, name) THEN TRY_CAST(level AS DOUBLE) END AS number FROM anchors WHERE len(xs) > 0),
    pairs AS (SELECT * FROM (SELECT *, lead(level) OVER (PARTITION BY map_id, type, name ORDER BY number NULLS FIRST, level, ord) AS upper FROM ordered) WHERE upper IS NOT NULL),
    lows AS (SELECT map_id, least(0, min(TRY_CAST(id AS BIGINT)) FILTER (WHERE node)) AS ln, least(0, min(TRY_CAST(id AS BIGINT)) FILTER (WHERE NOT node)) AS lw FROM (SELECT map_id, id, true AS node FROM nodes_raw UNION ALL SELECT map_id, id, false FROM ways_raw) GROUP BY 1),
    counted AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY type, name, level, upper) AS n FROM pairs)
    SELECT map_id, CAST(lw - n AS VARCHAR) AS id, name, level, type, CAST(ln - 2 * n + 1 AS VARCHAR) || ',' || CAST(ln - 2 * n AS VARCHAR) AS nds FROM counted JOIN lows USING (map_id)""",
)
def map_vertical_passages(spark: SparkSession, d: str) -> DataFrame:
    _, ways = merge.vertical_passages(made_maps(spark, d))
    return ways.select("map_id", "id", F.col("tags")["osmAG:from"].alias("name"), F.col("tags")["level"].alias("level"), F.col("tags")["osmAG:areaType"].alias("type"), F.array_join("nds", ",").alias("nds"))


@query(
    "map_renumbered",
    f"""{maps_sql()}, rows AS (SELECT 'node' AS kind, map_id, ord, id, CAST([] AS VARCHAR[]) AS nds FROM nodes_raw UNION ALL SELECT 'way', map_id, ord, id, nds FROM ways_raw),
    ids AS (SELECT *, CAST(-row_number() OVER (PARTITION BY kind ORDER BY map_id, ord) AS VARCHAR) AS new_id FROM rows),
    known AS (SELECT map_id, id AS ref, arg_max(new_id, ord) AS new_ref FROM ids WHERE kind = 'node' AND id IS NOT NULL GROUP BY ALL),
    refs AS (SELECT map_id, ord, string_agg(coalesce(new_ref, ref), ',' ORDER BY pos) AS nds FROM (SELECT map_id, ord, unnest(nds) AS ref, generate_subscripts(nds, 1) AS pos FROM ways_raw) LEFT JOIN known USING (map_id, ref) GROUP BY ALL)
    SELECT kind, map_id, ord, new_id AS id, CASE WHEN kind = 'way' THEN coalesce(refs.nds, '') END AS nds FROM ids LEFT JOIN refs USING (map_id, ord)""",
)
def map_renumbered(spark: SparkSession, d: str) -> DataFrame:
    out = merge.renumbered(made_maps(spark, d).elements.where("kind <> 'document'"))
    return out.select("kind", "map_id", "ord", "id", F.when(F.col("kind") == "way", F.array_join("nds", ",")).alias("nds"))


@query(
    "map_winding",
    f"""{_RINGS}, turns AS (SELECT map_id, ord, CASE WHEN len(list_filter(xs, lambda v: v IS NULL)) + len(list_filter(ys, lambda v: v IS NULL)) = 0 THEN list_sum([xs[i] * ys[i + 1] - xs[i + 1] * ys[i] for i in range(1, len(xs))]) END AS turn, len(xs) AS n FROM rings)
    SELECT w.map_id, w.ord, array_to_string(CASE WHEN len(nds) >= 4 AND nds[1] = nds[-1] AND n = len(nds) AND ("osmAG:areaType" = 'structure' AND turn > 0 OR "osmAG:areaType" = 'room' AND turn < 0) THEN list_reverse(nds) ELSE nds END, ',') AS nds
    FROM ways_raw w LEFT JOIN turns USING (map_id, ord)""",
)
def map_winding(spark: SparkSession, d: str) -> DataFrame:
    return merge.winding(made_maps(spark, d)).select("map_id", "ord", F.array_join("nds", ",").alias("nds"))


@query(
    "map_renderer_tags",
    f"""{maps_sql()} SELECT map_id, ord, CASE WHEN kind = 'passage' AND NOT (f <> '' AND f = t) THEN 'door' END AS indoor, CASE WHEN kind = 'passage' AND NOT (f <> '' AND f = t) THEN 'yes' END AS door,
    CASE WHEN kind = 'area' AND type IN ('elevator', 'stairs') THEN type END AS room
    FROM (SELECT map_id, ord, coalesce("osmAG:type", '') AS kind, coalesce("osmAG:areaType", '') AS type, coalesce("osmAG:from", '') AS f, coalesce("osmAG:to", '') AS t FROM ways_raw)""",
)
def map_renderer_tags(spark: SparkSession, d: str) -> DataFrame:
    return merge.renderer_tags(made_maps(spark, d).ways).select("map_id", "ord", *(F.try_element_at("tags", F.lit(t)).alias(t) for t in ("indoor", "door", "room")))


@query(
    "map_passage_errors",
    f"""{maps_sql()} SELECT map_id, CAST(sum(CAST(lvl = '' AS INT) + CAST(nm = '' AS INT) + CAST(n <> 2 AS INT)) AS BIGINT) AS errors
    FROM (SELECT map_id, coalesce("level", '') AS lvl, coalesce("name", '') AS nm, len(nds) AS n FROM ways_raw WHERE "osmAG:type" = 'passage' AND "osmAG:from" <> '' AND "osmAG:from" = "osmAG:to") GROUP BY 1""",
)
def map_passage_errors(spark: SparkSession, d: str) -> DataFrame:
    return merge.passage_errors(made_maps(spark, d).ways)


_RENAMES = "CASE WHEN k % 7 IN (0, 1, 2) AND k % 8 = 0 THEN 'New' || (k % 50) END"


@query(
    "map_renamed",
    f"""{maps_sql()}, k AS (SELECT *, ord - 1000000 AS k FROM ways_raw), typed AS (SELECT *, {_RENAMES} AS renamed, coalesce("osmAG:type", '') AS kind, coalesce("name", '') AS nm, coalesce("osmAG:areaType", '') AS type FROM k),
    rooms AS (SELECT * FROM typed WHERE kind = 'area' AND type <> 'structure' AND renamed IS NOT NULL),
    changes AS (SELECT map_id, CASE WHEN nm <> '' THEN nm ELSE 'room_' || id END AS old, arg_max(renamed, ord) AS new FROM rooms GROUP BY ALL)
    SELECT t.map_id, t.ord, CASE WHEN kind = 'area' AND type <> 'structure' AND renamed IS NOT NULL THEN renamed ELSE "name" END AS name, coalesce(x.new, "osmAG:from") AS start, coalesce(y.new, "osmAG:to") AS target
    FROM typed t LEFT JOIN changes x ON kind = 'passage' AND x.map_id = t.map_id AND x.old = "osmAG:from" LEFT JOIN changes y ON kind = 'passage' AND y.map_id = t.map_id AND y.old = "osmAG:to" """,
)
def map_renamed(spark: SparkSession, d: str) -> DataFrame:
    ways = made_maps(spark, d).ways
    names = ways.withColumn("k", F.col("ord") - 1_000_000).select("map_id", "id", F.expr(_RENAMES).alias("new_name")).where("new_name is not null")
    out = labels.renamed(ways, names)
    of = lambda t: F.try_element_at("tags", F.lit(t))
    return out.select("map_id", "ord", of("name").alias("name"), of("osmAG:from").alias("start"), of("osmAG:to").alias("target"))


_TEXTS = """CASE p_partkey % 9 WHEN 0 THEN '防火' WHEN 1 THEN ' Room ' || p_size WHEN 2 THEN '送风机房' WHEN 3 THEN '   ' WHEN 4 THEN '会议室' WHEN 5 THEN '入口' ELSE p_name END"""


@query(
    "drawing_texts",
    f"""WITH t AS (SELECT 'f' || (p_partkey % 3) AS file_id, p_partkey AS ord, trim({_TEXTS}) AS text, p_size % 2 = 0 AS attribute, p_size % 5 AS kind FROM part WHERE p_size % 3 > 0)
    SELECT file_id, ord, text, CASE WHEN attribute THEN 'B' || kind END AS block_name, CASE WHEN attribute THEN 'NO' END AS attribute_tag, CASE WHEN NOT attribute THEN 'TEXT' END AS entity_type
    FROM t WHERE text <> '' AND NOT ({" OR ".join(f"contains(text, '{w}')" for w in labels.BLACKLIST)})""",
)
def drawing_texts(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "part").selectExpr(
        "'f' || (p_partkey % 3) AS file_id", "p_partkey AS eid", f"{_TEXTS} AS text", "CASE WHEN p_size % 2 = 0 THEN 'ATTRIB' ELSE 'TEXT' END AS etype", "CASE WHEN p_size % 3 > 0 THEN 'names' ELSE 'other' END AS layer",
        "'B' || (p_size % 5) AS block_name", "'NO' AS tag", "array(struct(CAST(p_size AS DOUBLE) AS x, 0D AS y)) AS pts",
    )
    return labels.extracted_texts(entities, "names").drop("insert_point")


_AREAS = "CAST((k % 13 + 1) * (k % 7 + 2) AS DOUBLE)"


@query(
    "room_areas",
    f"""WITH rooms AS (SELECT 'm' || (k % 6) AS map_id, k AS room_id, {_AREAS} AS area FROM (SELECT c_custkey AS k FROM customer)),
    sized AS (SELECT map_id, room_id, round(area * 0.25, 2) AS area_m2 FROM rooms), kept AS (SELECT map_id, room_id FROM rooms WHERE area >= 10 / 0.25),
    ends AS (SELECT 'm' || (o_custkey % 6) AS map_id, o_orderkey AS passage_id, o_custkey AS room_id FROM orders UNION ALL SELECT 'm' || (o_custkey % 6), o_orderkey, o_custkey + 6 FROM orders)
    SELECT map_id, CAST(NULL AS BIGINT) AS passage_id, room_id, area_m2, repeat('#', CAST(floor(area_m2 / max(area_m2) OVER (PARTITION BY map_id) * 50) AS INT)) AS bar, room_id IN (SELECT room_id FROM kept) AS stays FROM sized
    UNION ALL SELECT map_id, passage_id, room_id, NULL, NULL, true FROM ends WHERE NOT EXISTS (FROM ends e WHERE e.map_id = ends.map_id AND e.passage_id = ends.passage_id AND NOT EXISTS (FROM kept k WHERE k.map_id = e.map_id AND k.room_id = e.room_id))""",
)
def room_areas(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles by customer, passages by order."""
    w, h = F.col("k") % 13 + 1, F.col("k") % 7 + 2
    ring = F.array(*(rings.point(x, y) for x, y in ((F.lit(0), F.lit(0)), (w, F.lit(0)), (w, h), (F.lit(0), h))))
    shapes = table(spark, d, "customer").selectExpr("c_custkey AS k").select(F.concat(F.lit("m"), F.col("k") % 6).alias("map_id"), F.col("k").alias("room_id"), ring.alias("ring"))
    orders = table(spark, d, "orders")
    end = lambda e: orders.selectExpr("'m' || (o_custkey % 6) AS map_id", "o_orderkey AS passage_id", f"{e} AS room_id")
    kept, bridge = rooms.large_enough(shapes, end("o_custkey").union(end("o_custkey + 6")), 10.0, 0.5)
    stays = kept.select("map_id", "room_id", F.lit(True).alias("stays"))
    report = rooms.area_report(shapes, 0.5).withColumn("room_id", F.regexp_extract("room", "[0-9]+", 0).cast("long"))
    report = report.join(stays, ["map_id", "room_id"], "left").select("map_id", F.lit(None).cast("long").alias("passage_id"), "room_id", "area_m2", "bar", F.coalesce("stays", F.lit(False)).alias("stays"))
    return report.unionByName(bridge.select("map_id", "passage_id", "room_id", F.lit(None).cast("double").alias("area_m2"), F.lit(None).cast("string").alias("bar"), F.lit(True).alias("stays")))


@query(
    "batch_summary",
    f"""{_findings_sql("semantic")}, p AS (SELECT map_id, NOT EXISTS (FROM findings f WHERE f.map_id = docs.map_id AND level = 'ERROR') AS passed FROM docs)
    SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, round(avg(CAST(passed AS INT)) * 100, 1) AS success_rate FROM p""",
)
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    maps = made_maps(spark, d)
    return validate.batch_summary(validate.summary(validate.findings(maps), maps.documents))


#: Square rooms by customer in a grid of their map, and texts by order beside the lower left corner of a room.
_MATCHING = """WITH rooms AS (SELECT 'm' || (k % 5) AS map_id, k AS room_ord, 'r' || k AS room_id, 10.0 * (1 + k % 3) AS side, 90.0 * (k // 5 % 12) AS x, 90.0 * (k // 60) AS y FROM (SELECT c_custkey AS k FROM customer)),
    texts AS (SELECT 'm' || (o_custkey % 5) AS map_id, o_orderkey AS ord, 90.0 * (o_custkey // 5 % 12) + o_orderkey % 97 - 40 + 0.37 AS x, 90.0 * (o_custkey // 60) + o_orderkey * 7 % 89 - 35 + 0.61 AS y FROM orders),
    near AS (SELECT t.map_id, t.ord, room_ord, room_id, side, sqrt(greatest(r.x - t.x, 0, t.x - r.x - side) ** 2 + greatest(r.y - t.y, 0, t.y - r.y - side) ** 2) AS away, sqrt((t.x - r.x - side / 2) ** 2 + (t.y - r.y - side / 2) ** 2) / sqrt(side * side / pi()) AS ratio
        FROM texts t JOIN rooms r ON r.map_id = t.map_id AND t.x BETWEEN r.x - 50 AND r.x + side + 50 AND t.y BETWEEN r.y - 50 AND r.y + side + 50),
    scored AS (SELECT *, CASE WHEN away > 0 THEN 40 + 30 / (1 + log10(1 + side * side / 10000)) + 20 * (1 - away / 50) WHEN ratio <= 0.7 THEN 100 - 50 * ratio ELSE 50 - 25 * (ratio - 0.7) END AS score FROM near WHERE away <= 50),
    best AS (SELECT *, row_number() OVER (PARTITION BY map_id, ord ORDER BY score DESC, room_ord) AS n FROM scored)"""


def _text_matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("c_custkey"), F.col("o_custkey")
    side = (1 + k % 3) * 10
    corner = lambda dx, dy: rings.point(F.floor(k / 5) % 12 * 90 + dx, F.floor(k / 60) * 90 + dy)
    ring = F.array(corner(F.lit(0), F.lit(0)), corner(side, F.lit(0)), corner(side, side), corner(F.lit(0), side))
    rooms_ = table(spark, d, "customer").select(F.concat(F.lit("m"), k % 5).alias("map_id"), k.alias("ord"), F.concat(F.lit("r"), k).alias("id"), ring.alias("ring"))
    o = F.col("o_orderkey")
    at = rings.point(F.floor(c / 5) % 12 * 90 + o % 97 - 40 + 0.37, F.floor(c / 60) * 90 + o * 7 % 89 - 35 + 0.61)
    texts = table(spark, d, "orders").select(F.concat(F.lit("m"), c % 5).alias("map_id"), o.alias("ord"), F.concat(F.lit("t"), o).alias("text"), at.alias("p"))
    return texts, Written(labels.matches(texts, rooms_), "matches").df


@query(
    "text_matches",
    f"""{_MATCHING} SELECT map_id, ord, room_id, CASE WHEN away > 0 THEN 'nearby' ELSE 'inside' END AS match_type, round(score, 5) AS score, CASE WHEN away > 0 THEN round(away, 5) END AS distance, CASE WHEN away = 0 THEN round(ratio, 5) END AS distance_ratio FROM best WHERE n = 1""",
)
def text_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every order's text goes to the room that holds it or lies nearest by score."""
    _, found = _text_matches(spark, d)
    return found.select("map_id", "ord", "room_id", "match_type", *(F.round(c, 5).alias(c) for c in ("score", "distance", "distance_ratio")))


@query(
    "text_match_statistics",
    f"""{_MATCHING} SELECT map_id, count(*) AS total, count(score) AS matched, count(*) FILTER (score >= 70) AS high_quality, count(*) - count(score) AS unmatched, round(count(score) / count(*), 6) AS match_rate
    FROM texts LEFT JOIN (FROM best WHERE n = 1) USING (map_id, ord) GROUP BY map_id""",
)
def text_match_statistics(spark: SparkSession, d: str) -> DataFrame:
    return labels.match_statistics(*_text_matches(spark, d)).withColumn("match_rate", F.round("match_rate", 6))


@query(
    "matched_names",
    f"""{_MATCHING}, sure AS (SELECT *, 't' || ord AS text FROM best WHERE n = 1), inner_ AS (SELECT map_id, room_id, list(text ORDER BY score DESC, ord) AS l FROM sure WHERE away = 0 GROUP BY ALL), outer_ AS (SELECT map_id, room_id, min_by(text, (-score, ord)) AS t FROM sure WHERE away > 0 GROUP BY ALL)
    SELECT coalesce(i.map_id, o.map_id) AS map_id, coalesce(i.room_id, o.room_id) AS id, coalesce(l[1], t) AS new_name FROM inner_ i FULL JOIN outer_ o ON i.map_id = o.map_id AND i.room_id = o.room_id""",
)
def matched_names(spark: SparkSession, d: str) -> DataFrame:
    """The best text inside each room, or else the best one near it."""
    return labels.new_names(_text_matches(spark, d)[1], first_only=True)
