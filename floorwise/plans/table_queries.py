"""The engine's operators on the driver's tables, one query each, with the same in SQL.

Rule checks, lookups, windows and geometry folds are the library's patterns applied to the
star schema; violations are made by restricting the referenced side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorwise.functions import rings
from floorwise.plans.registry import query, table


@query(
    "ref_integrity_anti",
    """SELECT 'order' AS kind, l_orderkey AS ref, count(*) AS findings FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey
       UNION ALL SELECT 'customer', o_custkey, count(*) FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""",
)
def ref_integrity_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref"))
    final = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ref"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("ref"))
    solvent = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ref"))
    missing = lambda a, b, kind: a.join(b, "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("findings")).select(F.lit(kind).alias("kind"), "ref", "findings")
    return missing(lines, final, "order").unionByName(missing(orders, solvent, "customer"))


@query(
    "required_fields",
    """SELECT 'props' AS field, count(*) AS missing FROM events WHERE props IS NULL
       UNION ALL SELECT 'value', count(*) FROM events WHERE value < 5
       UNION ALL SELECT 'lang', count(*) FROM documents WHERE n_chars < 400
       UNION ALL SELECT 'label', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    events, docs, labels = (table(spark, d, t) for t in ("events", "documents", "labels"))
    absent = lambda *pairs: F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)), lambda x: x.isNotNull()))
    of_events = events.select(absent(("props", F.col("props").isNull()), ("value", F.col("value") < 5)).alias("field"))
    known = labels.select("doc_id", F.lit(True).alias("labelled")).distinct()
    of_docs = docs.select("doc_id", "n_chars").join(known, "doc_id", "left").select(absent(("lang", F.col("n_chars") < 400), ("label", F.col("labelled").isNull())).alias("field"))
    fields = spark.createDataFrame([(f,) for f in ("props", "value", "lang", "label")], "field string")
    counted = of_events.unionByName(of_docs).groupBy("field").agg(F.count("*").alias("n"))
    return fields.join(counted, "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("missing"))


@query("domain_check", "SELECT event_type, count(*) AS findings FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY event_type")
def domain_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(~F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count("*").alias("findings"))


@query("range_check", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size NOT BETWEEN 5 AND 45 OR p_retailprice NOT BETWEEN 950 AND 1800")
def range_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size not between 5 and 45 or p_retailprice not between 950 and 1800").select("p_partkey", "p_size", "p_retailprice")


@query(
    "closed_ring",
    """SELECT l_orderkey, count(*) AS n_refs, arg_min(l_suppkey, (l_linenumber, l_suppkey)) = arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS closed
       FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3""",
)
def closed_ring(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_suppkey")
    refs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_refs"), (F.min_by("l_suppkey", order) == F.max_by("l_suppkey", order)).alias("closed"))
    return refs.where("n_refs >= 3")


@query("count_by_level", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def count_by_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "severity_pivot",
    """SELECT o_orderpriority AS category, o_orderstatus AS level, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS errors
       FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
)
def severity_pivot(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("level"), "o_totalprice")
    return orders.rollup("category", "level").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("errors"))


@query(
    "avg_size_by_group",
    "SELECT o_orderstatus, round(avg(n), 4) AS avg_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1",
)
def avg_size_by_group(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(sizes, "o_orderkey").groupBy("o_orderstatus").agg(F.round(F.avg("n"), 4).alias("avg_lines"))


@query(
    "undirected_degree",
    """WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)
       SELECT a AS node, count(DISTINCT b) AS degree FROM e GROUP BY a""",
)
def undirected_degree(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


@query("average_degree", "SELECT round(avg(n), 4) AS avg_connections FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def average_degree(spark: SparkSession, d: str) -> DataFrame:
    degrees = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").count()
    return degrees.agg(F.round(F.avg("count"), 4).alias("avg_connections"))


@query(
    "duplicate_in_group",
    "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1",
)
def duplicate_in_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("n")).where("n > 1")


@query("singleton_group", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2 HAVING count(*) < 2")
def singleton_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order")).where("n < 2").drop("n")


@query(
    "first_match_lookup",
    """SELECT o_orderkey, o_orderstatus, s AS expected FROM orders JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) USING (o_custkey)
       WHERE o_orderstatus <> s""",
)
def first_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    first = orders.groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("expected"))
    return orders.join(first, "o_custkey").where("o_orderstatus <> expected").select("o_orderkey", "o_orderstatus", "expected")


@query(
    "last_match_lookup",
    """SELECT o_orderkey, s AS synced FROM orders JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS s FROM orders GROUP BY 1) USING (o_custkey) WHERE o_orderpriority <> s""",
)
def last_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("synced"))
    return orders.join(last, "o_custkey").where("o_orderpriority <> synced").select("o_orderkey", "synced")


@query(
    "adjacent_pairs",
    "SELECT user_id, event_id AS lower, upper FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS upper FROM events) WHERE upper IS NOT NULL",
)
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("lower"), F.lead("event_id").over(w).alias("upper")).where("upper is not null")


@query(
    "adjacent_band",
    "SELECT a.p_partkey, min(b.p_partkey) AS first_neighbour FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) = 1 GROUP BY 1",
)
def adjacent_band(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    first = parts.groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("other"))
    bands = first.select("other", "p_brand", "p_type", F.explode(F.array(F.col("p_size") - 1, F.col("p_size") + 1)).alias("p_size"))
    return parts.join(bands, ["p_brand", "p_type", "p_size"]).groupBy("p_partkey").agg(F.min("other").alias("first_neighbour"))


@query(
    "theta_pairs",
    """SELECT a.s_suppkey AS ref, b.s_suppkey AS target FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal""",
)
def theta_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    a = s.select("s_nationkey", F.col("s_suppkey").alias("ref"), F.col("s_acctbal").alias("x"))
    b = s.select("s_nationkey", F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("y"))
    return a.join(b, "s_nationkey").where("x < y").select("ref", "target")


@query(
    "zip_vertices",
    """SELECT a.vec_id, round(avg(x - y), 4) AS mean_offset FROM
       (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 2 = 0) a JOIN
       (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) AS i FROM embeddings) b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1""",
)
def zip_vertices(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    paired = e.where("vec_id % 2 = 0").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    offsets = F.zip_with("embedding", "other", lambda x, y: x.cast("double") - y.cast("double"))
    return paired.select("vec_id", F.round(F.aggregate(offsets, F.lit(0.0), lambda a, x: a + x) / F.size(offsets), 4).alias("mean_offset"))


@query(
    "offset_sigma_weighted",
    """WITH v AS (SELECT event_type, user_id, value FROM events),
       s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM v GROUP BY 1),
       k AS (SELECT v.*, s.m FROM v JOIN s USING (event_type) WHERE abs(value - m) < 1.5 * sd),
       c AS (SELECT event_type, count(*) AS kept FROM k GROUP BY 1),
       u AS (SELECT v.* FROM v JOIN s USING (event_type) LEFT JOIN c USING (event_type) WHERE coalesce(kept, 0) * 2 < n OR abs(value - m) < 1.5 * sd),
       per AS (SELECT event_type, user_id, avg(value) AS a, CASE WHEN user_id % 3 = 0 THEN 2.0 WHEN user_id % 3 = 1 THEN 1.5 ELSE 1.0 END AS w FROM u GROUP BY 1, 2)
       SELECT event_type, round(sum(a * w) / sum(w), 4) AS weighted_offset FROM per GROUP BY 1""",
)
def offset_sigma_weighted(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select("event_type", "user_id", "value")
    s = v.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    inside = F.abs(F.col("value") - F.col("m")) < 1.5 * F.col("sd")
    kept = v.join(s, "event_type").groupBy("event_type").agg(F.count_if(inside).alias("kept"))
    used = v.join(s.join(kept, "event_type"), "event_type").where((F.col("kept") * 2 < F.col("n")) | inside)
    weight = F.when(F.col("user_id") % 3 == 0, 2.0).when(F.col("user_id") % 3 == 1, 1.5).otherwise(1.0)
    per = used.groupBy("event_type", "user_id").agg(F.avg("value").alias("a")).withColumn("w", weight)
    return per.groupBy("event_type").agg(F.round(F.sum(F.col("a") * F.col("w")) / F.sum("w"), 4).alias("weighted_offset"))


@query(
    "percentile_bounds",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM orders)
       SELECT round(min(o_totalprice), 4) AS min_x, round(max(o_totalprice), 4) AS max_x, count(*) AS kept FROM orders, q WHERE o_totalprice BETWEEN lo AND hi""",
)
def percentile_bounds(spark: SparkSession, d: str) -> DataFrame:
    from floorwise.operators.statistics import trimmed

    kept = trimmed(table(spark, d, "orders").select("o_totalprice"), ["o_totalprice"])
    return kept.agg(F.round(F.min("o_totalprice"), 4).alias("min_x"), F.round(F.max("o_totalprice"), 4).alias("max_x"), F.count("*").alias("kept"))


@query("bbox_centre", "SELECT user_id, round((min(value) + max(value)) / 2, 4) AS cx, round((min(event_id) + max(event_id)) / 2, 4) AS cy FROM events GROUP BY 1")
def bbox_centre(spark: SparkSession, d: str) -> DataFrame:
    middle = lambda c: F.round((F.min(c) + F.max(c)) / 2, 4)
    return table(spark, d, "events").groupBy("user_id").agg(middle("value").alias("cx"), middle("event_id").alias("cy"))


_RING = """WITH e AS (SELECT user_id, event_id, value AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events),
    s AS (SELECT user_id, x * coalesce(lead(y) OVER w, first_value(y) OVER w) - coalesce(lead(x) OVER w, first_value(x) OVER w) * y AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _user_rings(spark: SparkSession, d: str) -> DataFrame:
    points = F.struct("event_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    ring = F.array_sort(F.collect_list(points))
    return table(spark, d, "events").groupBy("user_id").agg(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


@query("shoelace_area", _RING + " SELECT user_id, round(abs(sum(c)) / 2, 3) AS area FROM s GROUP BY 1")
def shoelace_area(spark: SparkSession, d: str) -> DataFrame:
    return _user_rings(spark, d).select("user_id", F.round(rings.area(F.col("ring")), 3).alias("area"))


@query("signed_winding", _RING + " SELECT user_id, CASE WHEN sum(c) > 0 THEN 'ccw' ELSE 'cw' END AS winding FROM s GROUP BY 1")
def signed_winding(spark: SparkSession, d: str) -> DataFrame:
    return _user_rings(spark, d).select("user_id", F.when(rings.signed_area(F.col("ring")) > 0, "ccw").otherwise("cw").alias("winding"))


@query(
    "polygon_similarity_dedup",
    "SELECT min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY lower(text)",
)
def polygon_similarity_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.lower("text").cast("binary"), 256).alias("signature"))
    return docs.groupBy("signature").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).select("kept", "copies")


@query(
    "topk_per_group",
    "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10",
)
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("r", F.row_number().over(w)).where("r <= 10")
    return ranked.select("o_custkey", "o_orderkey", F.col("r").cast("long").alias("r"))


@query(
    "best_candidate",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <= 0.05 THEN 100 - 50 * l_discount * 10 ELSE 50 - 25 * (l_discount * 10 - 0.7) END AS score FROM lineitem)
       SELECT l_orderkey, round(max(score), 4) AS score, min(l_linenumber) FILTER (WHERE score = m) AS l_linenumber FROM (SELECT *, max(score) OVER (PARTITION BY l_orderkey) AS m FROM s) GROUP BY l_orderkey""",
)
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.col("l_discount") * 10
    score = F.when(F.col("l_discount") <= 0.05, 100 - 50 * F.col("l_discount") * 10).otherwise(50 - 25 * (ratio - 0.7))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))
    best = lines.groupBy("l_orderkey").agg(F.max(F.struct("score", (-F.col("l_linenumber")).alias("order"))).alias("b"))
    return best.select("l_orderkey", F.round("b.score", 4).alias("score"), (-F.col("b.order")).alias("l_linenumber"))


@query(
    "spatial_threshold_join",
    """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
       SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.02""",
)
def spatial_threshold_join(spark: SparkSession, d: str) -> DataFrame:
    from floorwise.operators.spatial import within_distance

    points = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return within_distance(points, points, "vec_id", 0.02).where("a < b").select("a", "b")


@query(
    "farthest_pair",
    """WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
       SELECT a.label, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 4) AS width FROM p a JOIN p b ON a.label = b.label GROUP BY 1""",
)
def farthest_pair(spark: SparkSession, d: str) -> DataFrame:
    from floorwise.operators.spatial import widths

    points = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return widths(points, "label").select("label", F.round("width", 4).alias("width"))


@query(
    "token_score",
    """WITH t AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(upper(p_name || ' ' || p_type), '[-_$ ]+'), lambda x: x <> ''))) AS token FROM part)
       SELECT p_partkey, CAST(sum(CASE token WHEN 'STEEL' THEN 5 WHEN 'BRASS' THEN 3 WHEN 'RED' THEN -2 WHEN 'BLUE' THEN -1 WHEN 'SMALL' THEN 1 ELSE 0 END) AS BIGINT) AS score FROM t GROUP BY 1""",
)
def token_score(spark: SparkSession, d: str) -> DataFrame:
    weights = F.create_map(*(F.lit(x) for kv in {"STEEL": 5, "BRASS": 3, "RED": -2, "BLUE": -1, "SMALL": 1}.items() for x in kv))
    tokens = F.array_distinct(F.filter(F.split(F.upper(F.concat_ws(" ", "p_name", "p_type")), "[-_$ ]+"), lambda t: t != ""))
    return table(spark, d, "part").select("p_partkey", F.aggregate(tokens, F.lit(0), lambda a, t: a + F.coalesce(F.try_element_at(weights, t), F.lit(0))).cast("long").alias("score"))


_PART_TOKENS = "SELECT unnest(list_filter(regexp_split_to_array(upper(p_name || ' ' || p_type), '[-_$ ]+'), lambda x: x <> '')) AS token FROM part"


@query("token_topk", f"SELECT token, count(*) AS n FROM ({_PART_TOKENS}) GROUP BY 1 ORDER BY n DESC, token LIMIT 30")
def token_topk(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.filter(F.split(F.upper(F.concat_ws(" ", "p_name", "p_type")), "[-_$ ]+"), lambda t: t != "")
    return table(spark, d, "part").select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(30)


@query(
    "positional_tokens",
    """SELECT pos, token, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS token, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS pos FROM part) GROUP BY 1, 2""",
)
def positional_tokens(spark: SparkSession, d: str) -> DataFrame:
    placed = table(spark, d, "part").select(F.posexplode(F.split("p_type", " ")).alias("pos", "token"))
    return placed.groupBy(F.col("pos").cast("long").alias("pos"), "token").agg(F.count("*").alias("n"))


@query(
    "regex_class",
    """SELECT CASE WHEN regexp_matches(p_brand, '^Brand#[12]') THEN 'low' WHEN regexp_matches(p_brand, '^Brand#[3-5]') THEN 'high' ELSE 'unknown' END AS kind, count(*) AS n FROM part GROUP BY 1""",
)
def regex_class(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_brand").rlike("^Brand#[12]"), "low").when(F.col("p_brand").rlike("^Brand#[3-5]"), "high").otherwise("unknown")
    return table(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("regex_extract_level", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS level FROM customer")
def regex_extract_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).try_cast("long").alias("level"))


@query("synonym_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def synonym_map(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), "o_orderstatus").alias("status"))


@query(
    "substring_subsume",
    """WITH t AS (SELECT DISTINCT n_regionkey, n_name AS x FROM nation UNION SELECT DISTINCT n_regionkey, substr(n_name, 1, 3) FROM nation)
       SELECT n_regionkey, string_agg(x, ' ' ORDER BY x) AS names FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.n_regionkey = t.n_regionkey AND o.x <> t.x AND contains(o.x, t.x)) GROUP BY 1""",
)
def substring_subsume(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    every = nation.select("n_regionkey", F.explode(F.array("n_name", F.substring("n_name", 1, 3))).alias("x")).groupBy("n_regionkey").agg(F.array_sort(F.collect_set("x")).alias("ts"))
    kept = F.expr("filter(ts, t -> not exists(ts, o -> o <> t and contains(o, t)))")
    return every.select("n_regionkey", F.array_join(kept, " ").alias("names"))


@query(
    "rename_propagation",
    "SELECT o_orderkey, coalesce('VIP ' || c.c_name, 'room_' || o_custkey) AS from_name FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_acctbal > 5000",
)
def rename_propagation(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("VIP "), "c_name").alias("new"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(changes, "o_custkey", "left").select("o_orderkey", F.coalesce("new", F.concat(F.lit("room_"), "o_custkey")).alias("from_name"))


@query(
    "id_remap",
    """WITH m AS (SELECT p_partkey, -row_number() OVER (ORDER BY p_partkey) AS new_id FROM part WHERE p_size > 25)
       SELECT l_orderkey, l_linenumber, coalesce(new_id, l_partkey) AS ref FROM lineitem LEFT JOIN m ON p_partkey = l_partkey""",
)
def id_remap(spark: SparkSession, d: str) -> DataFrame:
    from floorwise.operators.ids import numbered

    ids = numbered(table(spark, d, "part").where("p_size > 25").select("p_partkey"), ["p_partkey"], "n")
    ids = ids.select(F.col("p_partkey").alias("l_partkey"), (-F.col("n")).alias("new_id"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(ids, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("new_id", "l_partkey").alias("ref"))


@query(
    "set_compare",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey % 2 = 1), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_suppkey % 2 = 0)
       SELECT 'both' AS side, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'second', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
)
def set_compare(spark: SparkSession, d: str) -> DataFrame:
    odd = F.col("l_suppkey") % 2 == 1
    sides = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(odd).alias("a"), F.bool_or(~odd).alias("b"))  # one shuffle for all three sets
    return sides.select(F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("side"), "k")


@query(
    "edge_parity",
    "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem GROUP BY 1, 2 HAVING count(*) % 2 = 1",
)
def edge_parity(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"))
    return edges.groupBy("a", "b").agg(F.count("*").alias("n")).where("n % 2 = 1").select("a", "b")


@query(
    "upsert_tags",
    """SELECT p_partkey, k, v FROM (SELECT p_partkey, 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'door', 'yes' FROM part
       UNION ALL SELECT p_partkey, 'type', CASE WHEN p_size > 25 THEN 'large' ELSE p_type END FROM part)""",
)
def upsert_tags(spark: SparkSession, d: str) -> DataFrame:
    from floorwise.functions.tags import upserted

    tags = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    changed = upserted(F.when(F.col("p_size") > 25, upserted(tags, {"type": F.lit("large")})).otherwise(tags), {"door": F.lit("yes")})
    return table(spark, d, "part").select("p_partkey", F.explode(changed).alias("k", "v"))


@query(
    "knee_point",
    """WITH r AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i, count(*) OVER () AS n FROM part),
       e AS (SELECT *, first_value(v) OVER (ORDER BY i) AS v1, last_value(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vn FROM r),
       x AS (SELECT p_partkey, i, round(abs((vn - v1) * (i - 1) - (n - 1) * (v - v1)) / sqrt((vn - v1) * (vn - v1) + (n - 1) * (n - 1)), 6) AS dist FROM e)
       SELECT p_partkey, i AS rank FROM x ORDER BY dist DESC, i LIMIT 1""",
)
def knee_point(spark: SparkSession, d: str) -> DataFrame:
    from floorwise.operators.statistics import knee

    return knee(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v")), "v", "p_partkey").select("p_partkey", "rank")


@query(
    "stats_excluding_top3",
    """WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
       SELECT p_brand, round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(avg(v), 6) AS mean, round(median(v), 6) AS mid FROM r WHERE n > 3 GROUP BY 1""",
)
def stats_excluding_top3(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    rest = table(spark, d, "part").withColumn("n", F.row_number().over(w)).where("n > 3").groupBy("p_brand")
    v = "p_retailprice"
    return rest.agg(F.round(F.min(v), 4).alias("lo"), F.round(F.max(v), 4).alias("hi"), F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("mid"))


@query("running_length", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS upto FROM events")
def running_length(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 2).alias("upto"))


@query(
    "components",
    """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS a, l_orderkey + 7 * (l_suppkey % 3) AS b FROM lineitem),
       n AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
       r(node, label) USING KEY (node) AS (
           SELECT a, min(a) FROM n GROUP BY a
           UNION (SELECT n.b, min(x.label) FROM r x JOIN n ON n.a = x.node JOIN recurring.r y ON y.node = n.b WHERE x.label < y.label GROUP BY n.b))
       SELECT node, label FROM r""",
)
def components(spark: SparkSession, d: str) -> DataFrame:
    from floorwise.operators.graph import components as labelled

    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 7 * (F.col("l_suppkey") % 3)).alias("b")).distinct()
    return labelled(edges).select("node", "label")


@query(
    "degree_class",
    "SELECT CASE WHEN n = 1 THEN 'dead_end' WHEN n = 2 THEN 'path' ELSE 'junction' END AS class, count(*) AS nodes FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) GROUP BY 1",
)
def degree_class(spark: SparkSession, d: str) -> DataFrame:
    degrees = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    return degrees.groupBy(F.when(F.col("n") == 1, "dead_end").when(F.col("n") == 2, "path").otherwise("junction").alias("class")).agg(F.count("*").alias("nodes"))


@query(
    "sweep_params",
    """SELECT p_partkey, alpha, round(greatest(0.5, sqrt(alpha * 4 * res * res) - 0.1), 4) AS door_width FROM
       (SELECT p_partkey, 0.04 * CASE WHEN p_size > 40 THEN 0.8 WHEN p_size < 20 THEN 1.2 ELSE 1.0 END AS res, unnest([200, 400, 600]) AS alpha FROM part)""",
)
def sweep_params(spark: SparkSession, d: str) -> DataFrame:
    scale = F.when(F.col("p_size") > 40, 0.8).when(F.col("p_size") < 20, 1.2).otherwise(1.0)
    runs = table(spark, d, "part").select("p_partkey", (0.04 * scale).alias("res"), F.explode(F.array(*map(F.lit, (200, 400, 600)))).alias("alpha"))
    return runs.select("p_partkey", "alpha", F.round(F.greatest(F.lit(0.5), F.sqrt(F.col("alpha") * 4 * F.col("res") * F.col("res")) - 0.1), 4).alias("door_width"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(
    "page_xml_scan",
    "SELECT page_id, pos, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) AS pos FROM pages)",
)
def page_xml_scan(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return links.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "href")


@query(
    "wgs84_forward",
    """WITH p AS (SELECT c_custkey, radians(31.0 + c_nationkey * 0.001) AS lat, radians(121.0 + c_acctbal / 1e6) AS lon FROM customer)
       SELECT c_custkey, round(6378137.0 * (1 - 6.69437999e-3) / pow(1 - 6.69437999e-3 * sin(lat) * sin(lat), 1.5) * (lat - radians(31.0)), 3) AS y,
              round(6378137.0 / sqrt(1 - 6.69437999e-3 * sin(lat) * sin(lat)) * cos(lat) * (lon - radians(121.0)), 3) AS x FROM p""",
)
def wgs84_forward(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select("c_custkey", F.radians(31.0 + F.col("c_nationkey") * 0.001).alias("lat"), F.radians(121.0 + F.col("c_acctbal") / 1e6).alias("lon"))
    inner = 1 - 6.69437999e-3 * F.sin("lat") * F.sin("lat")
    north = 6378137.0 * (1 - 6.69437999e-3) / F.pow(inner, F.lit(1.5)) * (F.col("lat") - F.radians(F.lit(31.0)))
    east = 6378137.0 / F.sqrt(inner) * F.cos("lat") * (F.col("lon") - F.radians(F.lit(121.0)))
    return p.select("c_custkey", F.round(north, 3).alias("y"), F.round(east, 3).alias("x"))
