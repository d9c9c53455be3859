"""Table queries over whole tables, against brute force."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from floorwise.plans import drawing_queries, file_queries, map_queries, registry, shape_queries, table_queries  # noqa: F401  they register their queries
from tests.conftest import SMALL


def test_components_of_all_lines(spark):
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        low, high = sorted((find(r[0]), find(r[0] + 7 * (r[1] % 3))))
        root[high] = low
    assert {(r.node, r.label) for r in table_queries.components(spark, SMALL).collect()} == {(n, find(n)) for n in root}


def test_farthest_pair_of_all_points(spark, tmp_path):
    rows = [(i, i % 3, [float(i * i % 101), float(i * 37 % 89)]) for i in range(600)] + [(900, 0, [500.0, 0.0]), (901, 7, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    points = defaultdict(list)
    for _, label, point in rows:
        points[label].append(point)
    want = {label: round(max(math.dist(p, q) for p in some for q in some), 4) for label, some in points.items()}
    assert {r.label: r.width for r in table_queries.farthest_pair(spark, str(tmp_path)).collect()} == want


def test_copies_differ_in_the_middle(spark, tmp_path):
    edge = "x" * 40
    rows = [(1, edge + " one " + edge), (2, edge + " two " + edge), (3, edge + " ONE " + edge)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.kept, r.copies) for r in table_queries.polygon_similarity_dedup(spark, str(tmp_path)).collect()} == {(1, 2), (2, 1)}


def test_neighbouring_sizes_meet_as_groups(spark, tmp_path):
    rows = [(i, "b", "t" if i % 5 else "u", i * i % 7) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    frame = table_queries.adjacent_band(spark, str(tmp_path))
    want = {a[0]: min(b[0] for b in rows if a[2] == b[2] and abs(a[3] - b[3]) == 1) for a in rows if any(a[2] == b[2] and abs(a[3] - b[3]) == 1 for b in rows)}
    assert {r.p_partkey: r.first_neighbour for r in frame.collect()} == want
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]  # one row of each size is joined, not all of its parts


@pytest.mark.parametrize("name", ["map_findings", "map_fixes", "map_renumbered", "graph_chains", "name_repairs", "closed_ring", "drawing_runs", "drawing_images", "drawing_filter_logs", "drawing_file_entities", "map_file_ways", "map_file_order", "file_room_areas", "file_layer_lists"])
def test_queries_equal_their_sql(spark, name):
    frame = registry.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    connection = duckdb.connect()
    for table in ("nation", "customer", "orders", "lineitem", "part"):
        connection.execute(f"CREATE VIEW {table} AS FROM '{SMALL}/{table}.parquet'")
    found = connection.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    rows = Counter(tuple(r) for r in frame.select(columns).collect())
    assert rows == Counter(found) and rows
