"""Queries on rows that only larger tables have, against their SQL."""

import random
from collections import Counter

import duckdb
import pyarrow as pa

from floorwise.operators import graph, merge
from floorwise.plans import halfedge_queries, shape_queries  # noqa: F401  they register their queries
from floorwise.plans.registry import ORACLES, QUERIES


def equals_sql(spark, folder, name, **tables):
    """The query's rows over made tables, which must be those of its SQL."""
    connection = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet/*.parquet'")
    frame = QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    rows = Counter(tuple(r) for r in frame.select(columns).collect())
    found = connection.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert rows == Counter(found) and rows
    return rows


def test_edges_that_share_a_number_stay_apart(spark, tmp_path):
    # order 1 with part 1000005 and order 2 with part 5 are both edge 2000005 of map g0
    lines = [(1, 1_000_005, 30.0, 0.1), (2, 5, 3.0, 0.1), (2, 6, 3.0, 0.1), (3, 5, 3.0, 0.1)]
    found = equals_sql(spark, tmp_path, "graph_dead_ends", lineitem=(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double"))
    assert sum(found.values()) == 4


def test_a_point_on_the_boundary(spark, tmp_path):
    # (25.5, 48.25) lies on the edge from (25.25, 48) to (26.25, 49) of user 2's ring; the last vertex has y = 0
    events = [(48, 1, 25.0), (49, 1, 26.0), (97, 1, 40.0), (0, 2, 0.0), (48, 2, 25.25), (49, 2, 26.25), (194, 2, 40.0)]
    found = equals_sql(spark, tmp_path, "ring_points", events=(events, "event_id long, user_id long, value double"))
    assert {away for away, _, user in found if user == 2} == {0.0}


def test_equal_anchors_are_paired_once(spark):
    ring = lambda x: [{"x": float(x + i), "y": float(x * i)} for i in range(3)]
    anchors = [("a", i, f"L{i % 2}", str(i % 3), ring(i % 4), "elevator") for i in range(240)] + [("b", i, f"L{i % 2}", str(i % 3), ring(i % 5), "elevator") for i in range(150)]
    found = spark.createDataFrame(anchors, "map_id string, ord int, name string, level string, ring array<struct<x:double,y:double>>, type string")
    details = merge.offset_details(found.where("map_id = 'a'"), found.where("map_id = 'b'"))
    pairs = [(r, t) for r in anchors if r[0] == "a" for t in anchors if t[0] == "b" and t[2] == r[2] and t[3] != r[3]]
    rows = details.collect()
    assert sum(r.pairs for r in rows) == len(pairs) and len(rows) < 250 < len(pairs)
    want = Counter((t[2], round(sum(p["y"] - q["y"] for p, q in zip(r[4], t[4])) / 3, 6)) for r, t in pairs)
    got = Counter()
    for r in rows:
        got[r.name, round(r.lat_offset, 6)] += r.pairs
    assert got == want
    mean = sum(sum(n * v for (name, v), n in want.items() if name == x) / sum(n for (name, _), n in want.items() if name == x) for x in ("L0", "L1")) / 2
    assert abs(merge.offsets(details).first().lat_offset - mean) < 1e-9


def test_small_maps_are_searched_in_one_row(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(f"m{m}", i, f"v{draw.randrange(9)}", f"v{draw.randrange(9)}", float(draw.randrange(-1, 4))) for m in range(12) for i in range(m)] + [("m3", 99, None, "v1", 1.0)]
    edges = spark.createDataFrame(rows, "map_id string, edge_id int, a string, b string, length double")
    starts = edges.where("edge_id < 3").selectExpr("map_id", "a AS start").distinct().unionByName(spark.createDataFrame([("alone", "v0")], "map_id string, start string"))
    closed = starts.selectExpr("map_id", "start", "'v4' AS node")
    doors = edges.selectExpr("map_id", "a AS passage_id", "edge_id % 2 AS room_id")
    rooms = edges.selectExpr("map_id", "a", "b", "length", "edge_id % 2 AS room_id")

    def every():
        far = [graph.distances_from(edges, starts, closed=c, predecessors=True).collect() for c in (None, closed)]
        ways = graph.passage_edges(rooms, doors).collect()
        searched = [part.collect() for part in graph.exit_searches(edges.where("a is not null"))]
        return [Counter(str(sorted(r.asDict().items())) for r in part) for part in (*far, ways, *searched)]

    small = every()
    monkeypatch.setattr(graph, "FEW_ARCS", 0)
    assert small == every() and all(small)


def test_many_small_maps_are_searched_at_once(monkeypatch):
    draw, maps = random.Random(5), []
    for _ in range(40):
        nodes = [f"v{i}" for i in range(draw.randrange(1, 8))] + [None]
        arcs = [(draw.choice(nodes), draw.choice(nodes), float(draw.randrange(4)) / 3) for _ in range(draw.randrange(1, 20))]
        maps.append(([(s, s, 0.0, 0, None) for s in nodes[:3]] + [("v0", "v1", 0.5, 1, "v0")], arcs, [("v0", draw.choice(nodes[:-1]))]))
    listed = lambda i, *kinds: pa.array([[dict(zip("abcde", row)) for row in m[i]] for m in maps], pa.list_(pa.struct(list(zip("abcde", kinds)))))
    text, number = pa.string(), pa.float64()
    columns = graph._from_starts(listed(0, text, text, number, pa.int32(), text), listed(1, text, text, number), listed(2, text, text), False)
    found = {(m, s, n): (d, h, v) for m, s, n, d, h, v in zip(*(c.to_pylist() for c in columns))}
    want = {}
    for m, (starts, arcs, closed) in enumerate(maps):
        for s in {row[0] for row in starts}:
            best = {}
            todo = [(d, h, v is not None, v, n) for a, n, d, h, v in starts if a == s]
            while todo:  # every label is tried until none gets better
                d, h, later, v, n = todo.pop()
                if n not in best or (d, h, later, v or "") < best[n]:
                    best[n] = (d, h, later, v or "")
                    todo += [(d + x, h + 1, True, n, b) for a, b, x in arcs if a == n and n is not None and (s, n) not in closed]
            want |= {(m, s, n): (d, h, v if later else None) for n, (d, h, later, v) in best.items()}
    assert found == want and len(found) == len(columns[0]) > 200


def test_what_exits_reach_is_landed_once_with_their_vertex(spark, monkeypatch):
    landed, written = {}, graph.Written
    monkeypatch.setattr(graph, "Written", lambda df, name, *keep: landed.setdefault(name, df.columns) and written(df, name, *keep))
    edges = spark.createDataFrame([("m", i, i, (i + 1) % 5, 1.0) for i in range(5)], "map_id string, edge_id int, a int, b int, length double")
    far, exits, loops = graph.exit_searches(edges)
    assert "home" in landed["beyond"] and {"inner", "sizes", "nearest"} <= set(landed)
    assert far.count() == 40 and exits.where("loop_back and next_major_distance = 1").count() == 10 and {(r.distance, r.hops) for r in loops.collect()} == {(5.0, 5)}
