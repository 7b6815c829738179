"""Queries on keys and shapes that the given tables reach only in larger copies, held against their SQL."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows
from wayfold.operators import areas, covering, tagging
from wayfold.operators.naming import Variety
from wayfold.plans import area_queries, check_queries, list_queries, schema_queries, search_queries, small_queries, tile_queries  # noqa: F401  register their queries
from wayfold.plans import queries as plans


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over tables (name: SQL that makes it) gives the rows of its SQL."""

    def run(name, **made):
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for table, sql in made.items():
            c.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        got, want = plans.QUERIES[name](spark, str(tmp_path)), c.sql(plans.SQL[name])
        return rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())

    return run


#: Orders on three sheets of the map, of which the first and the last have payloads in common.
SHEETS = "SELECT s * 524288 + k AS o_orderkey FROM range(0, 3000, 7) r(k), (VALUES (0), (1), (7)) t(s)"


def test_located_tiles_beyond_the_map(same):
    assert same("located_tiles", orders=SHEETS)


def test_leaves_of_tiles_beyond_the_map(same):
    assert same("tile_leaves", orders=SHEETS)


#: A pair of cells of T over a pair of U, all else V: the straight border of T and U and the way around have common ends.
TWINS = "SELECT k AS c_custkey, CASE WHEN k IN (410, 411, 140) THEN 'T' WHEN k IN (370, 371, 147) THEN 'U' ELSE 'V' END AS c_mktsegment FROM range(1200) r(k)"


def test_a_straight_border_beside_a_way_around_keeps_no_point(same):
    assert same("area_simplified", customer=TWINS)


def test_inside_points_of_twins(same):
    assert same("inside_points", customer=TWINS)


def test_holes_find_their_rings_without_trying_all():
    ring = lambda x, y, a: np.array([(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)])
    outers = [ring(2.0 * (k % 100), 2.0 * (k // 100), 1.0) for k in range(12_000)]
    holes = [ring(2.0 * (k % 100) + 0.25, 2.0 * (k // 100) + 0.25, 0.5)[::-1] for k in range(12_000)]
    start = time.process_time()
    assert areas.nested(outers + holes) == [(k, 0) for k in range(12_000)] + [(k, 1) for k in range(12_000)]
    assert time.process_time() - start < 3


def test_small_areas_cost_no_group_each(spark):
    ways = spark.createDataFrame([(k, "outer", 0, [k, k + 1, k + 2, k]) for k in range(0, 30, 3)], "area long, role string, place int, nodes array<long>")
    nodes = spark.createDataFrame([(k, k % 3 % 2 * 1.0, k % 3 // 2 * 1.0) for k in range(30)], "id long, lon double, lat double")
    got = areas.of_ways(ways, nodes)
    assert got.count() == 10 and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_cells_carry_the_box_of_their_polygon(spark):
    points = [(8.0, 54.0), (8.5, 54.0), (8.5, 54.2), (8.0, 54.2), (8.0, 54.0)]
    rings = spark.createDataFrame([("a", 0, 0, points, 0.2)], "tag string, polygon int, hole int, points array<struct<lon:double,lat:double>>, doubled double")
    assert {(r.west, r.south, r.east, r.north) for r in covering.covering(rings).collect()} == {(8.0, 54.0, 8.5, 54.2)}


#: Customer 3 has only an order without lines, so its relation has no position.
SCAN = {
    "part": "SELECT k AS p_partkey, 'old ring' AS p_name, 'LARGE' AS p_type FROM range(40) r(k)",
    "customer": "SELECT k AS c_custkey, 'C' || k AS c_name FROM range(5) r(k)",
    "orders": "SELECT k AS o_orderkey, k % 4 AS o_custkey, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM range(12) r(k) WHERE k % 4 <> 3 OR k = 3",
    "lineitem": "SELECT k // 3 AS l_orderkey, k AS l_partkey, (k % 3)::INTEGER AS l_linenumber FROM range(36) r(k) WHERE k // 3 <> 3",
}


def test_the_scan_counts_no_relation_without_a_position(same):
    assert same("candidate_scan", **SCAN)
    assert same("relation_positions", **SCAN)


def test_letters_of_the_first_block_are_not_split(spark):
    from wayfold.operators import checks

    df = spark.createDataFrame([("b", "aé\n😀 漢"), ("a", "я" * 50), ("c", ""), ("d", None), ("e", "ő")], "label string, text string")
    got = {r.block: r.label for r in checks.offending_blocks(df, "text", ["256-511"], "label").collect()}
    assert got == {"0-255": "b", "1024-1279": "a", "28416-28671": "b", "128512-128767": "b"}
    rows = spark.range(40).select(F.col("id").cast("string").alias("label"), F.repeat(F.lit("plain letters "), 20_000).alias("text"))
    found = checks.offending_blocks(rows, "text", [], "label")
    # Only what is left without the first block's letters is split.
    assert "split(regexp_replace(" in found._jdf.queryExecution().analyzed().toString()
    assert found.collect() == [("0-255", "0")]


def canonical(rows):
    """Polygons as sets of rings, however they are numbered."""
    by = {}
    for r in rows:
        by.setdefault((r.tag, r.polygon), []).append((r.hole > 0, tuple(r.ring), tuple((p.lon, p.lat) for p in r.points), r.doubled))
    assert all([h for h, *_ in sorted(v)].count(False) == 1 for v in by.values())
    return sorted((k[0], sorted(v)) for k, v in by.items())


@pytest.mark.parametrize("dense", [0.3, 0.62, 0.9])
def test_areas_traced_by_strips_equal_those_traced_whole(spark, monkeypatch, dense):
    """Before, all edges of a key were traced in one task, which at 6 GB took more memory than an executor has."""
    rng, side = random.Random(dense), 60
    corner = lambda x, y: y * 1000 + x
    cells = [(x, y) for x in range(side) for y in range(side) if rng.random() < dense]
    ways = [(f"{x},{y}", "outer", 0, [corner(x, y), corner(x + 1, y), corner(x + 1, y + 1), corner(x, y + 1), corner(x, y)]) for x, y in cells]
    groups = [(w[0], "small" if k % 40 == 0 else "large") for k, w in enumerate(ways)]
    nodes = spark.createDataFrame([(corner(x, y), float(x), float(y)) for x in range(side + 1) for y in range(side + 1)], "id long, lon double, lat double")
    given = spark.createDataFrame(ways, "area string, role string, place int, nodes array<long>"), nodes, spark.createDataFrame(groups, "area string, tag string")
    whole = areas.dissolved(*given).collect()
    monkeypatch.setattr(areas, "STRIP_EDGES", 900)
    monkeypatch.setattr(areas, "CUT_NODES", 30)
    got = areas.dissolved(*given).collect()
    assert canonical(got) == canonical(whole)
    numbers = {(r.tag, r.polygon, r.hole) for r in got}
    for tag in ("small", "large"):
        polygons = {p for t, p, _ in numbers if t == tag}
        assert polygons == set(range(len(polygons)))
        assert all({h for t, q, h in numbers if t == tag and q == p} == set(range(sum(1 for t, q, _ in numbers if t == tag and q == p))) for p in polygons)


def test_no_task_gets_all_edges_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(areas, "STRIP_EDGES", 200)
    monkeypatch.setattr(areas, "CUT_NODES", 20)
    edges = spark.range(4000).selectExpr("'a' AS tag", "id AS u", "(id + 1) % 4000 AS v", "0D AS x1", "CAST(id AS DOUBLE) AS y1", "0D AS x2", "CAST((id + 1) % 4000 AS DOUBLE) AS y2")
    strips = {r.strip: r.n for r in areas._in_strips(edges, "tag").groupBy("strip").agg(F.count("*").alias("n")).collect()}
    assert len(strips) > 10 and max(strips.values()) < 600


def test_many_points_in_a_ring_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    at = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    ring = np.column_stack([np.cos(at), np.sin(at)]) * rng.uniform(0.4, 1, 300)[:, None]
    ring = np.concatenate([ring, ring[:1]])
    x, y = rng.uniform(-1, 1, 2000), np.round(rng.uniform(-1, 1, 2000), 2)
    y[:50] = ring[:50, 1]
    monkeypatch.setattr(areas, "MOST_POINTS", 3)
    assert areas._which_inside(x, y, ring).tolist() == [areas._inside(*p, ring) for p in zip(x.tolist(), y.tolist(), strict=True)]


@pytest.fixture
def strips(monkeypatch):
    """Areas of over 200 edges are traced by strips; the strips of each key, as they come."""
    seen, in_strips = [], areas._in_strips
    monkeypatch.setattr(areas, "STRIP_EDGES", 200)
    monkeypatch.setattr(areas, "CUT_NODES", 20)
    monkeypatch.setattr(areas, "_in_strips", lambda *a: seen.append(in_strips(*a)) or seen[-1])
    return lambda: {r.tag: r.n for r in seen[-1].groupBy("tag").agg(F.countDistinct("strip").alias("n")).collect()}


def test_areas_are_simplified_by_strips(same, strips):
    assert same("area_simplified", customer=TWINS)
    assert strips()["V"] > 3


def test_inside_points_by_strips(same, strips):
    """Before, the edges of the largest area were all in one task."""
    assert same("inside_points", customer=TWINS)
    assert strips()["V"] > 3


def boxes(spark, n):
    """Squares of many sizes as rings."""
    rows = []
    for k in range(n):
        x, y, a = 8 + k % 20 / 10, 54 + k // 20 / 10, 0.08 / (1 + k % 7)
        rows.append(("ab"[k % 2], k, 0, [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)], 2 * a * a))
    return spark.createDataFrame(rows, "tag string, polygon int, hole int, points array<struct<lon:double,lat:double>>, doubled double")


def test_areas_of_few_edges_have_four_cells_at_most(spark):
    """Before, Python made up to twelve for a square, which at 6 GB are millions of areas."""
    rings = boxes(spark, 200)
    assert covering.covering(rings).groupBy("tag", "polygon").count().agg(F.max("count"), F.count("*")).first() == (4, 200)
    rng = random.Random(8)
    points = [(k, 8 + rng.random() * 2, 54 + rng.random()) for k in range(2000)] + [(5000, 8.0, 54.0), (5001, 8.08, 54.04), (5002, 180.0, 90.0)]
    want = {(p[0], r.polygon) for r in rings.collect() for p in points if r.points[0].lon <= p[1] <= r.points[2].lon and r.points[0].lat <= p[2] <= r.points[2].lat}
    got = covering.covered_by(spark.createDataFrame(points, "k int, lon double, lat double"), rings, ["k"])
    assert {(r.k, r.polygon) for r in got.collect()} == want and len(want) > 200


def test_a_position_is_looked_up_once(spark, monkeypatch):
    seen, smallest = [], covering.smallest
    monkeypatch.setattr(covering, "smallest", lambda points, *a: seen.append(points) or smallest(points, *a))
    rows = [(k, 8.01 + k % 3 / 10, 54.01, 8.11 if k % 2 else None, 54.01 if k % 2 else None, 6 if k % 5 == 0 else None) for k in range(300)] + [(900, None, None, 8.01, 54.01, None), (901, 1.0, 1.0, None, None, 8)]
    objects = spark.createDataFrame(rows, "k int, lon double, lat double, lon2 double, lat2 double, admin_level int")
    got = {r.k: r.tag for r in covering.variety_of(objects, boxes(spark, 20), ["k"]).collect()}
    assert got == {k: None if k % 5 == 0 else "aba"[k % 3] for k in range(300)} | {900: "a", 901: None}
    assert seen[0].count() == 4


def test_only_objects_with_a_local_name_are_looked_up(spark, monkeypatch):
    """Before, all named objects were, and they were held against each other's lists again for each use."""
    seen, variety_of = [], tagging.variety_of
    monkeypatch.setattr(tagging, "variety_of", lambda objects, *a: seen.append(objects) or variety_of(objects, *a))
    rows = [("n", k, 8.01, 54.01, None, None, None, "F" if k % 4 == 0 else ("" if k % 4 == 1 else None), "S" if k % 6 == 0 else None) for k in range(60)]
    objects = spark.createDataFrame(rows, "t string, id long, lon double, lat double, lon2 double, lat2 double, admin_level int, name_frr string, name_nds string")
    named, held = objects.select("t", "id").where("id < 40").union(objects.select("t", "id").where("id = 4")), objects.select("t", "id").where("id % 8 = 0")
    got = tagging.local_names(named, held, objects, boxes(spark, 1), [Variety("a", "one", "frr")])
    assert sorted(r.id for r in got.collect()) == [k for k in range(40) if k % 4 == 0 and k % 8]
    assert {r.id for r in seen[0].collect()} == {k for k in range(60) if k % 4 == 0 or k % 6 == 0}
    assert "Join" not in seen[0]._jdf.queryExecution().analyzed().toString()


#: Cells of the three segments that have a language, and of another; orders in and around them.
SPOKEN = {
    "customer": "SELECT k AS c_custkey, ['BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD'][1 + (k * 7919 // 7) % 4] AS c_mktsegment FROM range(1200) r(k)",
    "orders": "SELECT k AS o_orderkey, k % 1200 AS o_custkey FROM range(0, 30000, 13) r(k)",
}


def test_local_names_by_strips(same, strips):
    assert same("osm_local_names", **SPOKEN)
    assert min(strips().values()) > 3


def test_added_tags_by_strips(same, strips):
    """Before, each segment's area was one task's, and its cells were made by Python one area at a time."""
    assert same("added_tags", **SPOKEN)
    assert min(strips().values()) > 3


def test_nodes_and_groups_are_not_sent_to_all_tasks(spark):
    """Before, they were broadcast by the size of the file they come from: at 360 times sf0.1 the driver's memory did not hold them."""
    ways = spark.range(10).selectExpr("id AS area", "'outer' AS role", "0 AS place", "array(id, id + 1, id + 2, id) AS nodes")
    nodes, groups = spark.range(20).selectExpr("id", "CAST(id AS DOUBLE) AS lon", "CAST(id * id AS DOUBLE) AS lat"), spark.range(10).selectExpr("id AS area", "'a' AS tag")
    assert "Broadcast" not in areas.dissolved(ways, nodes, groups)._jdf.queryExecution().executedPlan().toString()
