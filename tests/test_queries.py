import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wayfold.plans import list_queries, small_queries  # noqa: F401  register their queries
from wayfold.plans import queries as plans

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def rows(names, values):
    def plain(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, D)
    want = duck.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_queries_without_sql(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    groups = plans.greedy_clusters(spark, D).collect()
    assert sum(len(r.ids) for r in groups) == 10
    assert all(r.closed and r.n == 8 for r in plans.ring_assembly(spark, D).collect())
    got = [r.thing for r in plans.sequential_claims(spark, D).collect() if r.thing is not None]
    assert len(got) == len(set(got)) > 0


def test_glyph_blocks_reads_all_runs_of_a_text(spark, tmp_path):
    spark.createDataFrame([("é and я, then 漢é", "en", "a")], "text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.block: r.label for r in plans.glyph_blocks_whole_texts(spark, str(tmp_path)).collect()}
    assert got == {"0-255": "doc en a", "1024-1279": "я", "28416-28671": "漢é"}


def test_relations_of_the_scan_equal_brute_force(spark):
    import numpy as np

    read = lambda n: spark.read.parquet(f"{D}/{n}.parquet")
    part = {r.p_partkey: (np.float32(7.8 + r.p_partkey * 7919 % 1750 / 1000), np.float32(54.15 + r.p_partkey * 104729 % 970 / 1000)) for r in read("part").collect()}
    first, spots = {}, {}
    for r in sorted(read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").collect()):
        if r.l_partkey in part:
            first.setdefault(r.l_orderkey, part[r.l_partkey])
    for r in read("orders").collect():
        spots.setdefault(r.o_custkey, []).extend([first[r.o_orderkey]] if r.o_orderkey in first else [])
    got = {r.id: (r.lon, r.lat) for r in plans.relation_positions(spark, D).collect()}
    assert set(got) == set(spots) and got
    for i, p in spots.items():
        assert got[i] == (pytest.approx(np.mean([float(x) for x, _ in p]) * 1e6, abs=0.6), pytest.approx(np.mean([float(y) for _, y in p]) * 1e6, abs=0.6))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_clusters_claims_and_rings_equal_plain_python(spark):
    read = lambda n: spark.read.parquet(f"{D}/{n}.parquet").collect()
    pos = lambda k: (7.8 + k * 7919 % 1750 / 1000, 54.15 + k * 104729 % 970 / 1000)

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    def same(a, b):
        core, far = (a % 3 == 0) and (b % 3 == 0), 30 if a % 3 == 2 or b % 3 == 2 else 3
        return km(pos(a), pos(b)) <= (1 if core else far)

    want, nations = {}, {}
    for r in sorted(read("supplier"), key=lambda r: r.s_suppkey):
        groups = want.setdefault(r.s_nationkey, [])
        home = next((g for g in groups if any(same(r.s_suppkey, m) for m in g)), None)
        home.append(r.s_suppkey) if home else groups.append([r.s_suppkey])
        for n in (r.s_nationkey, (r.s_nationkey + 1) % 25):
            nations.setdefault(n, []).append(r.s_suppkey)
    got = {}
    for r in sorted(plans.greedy_clusters(spark, D).collect(), key=lambda r: r.cluster):
        got.setdefault(r.s_nationkey, []).append(r.ids)
    assert got == want
    taken, given = set(), {}
    for n in sorted(nations):
        given[n] = next((s for s in sorted(nations[n]) if s not in taken), None)
        taken.add(given[n])
    assert {r.row: r.thing for r in plans.sequential_claims(spark, D).collect()} == given
