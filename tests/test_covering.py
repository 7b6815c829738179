import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_areas import Map, covered, square
from wayfold.operators import areas, covering, spatial


def wavy_ring(x, y, r, n, rng):
    return [(x + r * (1 + rng.uniform(-0.2, 0.2)) * math.cos(k / n * math.tau), y + r * (1 + rng.uniform(-0.2, 0.2)) * math.sin(k / n * math.tau)) for k in range(n)]


@pytest.fixture(scope="module")
def rings(spark):
    rng, m = random.Random(3), Map()
    m.add("big", "outer", wavy_ring(9, 54, 1, 90, rng))
    m.add("big", "inner", wavy_ring(9, 54, 0.5, 40, rng))
    m.add("isle", "outer", wavy_ring(9, 54, 0.2, 30, rng))
    m.add("box", "outer", square(8.5, 53.5, 0.25))
    m.add("box", "outer", square(20, 50, 1))
    return areas.of_ways(*m.frames(spark)).withColumnRenamed("area", "tag").cache()


def test_cells_cover_and_full_ones_are_inside(rings):
    rng = random.Random(1)
    for tag in ("big", "isle"):
        lines = [np.array([(p.lon, p.lat) for p in r.points]) for r in rings.where(f"tag = '{tag}'").collect()]
        edges = np.concatenate([np.hstack([p[:-1], p[1:]]) for p in lines])
        for most in (4, 30, 256):
            cells = covering.cells_of(edges, most)
            assert len(cells) <= most and len({c[:3] for c in cells}) == len(cells)
            assert most < 256 or any(c[3] for c in cells)
            for _ in range(400):
                x, y = rng.uniform(7.5, 10.5), rng.uniform(52.5, 55.5)
                held = [full for level, i, j, full in cells if -180 + i * 360 / 2**level <= x < -180 + (i + 1) * 360 / 2**level and -90 + j * 180 / 2**level <= y < -90 + (j + 1) * 180 / 2**level]
                inside = covered(x, y, [p.tolist() for p in lines])
                assert len(held) <= 1 and (held or not inside) and (inside or held != [True])


def test_points_equal_a_ring_test_of_every_polygon(spark, rings):
    rng = random.Random(2)
    points = [(k, rng.uniform(7.5, 10.5), rng.uniform(52.5, 55.5)) for k in range(1500)]
    points += [(2000, 8.5, 53.5), (2001, 8.75, 53.6), (2002, 8.6, 53.75), (2003, 20.5, 50.5), (2004, None, None), (2005, 180.0, 90.0), (2006, -180.0, -90.0)]
    df = spark.createDataFrame(points, "k int, lon double, lat double")
    polygons = {}
    for r in rings.collect():
        polygons.setdefault((r.tag, r.polygon), []).append(([(p.lon, p.lat) for p in r.points], r.doubled))
    want = {}
    for k, x, y in points[:1500]:
        held = [(sum(d for _, d in rs), tag) for (tag, _), rs in polygons.items() if covered(x, y, [p for p, _ in rs])]
        if held:
            want[k] = min(held)[1]
    want |= {2000: "box", 2001: "box", 2002: "box", 2003: "box"}
    got = {r.k: r.tag for r in covering.smallest(df, rings, ["k"]).collect()}
    assert got == want and len(set(want.values())) == 3


def test_outline_point_and_level(spark, rings):
    rows = [(1, 9.0, 54.0, None, None, None), (2, 9.35, 54.0, 8.6, 53.6, 8), (3, 9.0, 54.0, None, None, 6), (4, 0.0, 0.0, None, None, 9), (5, 9.0, 54.0, 8.6, 53.6, 11)]
    got = {r.k: r.tag for r in covering.variety_of(spark.createDataFrame(rows, "k int, lon double, lat double, lon2 double, lat2 double, admin_level int"), rings, ["k"]).collect()}
    assert got == {1: "isle", 2: "box", 3: None, 4: None, 5: "isle"}


def test_no_areas(spark, rings):
    points = spark.createDataFrame([(1, 9.0, 54.0)], "k int, lon double, lat double")
    assert covering.smallest(points, rings.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("lat", [0, 54.5, 69, 78, 85, -72])
@pytest.mark.parametrize("km", [3.0, 60.0])
def test_pairs_within_a_distance_at_any_latitude(spark, lat, km):
    rng = random.Random(lat)
    wide = 4 * km / 111 / math.cos(math.radians(abs(lat)))
    point = lambda k: (k, 10 + rng.uniform(-wide, wide), lat + rng.uniform(-1, 1) * 3 * km / 111)
    a, b = [point(k) for k in range(150)], [point(k) for k in range(150)]

    def far(p, q):
        u, v = math.radians(p[2]), math.radians(q[2])
        h = math.sin((v - u) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 12742 * math.asin(math.sqrt(min(1, h)))

    got = {(r.i, r.j) for r in spatial.within(spark.createDataFrame(a, "i int, lon double, lat double"), spark.createDataFrame(b, "j int, lon double, lat double"), km).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if far(p, q) <= km} and got


def test_a_pole_is_an_error(spark):
    df = lambda c: spark.createDataFrame([(1, 0.0, 88.5)], f"{c} int, lon double, lat double")
    with pytest.raises(Exception, match="pole"):
        spatial.within(df("i"), df("j"), 1.0).collect()


@pytest.mark.parametrize("n, ranks", [(6, 4), (60, 3), (300, 25), (300, 300)])
def test_the_nearest_of_the_least_rank_equals_all_pairs(spark, n, ranks):
    rng = random.Random(n + ranks)
    at = lambda: (8 + rng.randint(0, 400) / 1000, 54.5 + rng.randint(0, 250) / 1000)
    a = [(k, *at()) for k in range(150)] + [(900, None, 54.5)]
    b = [(k, None if k % 17 == 16 else rng.randint(1, ranks), *at()) for k in range(n)]
    left, right = spark.createDataFrame(a, "i int, lon double, lat double"), spark.createDataFrame(b, "j int, r int, lon double, lat double")
    every = spatial.within(left, right, 10.0).withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy(F.col("r").asc_nulls_last(), "km", "j"))).where("n = 1")
    got = spatial.nearest(left, right, ["i"], 10.0, F.col("r"), F.col("j"))
    assert {(x.i, x.j) for x in got.collect()} == {(x.i, x.j) for x in every.collect()}


def test_the_nearest_is_found_without_making_all_pairs(spark, monkeypatch):
    """Before, a row was held against each row within the distance, whatever its rank."""
    made = []
    pairs = spatial._pairs
    monkeypatch.setattr(spatial, "_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    rng = random.Random(9)
    at = lambda k: (k, 8 + rng.random() * 0.02, 54.5 + rng.random() * 0.01)
    left, right = spark.createDataFrame([at(k) for k in range(200)], "i int, lon double, lat double"), spark.createDataFrame([at(k) for k in range(300)], "j int, lon double, lat double")
    got = spatial.nearest(left, right, ["i"], 10.0, F.lit(1), F.col("j"))
    assert got.count() == 200 and sum(m.count() for m in made) < 100
