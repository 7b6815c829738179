import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import tiles


def test_numbers_walk_every_tile_of_a_zoom_to_a_neighbour(spark):
    for z, first in ((0, 0), (1, 1), (2, 5), (5, 341)):
        rows = [(z, x, y) for x in range(2**z) for y in range(2**z)]
        got = sorted((r.n, r.x, r.y) for r in spark.createDataFrame(rows, "z int, x long, y long").withColumn("n", tiles.tile_number("z", "x", "y")).collect())
        assert [n for n, _, _ in got] == list(range(first, first + 4**z))
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got[:-1], got[1:], strict=True))
    # The curve of zoom 1 and its first turn: fixed values.
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0), (1, 2, 0), (1, -1, 0), (31, 0, 0)], "z int, x long, y long")
    assert [r.n for r in df.select(tiles.tile_number("z", "x", "y").alias("n")).collect()] == [1, 2, 3, 4, 5, None, None, None]


@pytest.mark.parametrize("bits", [2, 6, 12])
def test_every_tile_is_found_again_and_payloads_are_stored_once(spark, bits):
    rng = random.Random(bits)
    there = {(z, x, y): rng.choice("aab") if rng.random() < 0.8 else f"own{z}-{x}-{y}" for z in range(5) for x in range(2**z) for y in range(2**z) if rng.random() < 0.8}
    size = lambda d: 10 + len(d)
    rows = [(*k, d, size(d)) for k, d in there.items()] + [(1, 9, 9, "outside", 5)]
    entries = tiles.directory(spark.createDataFrame(rows, "z int, x long, y long, digest string, length long"), bits).cache()
    asked = spark.createDataFrame([(z, x, y) for z in range(5) for x in range(2**z) for y in range(2**z)], "z int, x long, y long")
    got = {(r.z, r.x, r.y): (r.offset, r.length) for r in tiles.located(asked, entries, bits).collect()}
    assert len(got) == asked.count() and {k for k, v in got.items() if v[0] is not None} == set(there)
    of = {}
    for k, d in there.items():
        assert got[k][1] == size(d) and of.setdefault(d, got[k][0]) == got[k][0]
    # Payloads lie one after the other, without gap or overlap.
    ends = sorted((o, size(d)) for d, o in of.items())
    assert ends[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))
    found = entries.collect()
    assert sum(r.run for r in found) == len(there) and all(r["first"] >> bits == (r["first"] + r.run - 1) >> bits == r.leaf for r in found)
    up = {r.leaf: r for r in tiles.root(entries).collect()}
    assert sum(r.entries for r in up.values()) == len(found) and all(min(e["first"] for e in found if e.leaf == k) == r["first"] for k, r in up.items())


def test_running_sums_over_parts(spark):
    rng = random.Random(1)
    rows = [(k * 3, rng.randrange(100)) for k in range(2000)]
    rng.shuffle(rows)
    got = {r.k: r.before for r in tiles.running(spark.createDataFrame(rows, "k long, v long"), "k", F.col("v"), "before").collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v
    assert tiles.running(spark.createDataFrame([], "k long, v long"), "k", F.col("v"), "before").count() == 0
