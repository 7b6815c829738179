"""A directory of map tiles: numbers along a Hilbert curve, equal payloads stored once, runs, two levels.

Only where tiles are is kept here, not how they are drawn. Tiles that follow each other on the
curve and have the same payload are one entry. A leaf has the entries of one stretch of numbers, so a tile is looked
up by an equi-join on its stretch and then by range within the leaf.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Numbers of a leaf, as a power of two.
LEAF_BITS = 12


def tile_number(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """The number of a tile: all tiles of smaller zooms first, then its place on the Hilbert curve of its own. Null outside the map or above zoom 30."""
    z, x, y = (F.col(c) if isinstance(c, str) else c for c in (z, x, y))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, bit: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        rx, ry = (F.call_function("shiftright", s[c], bit).bitwiseAND(F.lit(1)) for c in "xy")
        turn = lambda c: F.when((ry == 0) & (rx == 1), size - 1 - s[c].bitwiseAND(size - 1)).otherwise(s[c].bitwiseAND(size - 1))
        return F.struct(F.when(ry == 0, turn("y")).otherwise(turn("x")).alias("x"), F.when(ry == 0, turn("x")).otherwise(turn("y")).alias("y"), (s["d"] + size * size * (rx * 3).bitwiseXOR(ry)).alias("d"))

    bits = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    before = ((F.call_function("shiftleft", F.lit(1).cast("long"), 2 * z) - 1) / 3).cast("long")
    side = F.call_function("shiftleft", F.lit(1).cast("long"), z)
    there = z.between(0, 30) & (x >= 0) & (y >= 0) & (x < side) & (y < side)
    return F.when(there, before + F.aggregate(bits, start, step)["d"])


def running(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before each in ``order``; rows of one value count each other, but not themselves.

    Rows are dealt by range and written with their part; parts are summed, and rows count on from the parts before theirs. Only
    the sums of parts meet in one task.
    """
    dealt = cut(df.withColumn("__v", value.cast("long")).repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "running")
    totals = dealt.groupBy("__part").agg(F.sum("__v").alias("n"))
    base = totals.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__base"))
    within = F.sum("__v").over(Window.partitionBy("__part").orderBy(order)) - F.col("__v")
    return dealt.withColumn("__within", within).join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__within")).drop("__v", "__part", "__within", "__base")


def directory(tiles: DataFrame, leaf_bits: int = LEAF_BITS, keys: Sequence[str] = ()) -> DataFrame:
    """Entries (keys, leaf, first, run, offset, length) of tiles (keys, z, x, y, digest, length).

    ``keys`` tell the sheets of a map apart: numbers and payloads are common to all sheets, an entry is of one. Tiles are distinct
    in keys and position for ``located``; a tile there more than once is that often in entries.
    A payload is stored where its first tile comes, once; ``offset`` is the bytes of all
    payloads before it. An entry stands for ``run`` tiles from number ``first`` on, all in one leaf.
    Tiles outside the map are left out. A payload that very many tiles share is split by leaf before runs are found.
    """
    numbered = tiles.select(*keys, tile_number("z", "x", "y").alias("number"), "digest", "length").where("number IS NOT NULL")
    numbered = cut(numbered.withColumn("leaf", F.shiftright("number", leaf_bits)), "tile-numbers")
    once = numbered.groupBy("digest").agg(F.min("number").alias("at"), F.max("length").alias("length"))
    placed = cut(running(once, "at", F.col("length"), "offset").select("digest", "offset", "length"), "tile-payloads")
    place = F.row_number().over(Window.partitionBy(*keys, "leaf", "digest").orderBy("number"))
    runs = numbered.withColumn("island", F.col("number") - place).groupBy(*keys, "leaf", "digest", "island").agg(F.min("number").alias("first"), F.count("*").alias("run"))
    return runs.join(placed, "digest").select(*keys, "leaf", "first", "run", "offset", "length")


def root(entries: DataFrame) -> DataFrame:
    """Rows (leaf, first, entries, tiles) of the leaves of a directory."""
    return entries.groupBy("leaf").agg(F.min("first").alias("first"), F.count("*").alias("entries"), F.sum("run").alias("tiles"))


def located(wanted: DataFrame, entries: DataFrame, leaf_bits: int = LEAF_BITS, keys: Sequence[str] = ()) -> DataFrame:
    """``wanted`` (keys, z, x, y and others) with offset and length of their payloads; null for a tile that is not there."""
    asked = wanted.withColumn("number", tile_number("z", "x", "y")).withColumn("leaf", F.shiftright("number", leaf_bits))
    e = entries.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("leaf").alias("__leaf"), "first", "run", "offset", "length")
    held = (F.col("leaf") == F.col("__leaf")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("run"))
    for k in keys:
        held &= F.col(k) == F.col(f"__key_{k}")
    return asked.join(e, held, "left").drop(*[f"__key_{k}" for k in keys], "number", "leaf", "__leaf", "first", "run")
