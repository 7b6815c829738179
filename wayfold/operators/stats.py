"""Counts and crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two columns with totals of rows, columns and all, where the column's place says ``total``. One pass, summed before the shuffle."""
    named = rows.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cube = named.cube("a", "b").agg(F.count("*").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    total = lambda c, g: F.when(F.col(g) == 1, "total").otherwise(F.col(c))
    return cube.select(total("a", "ga").alias(a), total("b", "gb").alias(b), "n")


def count_of_each(rows: DataFrame, reasons: Column, name: str = "reason") -> DataFrame:
    """Counts by reason; a row counts once under each of its reasons."""
    return rows.select(F.explode(F.array_distinct(reasons)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def key_counts(rows: DataFrame, tag_map: str, pattern: str = "^name:") -> DataFrame:
    """Counts of the keys of a map column that match a pattern and have a value."""
    keys = F.filter(F.map_keys(F.map_filter(tag_map, lambda k, v: v != "")), lambda k: k.rlike(pattern))
    return count_of_each(rows, keys, "key")


def box_of(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return rows.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))
