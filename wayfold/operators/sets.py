"""Sets of keys: what either side has, what one side lacks, what a list names in vain. Null and empty keys are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import present
from .matching import ref_text


def keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of a table, each once."""
    return rows.select(present(F.col(key).cast("string")).alias("key")).where("key IS NOT NULL").distinct()


def either(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one of two tables has: with one shuffle, as copies are merged before and after it."""
    return keys(a.select(key).unionByName(b.select(key)), key)


def installed(listed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows (key, fate) of keys on one side only: ``missing`` are listed and not there, ``extra`` are there and not listed."""
    side = lambda rows, at: rows.select(present(F.col(key).cast("string")).alias("key"), F.lit(at).alias("at"))
    both = side(listed, 1).unionByName(side(there, 2)).where("key IS NOT NULL")
    return both.groupBy("key").agg(F.bit_or("at").alias("at")).where("at <> 3").select("key", F.when(F.col("at") == 1, "missing").otherwise("extra").alias("fate"))


def not_found(rows: DataFrame, found: DataFrame, present_items: DataFrame, name: str = "name") -> DataFrame:
    """Rows (what, key, name) of references (t, id) and items (item) that a list's rows (line, osm, wikidata, name) hold and an extract has not.

    Local references are looked for nowhere; rows that are skipped hold nothing. A key of several rows goes by the first.
    """
    from .namelist import claims

    held = rows.select("line", F.col(name).alias("name"), claims().alias("c"))
    refs = held.select("line", "name", F.explode("c.refs").alias("r")).where("r.t <> 'local'").groupBy(F.col("r.t").alias("t"), F.col("r.id").alias("id")).agg(F.min_by("name", "line").alias("name"))
    lost = refs.join(found.select("t", "id"), ["t", "id"], "left_anti").select(F.lit("reference").alias("what"), ref_text("t", "id").alias("key"), "name")
    items = held.where("c.item <> ''").groupBy(F.col("c.item").alias("key")).agg(F.min_by("name", "line").alias("name"))
    absent = items.join(present_items.select(F.col("item").alias("key")), "key", "left_anti").select(F.lit("item").alias("what"), "key", "name")
    return lost.unionByName(absent)
