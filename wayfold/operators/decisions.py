"""A log of decisions, appended and never rewritten: the last line about a thing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Actions that speak of a place itself; all others decide about it.
PLACE_ACTIONS = ("create", "discard")


def keyed(log: DataFrame, id_col: str = "id", action: str = "action", line: str = "line") -> DataFrame:
    """Lines with ``key`` (id) and ``slot`` (place or decision). A line without a usable id is a thing of its own."""
    ident = F.nullif(F.col(id_col).cast("string"), F.lit(""))
    slot = F.when(F.col(action).isin(*PLACE_ACTIONS), "place").otherwise("decision")
    return log.withColumn("key", F.coalesce(ident, F.concat(F.lit("#line "), F.col(line).cast("string")))).withColumn("slot", F.when(ident.isNull(), "line").otherwise(slot))


def latest(log: DataFrame, line: str = "line", action: str = "action") -> DataFrame:
    """The last line of each (key, slot); a place discarded last takes its decision with it."""
    last = log.withColumn("__n", F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.col(line).desc()))).where("__n = 1").drop("__n")
    gone = F.max((F.col("slot") == "place") & (F.col(action) == "discard")).over(Window.partitionBy("key"))
    return last.withColumn("__gone", F.coalesce(gone, F.lit(False))).where(~F.col("__gone") | (F.col("slot") != "decision")).drop("__gone")


def decided(log: DataFrame, action: str = "action") -> DataFrame:
    """The latest decisions that stand: neither cleared nor discarded."""
    return latest(log).where((F.col("slot") == "decision") & (F.col(action) != "clear"))


def created(log: DataFrame, action: str = "action") -> DataFrame:
    return latest(log).where((F.col("slot") == "place") & (F.col(action) == "create"))


def refused_to_append(refused: DataFrame, newer: DataFrame, action: str = "action") -> DataFrame:
    """Refused lines whose thing has no newer line, and whose place no newer discard."""
    keys = newer.select("key", "slot").unionByName(newer.where(F.col(action) == "discard").select("key", F.lit("decision").alias("slot"))).distinct()
    return refused.join(keys, ["key", "slot"], "left_anti")


def apply(rows: DataFrame, log: DataFrame, claims: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with ``osm``, ``status`` and ``refused`` after the standing decisions of a log.

    ``log`` has id, action (osm, skip, clear), ref and line; ``claims`` (claim, holder) what
    rows hold already. A reference that another row holds is refused, and so is one that two
    decisions ask for, but the earlier.
    """
    wish = decided(keyed(log)).select(F.col("key").alias(id_col), "action", "ref", "line")
    first = F.row_number().over(Window.partitionBy("ref").orderBy("line"))
    wish = wish.withColumn("__n", F.when((F.col("action") == "osm") & F.col("ref").isNotNull(), first)).join(claims.select(F.col("claim").alias("ref"), "holder"), "ref", "left")
    held = F.coalesce((F.col("action") == "osm") & F.col("holder").isNotNull() & (F.col("holder") != F.col(id_col)), F.lit(False)) | F.coalesce(F.col("__n") > 1, F.lit(False))
    wish = wish.select(id_col, "action", "ref", held.alias("refused"))
    out = rows.join(wish, id_col, "left").withColumn("refused", F.coalesce("refused", F.lit(False)))
    takes = (F.col("action") == "osm") & ~F.col("refused")
    return out.withColumn("osm", F.when(takes, F.col("ref")).otherwise(F.col("osm"))).withColumn("status", F.when(takes, "ok").when(F.col("action") == "skip", "skip").otherwise(F.col("status"))).drop("action", "ref")


def change_of(before, after):
    """filled, cleared or changed; null where nothing changed."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    return F.when(b == a, F.lit(None).cast("string")).when(b == "", "filled").when(a == "", "cleared").otherwise("changed")
