"""Decisions entered into a table and taken from their log in one commit, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions
from ..sources.commits import Store, apply_log
from ..sources.tables import shared_dir
from .queries import SQL, _log, query, table


def entered(tables: dict[str, DataFrame], log: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows after the standing decisions of a log, and the lines that are refused: to be used with ``commits.apply_log``."""
    got = decisions.apply(tables["rows"], log, tables["claims"])
    standing = decisions.decided(decisions.keyed(log)).select("key", "line")
    refused = standing.join(got.where("refused").select(F.col("id").alias("key")), "key").select("line")
    return {"rows": got.drop("refused")}, log.join(refused, "line", "left_semi")


def still_refused(refused: DataFrame, newer: DataFrame) -> DataFrame:
    """Refused lines that no newer line has taken the place of."""
    return decisions.refused_to_append(decisions.keyed(refused), decisions.keyed(newer)).select(refused.columns)


@query(f"SELECT id, osm, status, refused AS line_kept FROM ({SQL['apply_decisions']})")
def committed_decisions(spark: SparkSession, d: str) -> DataFrame:
    """STM05, STM07, SNK17, SNK19: a log appended in two commits and applied in one, which changes rows and log together; what is refused stays in the log."""
    store = Store(spark, f"{shared_dir(spark)}/wayfold/store-{uuid.uuid4().hex}")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("").alias("osm"), F.lit("").alias("status"))
    held = table(spark, d, "supplier").select(F.concat(F.lit("way/"), F.col("s_suppkey").cast("string")).alias("claim"), (F.col("s_suppkey") + 1).cast("string").alias("holder"))
    store.commit(store.version(), {"rows": rows, "claims": held}, "lists")
    log = _log(spark, d).select("line", "id", "action", "ref")
    for part in (F.col("line") % 2 == 0, F.col("line") % 2 == 1):
        store.append("log", log.where(part))
    done = apply_log(store, entered, still_refused)
    kept = store.read("log", done).select("id").distinct().withColumn("line_kept", F.lit(True))
    return store.read("rows", done).join(kept, "id", "left").select("id", "osm", "status", F.coalesce("line_kept", F.lit(False)).alias("line_kept"))
