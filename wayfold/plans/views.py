"""Outputs that are built from inputs, and rebuilt when their stamps say so."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamp(rows: DataFrame) -> str:
    """A digest of a table's rows in any order, repeats included."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    got = rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).first()
    return f"{got['n']}-{got['x']}-{got['s']}"


@dataclass
class View:
    """An output: its name, the inputs it is made from, how, and whether making it is dear."""

    name: str
    inputs: list[str]
    make: Callable[..., DataFrame]
    dear: bool = False


def stale(spark: SparkSession, view: View, stamps: dict[str, str], root: str) -> str | None:
    """Why a view has to be built: missing, or the inputs that are not what it was built from; null if it stands."""
    try:
        built = {r["label"]: r["digest"] for r in spark.read.parquet(f"{root}/{view.name}.stamp").collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return "missing"
    changed = [i for i in view.inputs if built.get(i) != stamps[i]]
    return f"changed: {', '.join(changed)}" if changed else None


def build(spark: SparkSession, views: list[View], tables: dict[str, DataFrame], root: str, everything: bool = False) -> dict[str, str | None]:
    """Build what is stale, in order; later views may use earlier ones. Returns the reason for each, null for those left alone."""
    tables, why = dict(tables), {}
    for v in views:
        stamps = {i: stamp(tables[i]) for i in v.inputs}
        why[v.name] = "asked for" if everything else stale(spark, v, stamps, root)
        if why[v.name]:
            v.make(*[tables[i] for i in v.inputs]).write.mode("overwrite").parquet(f"{root}/{v.name}")
            spark.createDataFrame(list(stamps.items()), "label string, digest string").write.mode("overwrite").parquet(f"{root}/{v.name}.stamp")
        tables[v.name] = spark.read.parquet(f"{root}/{v.name}")
    return why
