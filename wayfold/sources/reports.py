"""Files that tell people and the map's front end of a run: the match report, the work list and the registry."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sinks import replace_file

# States of rows in the order of the report's columns, and fields of the registry that are for the list's keepers alone.
STATES = ("auto", "by hand", "own point", "ambiguous", "not found", "skip", "no name", "not a place")
KEPT_BACK = ("column", "note")


def _cells(*cells: Column | str) -> Column:
    """One line of a Markdown table; null cells are empty, bars and line ends in cells don't break it."""
    safe = lambda c: F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[safe(F.col(c) if isinstance(c, str) else c) for c in cells]), F.lit(" |"))


def _head(spark, section: int, columns: list[str], numbers: set[str]) -> DataFrame:
    lines = ["| " + " | ".join(columns) + " |", "|" + "".join("---:|" if c in numbers else "---|" for c in columns)]
    return spark.createDataFrame([(section, k - 2, line) for k, line in enumerate(lines)], "section int, place long, text string")


def report_lines(rows: DataFrame) -> DataFrame:
    """Lines (section, place, text) of a report on rows (row_id, line, kind, name, german, state, hint, why, candidates, note).

    Section 1 counts rows by kind and state, kinds in the order of their first rows, and all
    of them; section 2 has the ambiguous rows, section 3 those not found, each in order of
    line. Every section starts with its table's head. A state that is none of STATES counts
    in the total only.
    """
    spark = rows.sparkSession
    count = [F.count(F.when(F.col("state") == s, 1)).alias(f"s{i}") for i, s in enumerate(STATES)]
    each = [f"s{i}" for i in range(len(STATES))]
    kinds = rows.groupBy("kind").agg(F.min("line").alias("first"), *count, F.count("*").alias("n"))
    counted = kinds.select(F.lit(1).alias("section"), F.col("first").cast("long").alias("place"), _cells("kind", *each, "n").alias("text"))
    bold = lambda c: F.concat(F.lit("**"), F.col(c).cast("string"), F.lit("**"))
    total = rows.agg(*count, F.count("*").alias("n")).select(F.lit(1).alias("section"), F.lit((1 << 63) - 1).alias("place"), _cells(F.lit("**total**"), *[bold(c) for c in (*each, "n")]).alias("text"))
    code = F.concat(F.lit("`"), F.coalesce("candidates", F.lit("")), F.lit("`"))
    listed = lambda section, state, *more: rows.where(F.col("state") == state).select(F.lit(section).alias("section"), F.col("line").cast("long").alias("place"), _cells("row_id", "line", "kind", "name", "german", *more).alias("text"))
    own = ["id", "line", "kind", "Frisian", "German"]
    heads = _head(spark, 1, ["kind", *STATES, "total"], {*STATES, "total"}).unionByName(_head(spark, 2, [*own, "hint", "why", "candidates"], {"line"})).unionByName(_head(spark, 3, [*own, "note", "near misses"], {"line"}))
    return heads.unionByName(counted).unionByName(total).unionByName(listed(2, "ambiguous", "hint", "why", code)).unionByName(listed(3, "not found", "note", code))


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines to a folder of text files, which have them in order of section and place."""
    lines.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("text").write.mode("overwrite").text(path)


def write_worklist(rows: DataFrame, places: DataFrame, facts: dict, path: str) -> None:
    """Write a work list to the folder ``path``: rows and places as JSON lines in order of ``line``, and ``facts.json``, the driver's file, in one step.

    ``facts`` are what the view needs besides (columns, kinds, box); ``path`` may be shared
    storage for the rows, but facts are written where the driver sees the folder.
    """
    for name, df in (("rows", rows), ("places", places)):
        df.repartitionByRange("line").sortWithinPartitions("line").write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
    replace_file(f"{path.removeprefix('file://')}/facts.json", json.dumps(facts, ensure_ascii=False, indent=1) + "\n")


def registry_json(registry: DataFrame, order: str = "line") -> str:
    """The registry as the front end compiles it in: all its columns but KEPT_BACK, in order, as one compact line of JSON. A registry is hand-kept, a few dozen rows."""
    fields = [c for c in registry.columns if c not in (*KEPT_BACK, order)]
    rows = registry.orderBy(order).select(*fields).collect()
    return json.dumps([{c: r[c] or "" for c in fields} for r in rows], ensure_ascii=False, separators=(",", ":")) + "\n"
