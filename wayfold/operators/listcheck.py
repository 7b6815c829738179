"""All problems of all hand-kept lists at once: the name list, map tuning, the registry of varieties and the area list."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_of, parse_refs
from ..sources.tables import cut
from . import checks, namelist, tuning
from .namelist import TILE_KEYS, cell
from .naming import Variety, name_columns

#: Files in the order in which their problems are told.
FILES = ("names", "tuning", "registry", "areas")
#: Columns of the name list beside those of its names.
COLUMNS = ("id", "kind", "hint", "osm", "wikidata", "status", "note")
#: Rows of a list that one task parses.
ROWS_OF_TASK = 10_000


def hand_set_refs(typed: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (line, message) of tuning rows that set a row's id by hand where the name list has no such row."""
    key = TILE_KEYS["id"]
    asked = typed.select("line", F.col("changes")[key].alias("id")).where("id IS NOT NULL")
    return asked.join(names.select("id").where("id <> ''"), "id", "left_anti").select("line", F.concat(F.lit(f"{key}="), "id", F.lit(" names no row of the name list")).alias("message"))


def unplaced(rows: DataFrame, typed: DataFrame) -> DataFrame:
    """Rows (line, message) of the name list (line, refs) whose local reference has no position in the tuning rows."""
    wanted = rows.select("line", local_of("refs").alias("slug")).where("slug IS NOT NULL")
    placed = typed.where("lat IS NOT NULL AND lon IS NOT NULL").select(local_of(F.col("refs")).alias("slug")).where("slug IS NOT NULL")
    return wanted.join(placed, "slug", "left_anti").select("line", F.concat(F.lit("local/"), "slug", F.lit(" has no row with a position")).alias("message"))


def dealt(rows: DataFrame, name: str, *added: Column) -> DataFrame:
    """Rows with columns that are costly to work out, written once by as many tasks as there are rows for.

    Lists come in few files, and whatever reads a parsed column else parses anew.
    """
    return cut(rows.repartition(max(1, math.ceil(rows.count() / ROWS_OF_TASK))).select("*", *added), name)


def claim_problems(rows: DataFrame) -> DataFrame:
    """Rows (line, seq, message), for rows with parsed refs, of claims that an earlier line has, in order of the row, then of claims that a row has twice."""
    each = cut(rows.select("line", F.posexplode(namelist.claim_keys(namelist.claims(F.col("refs")))).alias("at", "key")), "list-claims")
    # A key that very many rows hold is merged before the shuffle, and a join on it can be split.
    shared = each.groupBy("key").agg(F.min("line").alias("first"), F.max("line").alias("last")).where("first < last").select("key", "first")
    taken = each.join(shared, "key").where("first < line").select("line", F.col("at").alias("seq"), F.concat("key", F.lit(" is held by line "), F.col("first").cast("string"), F.lit(" already")).alias("message"))
    twice = each.groupBy("line", "key").agg(F.sort_array(F.collect_list("at")).alias("at")).where(F.size("at") > 1).withColumn("at", F.get("at", F.lit(1)))
    return taken.unionByName(twice.select("line", (F.col("at") + F.lit(1000)).alias("seq"), F.concat("key", F.lit(" twice in `osm`")).alias("message")))


def place_problems(names: DataFrame, typed: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows (line, rank, seq, message) of the name list: rules of a row, its id, its claims, how cells are written, and positions.

    A list that lacks columns has no rows, only that problem, on line 1.
    """
    columns = name_columns(varieties)
    if what := namelist.header_problems(names.columns, [*COLUMNS, *columns]):
        return names.sparkSession.createDataFrame([(1, 0, i, m) for i, m in enumerate(what)], "line long, rank int, seq int, message string")
    rows = dealt(names.select(F.col("line").cast("long").alias("line"), *COLUMNS, *columns), "list-rows", parse_refs("osm").alias("refs"))
    written = namelist.cell_problems(rows, columns)
    at = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int")
    parted = rows.where(cell("osm").rlike(r"(?U)\s;|;(?! \S)")).select("line", F.lit("osm: references are separated by `; `").alias("message"))
    told = [
        namelist.row_problems(rows, F.col("refs")), checks.id_problems(rows, "id", "line").withColumn("seq", F.lit(0)), claim_problems(rows),
        written.select("line", at.alias("seq"), F.concat("column", F.lit(": "), "message").alias("message")), parted.withColumn("seq", F.lit(0)), unplaced(rows, typed).withColumn("seq", F.lit(0)),
    ]
    out = None
    for rank, found in enumerate(told):
        part = found.select("line", F.lit(rank).alias("rank"), "seq", "message")
        out = part if out is None else out.unionByName(part)
    return out


def all_problems(names: DataFrame, tuned: DataFrame, registry: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows (part, file, line, rank, seq, message), to be ordered by them: every problem of four lists.

    ``tuned`` has the strings that ``tuning.typed`` reads. The name list is held against the
    sound rows of the registry, and not at all if there are none; the area list only against
    a sound registry. Those rows come to the driver: each is a column of the name list.
    """
    spark, typed = names.sparkSession, cut(tuning.typed(tuned.repartition(max(1, math.ceil(tuned.count() / ROWS_OF_TASK)))), "list-tuning")
    bad = namelist.registry_problems(registry).select(F.col("line").cast("long").alias("line"), "message")
    sound = registry.where(cell("tag") != "").join(bad, "line", "left_anti").orderBy("line").select("tag", "column", "language").collect()
    varieties, unsound = [Variety(*r) for r in sound], bad.limit(1).count() > 0
    plain = lambda rows, rank: rows.select(F.col("line").cast("long").alias("line"), F.lit(rank).alias("rank"), F.lit(0).alias("seq"), "message")
    found = [
        place_problems(names, typed, varieties) if varieties else None,
        plain(tuning.tuning_problems(typed), 0).unionByName(plain(hand_set_refs(typed, names), 1)),
        plain(bad, 0),
        plain(namelist.area_rows(areas, [v.tag for v in varieties]).where("problem IS NOT NULL").withColumnRenamed("problem", "message"), 0) if varieties and not unsound else None,
    ]
    out = spark.createDataFrame([], "part int, file string, line long, rank int, seq int, message string")
    for part, rows in enumerate(found):
        if rows is not None:
            out = out.unionByName(rows.select(F.lit(part).alias("part"), F.lit(FILES[part]).alias("file"), "line", "rank", "seq", "message"))
    # Ordering reads its rows twice, once for the bounds of ranges.
    return cut(out, "list-problems")
