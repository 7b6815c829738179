"""Names to show: fallback chains over columns that a registry of varieties lays out."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present, primary, slug


@dataclass(frozen=True)
class Variety:
    tag: str
    column: str
    language: str


def name_columns(varieties: list[Variety], local: str = "local", rest: tuple[str, ...] = ("de", "da")) -> list[str]:
    """Columns of a name list in order: the first variety, local, the other varieties, then the rest."""
    first, *others = [v.column for v in varieties]
    return [first, local, *others, *rest]


def any_name(columns: list[str]) -> Column:
    """The first name along the columns, or the empty string."""
    return F.coalesce(*[present(primary(c)) for c in columns], F.lit(""))


def described(columns: list[str], german: str = "de") -> Column:
    dash = lambda c: F.coalesce(present(c), F.lit("-"))
    return F.format_string("%s (%s)", dash(any_name(columns)), dash(primary(german)))


def variety_name(v: Variety, area: Column, local: str = "local") -> Column:
    """A variety's own column; the local one where the variety is the area's."""
    return F.coalesce(present(primary(v.column)), F.when(area == v.tag, present(primary(local))), F.lit(""))


def local_name(varieties: list[Variety], area: Column, local: str = "local") -> Column:
    """The local column, else the name in the area's variety."""
    own = [F.when(area == v.tag, present(primary(v.column))) for v in varieties]
    return F.coalesce(present(primary(local)), *own, F.lit(""))


def resolved(rows: DataFrame, varieties: list[Variety], area: str = "area") -> DataFrame:
    """Rows with ``names``: tag to name for each variety that has one, and ``local``."""
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(v.tag), variety_name(v, F.col(area))) for v in varieties]))
    return rows.withColumn("names", F.map_filter(pairs, lambda k, v: v != "")).withColumn("local_name", local_name(varieties, F.col(area)))


#: Property that holds the name which the people of a place use themselves, and the view that shows it.
LOCAL = "name:local"
LOCAL_VIEW = "local"


def label_chain(view: str, in_area: bool, varieties: list[Variety], language: str = "frr") -> list[str]:
    """Properties to try in order for a view, inside or outside the areas of the registry's language.

    The local view shows no variety's name: local, then the majority languages. A variety's
    view tries its own name, local if inside, the other varieties, the language itself,
    local if outside, then the majority languages and the generic names.
    """
    if view == LOCAL_VIEW:
        return [LOCAL, "name:nds", "name:latin", "name", "name:de"]
    others = [f"name:{v.tag}" for v in varieties if v.language == language and v.tag != view]
    local = [LOCAL]
    return [f"name:{view}", *(local if in_area else []), *others, f"name:{language}", *([] if in_area else local), "name:nds", "name:de", "name:latin", "name"]


def shown(chain: list[str]) -> Column:
    """struct(name, source) of the first property of a chain with a value; null for none."""
    return F.coalesce(*[F.when(present(f"`{c}`").isNotNull(), F.struct(F.col(f"`{c}`").alias("name"), F.lit(c).alias("source"))) for c in chain])


def new_ids(rows: DataFrame, names: str | list[str], line: str, taken: DataFrame | None = None) -> DataFrame:
    """Rows with ``id``: the slug of the first name along the columns, with -2, -3 ... where that is taken.

    Rows are given ids in order of ``line`` (distinct); ``taken`` (id) holds ids that others
    have. Rows without a usable name are called ``row``. Only ids that are alike up to
    numbers at their end can meet: where all rows of such a family have one slug and none is
    taken they are numbered by a window; the other families are folded one by one.
    """
    columns = [names] if isinstance(names, str) else names
    base = F.coalesce(*[present(slug(primary(c))) for c in columns], F.lit("row"))
    stem = lambda c: F.regexp_replace(c, "(-[0-9]+)+$", "")
    s = rows.withColumn("__s", base).withColumn("__stem", stem("__s"))
    held = rows.sparkSession.createDataFrame([], "id string") if taken is None else taken.select("id").where("id <> ''").distinct()
    held = held.select(stem("id").alias("__stem"), "id")
    several = s.groupBy("__stem").agg(F.min("__s").alias("a"), F.max("__s").alias("b")).where("a <> b").select("__stem")
    mixed = several.unionByName(held.select("__stem")).distinct().withColumn("__mixed", F.lit(True))
    marked = s.join(mixed, "__stem", "left")
    n = F.row_number().over(Window.partitionBy("__s").orderBy(line))
    alone = marked.where("__mixed IS NULL").withColumn("__n", n)
    alone = alone.select(*rows.columns, F.when(F.col("__n") == 1, F.col("__s")).otherwise(F.concat("__s", F.lit("-"), F.col("__n").cast("string"))).alias("id"))

    def fold(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        used, next_of, out = set(theirs["id"]), {}, []
        for at, slug_ in mine.sort_values("line")[["line", "base"]].itertuples(index=False):
            n = next_of.get(slug_, 1)
            while (ident := slug_ if n == 1 else f"{slug_}-{n}") in used:
                n += 1
            used.add(ident)
            next_of[slug_] = n
            out.append((at, ident))
        return pd.DataFrame(out, columns=["line", "id"])

    met = marked.where("__mixed").select("__stem", F.col(line).alias("line"), F.col("__s").alias("base")).groupBy("__stem")
    kind = rows.schema[line].dataType.simpleString()
    given = met.cogroup(held.groupBy("__stem")).applyInPandas(fold, f"line {kind}, id string").withColumnRenamed("line", "__line")
    folded = marked.where("__mixed").join(given, F.col(line) == F.col("__line")).select(*rows.columns, "id")
    return alone.unionByName(folded)


def row_state(kind: Column, status: Column, named: Column, local: Column, refers: Column) -> Column:
    """The state of a row, by the first rule that holds."""
    return (
        F.when(kind == "not_a_place", "not a place").when(status == "skip", "skip").when(~named, "no name").when(local, "own point")
        .when((status == "ok") | (refers & (status != "auto")), "by hand").when(refers, "auto").otherwise("open")
    )
