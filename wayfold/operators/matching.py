"""Exact name matching: an inverted index of normalised names, and ranked candidates from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BYNAMES, NAME_RANKS
from ..functions import geo, tags
from ..functions.text import name_rank, name_values, norm


def name_index(objects: DataFrame) -> DataFrame:
    """Rows (key, src, t, id, rank, byname): every variant of every name tag of objects (src, t, id, tags).

    Of several tags that give one object the same key the best rank counts; byname says
    that each of them tells only what the object also goes by. Objects without a name do
    not appear.
    """
    keys = F.array(*[F.lit(k) for k in NAME_RANKS])
    named = objects.select("src", "t", "id", "tags", F.explode(keys).alias("tag")).where(F.col("tags")[F.col("tag")].isNotNull())
    each = named.select("src", "t", "id", name_rank("tag").alias("base"), F.col("tag").isin(*BYNAMES).alias("byname"), F.explode(name_values(F.col("tags")[F.col("tag")])).alias("v"))
    each = each.select(norm(F.col("v.value")).alias("key"), "src", "t", "id", (F.col("base") + F.col("v.penalty")).alias("rank"), "byname").where("key <> ''")
    return each.groupBy("key", "src", "t", "id").agg(F.min("rank").alias("rank"), F.bool_and("byname").alias("byname"))


def source_place(src: Column | str, sources: tuple[str, ...] = ()) -> Column:
    """The order of sources as struct(number, name): those named in ``sources`` in that order, then the others by name."""
    src = F.col(src) if isinstance(src, str) else src
    at = F.array_position(F.array(*[F.lit(s) for s in sources]).cast("array<string>"), src)
    return F.struct(F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(len(sources) + 1)).cast("int").alias("number"), src.alias("name"))


def type_place(t: Column | str) -> Column:
    """The order of types in a source: nodes, ways, relations."""
    return F.array_position(F.array(F.lit("n"), F.lit("w"), F.lit("r")), F.col(t) if isinstance(t, str) else t).cast("int")


def lookup(queries: DataFrame, index: DataFrame, by: str = "name") -> DataFrame:
    """Rows of ``queries`` joined to the index on the normalised form of a column."""
    return queries.withColumn("key", norm(by)).where("key <> ''").join(index, "key")


def ranked_candidates(hits: DataFrame, row: str = "row_id", sources: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (row, t, id): least rank, byname only if all hits are; the last source's payload (src, lon, lat, tags)."""
    payload = F.struct(*[c for c in ("src", "lon", "lat", "tags") if c in hits.columns])
    return hits.groupBy(row, "t", "id").agg(F.min("rank").alias("rank"), F.bool_and("byname").alias("byname"), F.max_by(payload, source_place("src", sources)).alias("p")).select(row, "t", "id", "rank", "byname", "p.*")


def split_by_rank(cands: DataFrame, row: str = "row_id") -> DataFrame:
    """Candidates with ``best``: whether theirs is the least rank of the row."""
    return cands.withColumn("best", F.col("rank") == F.min("rank").over(Window.partitionBy(row)))


def listed(cands: DataFrame, row: str = "row_id") -> DataFrame:
    """Candidates with ``place``: by rank, distance from the centre (unknown last), type letter and id."""
    km = geo.km_or(geo.from_centre("lon", "lat"), float("inf"))
    return cands.withColumn("place", F.row_number().over(Window.partitionBy(row).orderBy("rank", km, "t", "id")))


def top_with_more(rows: DataFrame, by: list[str], order: list[Column], n: int = 20) -> DataFrame:
    """The first ``n`` of each group in order, with ``more``: how many are left out.

    Groups are counted apart from their order, so that the window plans to a group limit
    before the shuffle and no hot group is sorted whole. Rows with a null key form a group.
    """
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n")).withColumnsRenamed({c: f"__{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return first.join(counts, same).withColumn("more", F.greatest(F.col("__n") - n, F.lit(0))).drop("__n", *[f"__{c}" for c in by])


def taken_and_free(cands: DataFrame, claimed: DataFrame, on: list[str]) -> DataFrame:
    """Candidates with ``taken``: whether a claim (distinct on the keys) holds them."""
    held = claimed.select(*on).distinct().withColumn("__held", F.lit(True))
    return cands.join(held, on, "left").withColumn("taken", F.coalesce("__held", F.lit(False))).drop("__held")


def first_source_wins(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables of one shape; of rows with one key those of the first table that has it."""
    whole = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_place", F.lit(i))
        whole = s if whole is None else whole.unionByName(s)
    return whole.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("source_place"))).where("__n = 1").drop("__n")


def ref_text(t: Column | str, ident: Column | str) -> Column:
    """``way/12`` of a type letter and a number."""
    t, ident = (F.col(c) if isinstance(c, str) else c for c in (t, ident))
    return F.concat(F.when(t == "n", "node/").when(t == "w", "way/").otherwise("relation/"), ident.cast("string"))


def best_member(members: Column, score) -> Column:
    """The member with the greatest score, the first among equals."""
    scored = F.transform(members, lambda m, i: F.struct(score(m).alias("s"), (-i).alias("i"), m.alias("m")))
    return F.get(F.sort_array(F.transform(scored, lambda x: F.struct(x["s"], x["i"])), asc=False), F.lit(0))["i"] * -1
