"""Search over names by prefix and by small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm

#: Results of a search, and edits allowed as a share of the term's length.
RESULTS = 8
FUZZY = 0.2


def search_text(*columns: str):
    """Distinct names that are not empty, joined by spaces."""
    return F.array_join(F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))), " ")


def terms(entries: DataFrame, key: str, text: str) -> DataFrame:
    return entries.select(key, F.explode(F.array_distinct(F.filter(F.split(norm(text), " "), lambda w: w != ""))).alias("term"))


def search(entries: DataFrame, key: str, text: str, query: str, results: int = RESULTS) -> DataFrame:
    """Rows (key, distance, place): the first results for a one-word query.

    A term matches as itself, as a longer word that begins so (a half for each letter more is
    not counted, only that it is longer), or within round(0.2 * length) edits. Order: edits,
    whether it is a longer word, then key.
    """
    q = norm(F.lit(query))
    edits = F.round(F.length(q) * FUZZY).cast("int")
    t = terms(entries, key, text)
    prefix = F.startswith(F.col("term"), q)
    distance = F.when(F.col("term") == q, 0.0).when(prefix, 0.5).otherwise(F.levenshtein("term", q).cast("double"))
    hits = t.withColumn("distance", distance).where(prefix | (F.abs(F.length("term") - F.length(q)) <= edits) & (F.col("distance") <= edits))
    best = hits.groupBy(key).agg(F.min("distance").alias("distance"))
    return best.orderBy("distance", key).limit(results).withColumn("place", F.row_number().over(Window.orderBy("distance", key)))
