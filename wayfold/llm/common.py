"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import connected  # noqa: F401
from ..ship import ship
from ..sources.tables import cut, shared_dir  # noqa: F401


#: Rows of one Arrow batch that goes to a Python worker, where the session has Spark's default of 10,000.
BATCH_ROWS = 1000


def sized(df: DataFrame, rows: int = 200_000, size: Column | None = None, most: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join).

    Rows of a few numbers or hashes are bounded by their count alone; for wider ones ``size``
    gives a row's bytes, and all rows together have at most ``most``.
    """
    width = F.lit(0) if size is None else size
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if got["n"] <= rows and got["bytes"] <= most else df


_LIVE: dict[str, object] = {}


def living(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gave when this worker first asked for the key, with the words it keeps; only the latest model stays.

    What a model keeps is bounded by a constant of its module, a few dozen MB.
    """
    if key not in _LIVE:
        release()
        _LIVE[key] = make()
    return _LIVE[key]


def release() -> None:
    """Drop this worker's model; for operators that need none but run in workers of one that did."""
    _LIVE.clear()


def least_hashes(rows: DataFrame, n: int, k: int, id_col: str = "doc_id") -> DataFrame:
    """The ``k`` rows of ``n`` whose ids have the least hashes; all rows if there are no more than k.

    A first cut at a hash that a few more than k rows lie below, on the whole 63-bit range,
    leaves the ordering little to do; with any number of rows some k are found.
    """
    if n <= k:
        return rows
    h = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 63) - 1))
    share = min(1.0, (k + 6 * math.sqrt(k) + 20) / n)
    return rows.withColumn("__h", h).where(F.col("__h") <= F.lit(int(share * ((1 << 63) - 1)))).orderBy("__h", id_col).limit(k).drop("__h")


def within_chars(texts: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of a bounded sample the rows that fit into ``most`` characters, taken by the hash of their ids; at least one row."""
    sizes = texts.select(F.xxhash64(F.col(id_col)).alias("h"), F.length(text_col).alias("n")).collect()
    total, last = 0, None
    for r in sorted(sizes, key=lambda r: (r["h"], r["n"])):
        total += r["n"] or 0
        if last is not None and total > most:
            break
        last = r["h"]
    else:
        return texts
    return texts.where(F.xxhash64(F.col(id_col)) <= F.lit(last))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out")
