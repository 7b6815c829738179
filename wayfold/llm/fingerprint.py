"""Document fingerprints: threshold-scaled sketches of word shingles, on Spark functions only.

A sketch keeps every 64-bit shingle hash below ``FRACTION`` of the hash range, whatever the
length of the text, so that sketches can be merged and compared hash by hash. Beside it
stands a digest of all the text's shingles, which tells equal sets from unknown ones where
a short text has no hash below the fraction.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
FRACTION = 1 / 4
#: Ranges of ids for each shuffle partition while neighbours by id are found.
RANGES = 8

_TOP = (1 << 63) - 1


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def with_shingles(df: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """Add ``out``: the sorted distinct non-negative 63-bit hashes of the word shingles of ``text``.

    A text with fewer words is one shingle; one without words has none.
    """
    w, h = f"{out}__w", f"{out}__h"
    df = df.withColumn(w, words_of(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    # The array is zipped with itself shifted, so that the lambda needs only its own argument:
    # should the optimizer put the array's expression in place of its name, it still runs once.
    n = F.size(h)
    runs = F.slice(F.arrays_zip(*[F.slice(h, k + 1, F.greatest(n, F.lit(1))).alias(f"s{k}") for k in range(words)]), F.lit(1), F.greatest(n - words + 1, F.lit(0)))
    long = F.transform(runs, lambda z: F.xxhash64(*[z[f"s{k}"] for k in range(words)]).bitwiseAND(F.lit(_TOP)))
    short = F.when(n == 0, F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(F.col(h)).bitwiseAND(F.lit(_TOP))))
    return df.withColumn(out, F.sort_array(F.array_distinct(F.when(n >= words, long).otherwise(short)))).drop(w, h)


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Add ``out`` (array of the hashes below the fraction, ascending) and ``out_digest`` (long: of all hashes).

    Equal texts have equal sketches. A null, empty or wordless text has an empty one.
    """
    below = math.floor(fraction * 2.0**63)
    s = f"{out}__s"
    df = with_shingles(df, text, s, words)
    return df.withColumn(out, F.filter(s, lambda x: x < F.lit(below))).withColumn(f"{out}_digest", F.xxhash64(s)).drop(s)


def likeness(a: str, b: str) -> Column:
    """Estimated containment, 0 to 1, of the smaller of two shingle sets in the larger.

    It is 1 for equal sets, told by their digests, and 0 where a side has no hash to go by.
    """
    size = F.least(F.size(a), F.size(b))
    return F.when(F.col(f"{a}_digest") == F.col(f"{b}_digest"), F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / size)


def merged(sketches: DataFrame, by: list[str], sketch: str = "sketch") -> DataFrame:
    """One sketch for each group: the hashes of all its rows. A merged sketch has no digest.

    Sums before it shuffles; the result of a group grows with its distinct hashes, of
    which ``FRACTION`` are kept. Groups without a hash have an empty sketch.
    """
    groups = sketches.select(*by).distinct()
    hashes = sketches.select(*by, F.explode(F.filter(sketch, lambda x: x.isNotNull())).alias("h")).distinct()
    packed = hashes.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(sketch)).withColumnsRenamed({c: f"__{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    out = groups.join(packed, same, "left") if by else groups.crossJoin(packed)
    return out.select(*by, F.coalesce(sketch, F.array().cast("array<long>")).alias(sketch))


def as_text(sketch: str) -> Column:
    """A sketch as text: the digest and the hashes in hex, colon and comma separated."""
    return F.concat(F.lower(F.hex(f"{sketch}_digest")), F.lit(":"), F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ","))


def _range_of(key: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are at most the key: first among every so many of them, then within one stretch."""
    step = max(1, math.isqrt(len(edges)))
    # One folded literal each, so that the plan stays small with any number of edges.
    heads = F.from_json(F.lit(json.dumps(edges[::step])), "array<double>")
    fine = F.from_json(F.lit(json.dumps([edges[i : i + step] for i in range(0, len(edges), step)])), "array<array<double>>")
    coarse = F.size(F.filter(heads, lambda e: e <= key))
    within = F.size(F.filter(F.get(fine, coarse - 1), lambda e: e <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + within)


def with_next(docs: DataFrame, id_col: str, text_col: str, more=lambda df: df) -> DataFrame:
    """Add ``next_<col>``: the values of the row with the next lower id, round to the first.

    The columns are the id's and the text's and those that ``more`` adds to them; ``more`` is
    applied after the rows are dealt out, so that only ids and texts are shuffled, once.
    Rows are dealt by ranges of ids that hold about equally many rows, however ids are
    spread; the first row of each range is also put at the end of the range above it, so
    each range is finished by itself. Rows without an id come last; ties are in order of
    their texts. Rows of one id are in one range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    docs = docs.select(id_col, text_col)
    edges = docs.approxQuantile(id_col, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    number = F.col(id_col).cast("double")
    place = F.when(number.isNull(), F.lit(-1)).otherwise(_range_of(number, sorted(set(edges)))) if edges else F.lit(-1)
    dealt = docs.withColumn("__b", place)
    # The range that the first row of each range has to close: the next above it that has rows, for the last the first.
    tops = sorted(dealt.groupBy("__b").agg(F.max(id_col).alias("top")).collect(), key=lambda r: r["__b"])
    ups = [(r["__b"], r["top"], tops[(i + 1) % len(tops)]["__b"]) for i, r in enumerate(tops)]
    kind = docs.schema[id_col].dataType.simpleString()
    table = docs.sparkSession.createDataFrame(ups, f"__r int, __top {kind}, __up int")
    heads = docs.join(F.broadcast(table), F.col(id_col).eqNullSafe(F.col("__top")))
    # A row of least text of each range's top id; the table has a row for each range, fewer than the driver has edges.
    heads = heads.groupBy("__up").agg(F.min(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t"))).alias("s")).select(F.col("s.i").alias(id_col), F.col("s.t").alias(text_col), F.col("__up").alias("__b"))
    both = dealt.withColumn("__end", F.lit(False)).unionByName(heads.withColumn("__end", F.lit(True)))
    full = more(both.repartition(parts // RANGES, "__b"))
    by = Window.partitionBy("__b").orderBy("__end", F.col(id_col).desc_nulls_last(), F.col(text_col).asc_nulls_first())
    cols = [c for c in full.columns if c not in ("__b", "__end")]
    return full.select("*", *[F.lead(c).over(by).alias(f"next_{c}") for c in cols]).where("not __end").drop("__b", "__end")
