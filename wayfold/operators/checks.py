"""Constraints and consistency: each gives the rows that break a rule, as (line, message) or with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def problems(rows: DataFrame, line: str, rules: list[tuple[Column, str]], first_only: bool = False) -> DataFrame:
    """Rows (line, message) for each rule that a row breaks, or only for the first. A null test is not a breach."""
    found = F.filter(F.array(*[F.when(test, F.lit(what)) for test, what in rules]), lambda m: m.isNotNull())
    each = F.slice(found, 1, 1) if first_only else found
    return rows.select(F.col(line).alias("line"), F.explode(each).alias("message"))


def id_problems(rows: DataFrame, id_col: str, line: str, pattern: str = "^[a-z0-9]+(-[a-z0-9]+)*$") -> DataFrame:
    """Missing, malformed or repeated ids."""
    ident = F.coalesce(F.col(id_col), F.lit(""))
    # Ids that several rows have, merged before the shuffle; rows without an id meet nowhere.
    several = rows.where(ident != "").groupBy(F.col(id_col).alias("__id")).agg(F.min(line).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    marked = rows.join(several, F.nullif(ident, F.lit("")) == F.col("__id"), "left")
    return problems(marked, line, [(ident == "", "no id"), (~ident.rlike(pattern), "malformed id"), (F.col("__first") < F.col(line), "id of an earlier line")], True)


def missing_refs(wanted: DataFrame, located: DataFrame, asked: DataFrame, ref: str = "ref") -> DataFrame:
    """Wanted references without an object, and whether one was ever asked for."""
    gone = wanted.select(ref).distinct().join(located.select(ref), ref, "left_anti")
    return gone.join(asked.select(ref).distinct().withColumn("asked", F.lit(True)), ref, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def stamp_difference(a: DataFrame, b: DataFrame, label: str = "label", digest: str = "digest") -> DataFrame:
    """Labels whose digests differ, or that one side lacks."""
    both = a.select(label, F.col(digest).alias("a")).join(b.select(label, F.col(digest).alias("b")), label, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], tolerance: dict[str, float] | None = None) -> DataFrame:
    """Rows (key, field, a, b) for each field that differs; nulls are equal to each other, numbers within the tolerance."""
    tolerance = tolerance or {}
    both = left.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(right.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)

    def differs(f: str) -> Column:
        a, b = F.col(f"a_{f}"), F.col(f"b_{f}")
        return F.coalesce(F.abs(a - b) > tolerance[f], ~a.eqNullSafe(b)) if f in tolerance else ~a.eqNullSafe(b)

    each = F.array(*[F.when(differs(f), F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("string").alias("a"), F.col(f"b_{f}").cast("string").alias("b"))) for f in fields])
    return both.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def first_line_difference(a: DataFrame, b: DataFrame, line: str = "line", text: str = "text") -> DataFrame:
    """The first line at which two numbered texts differ, with both; no row if they are equal."""
    both = a.select(line, F.col(text).alias("a")).join(b.select(line, F.col(text).alias("b")), line, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.orderBy(line).limit(1)


def shared_names(rows: DataFrame, key: str, names: Column) -> DataFrame:
    """Rows (name, keys) of names, in any case, that several rows have."""
    each = rows.select(key, F.explode(F.array_distinct(F.transform(names, F.lower))).alias("name")).where("name <> ''")
    return each.groupBy("name").agg(F.array_sort(F.collect_set(key)).alias("keys")).where(F.size("keys") > 1)


def offending_blocks(labels: DataFrame, text: str, available: list[str], label: str | None = None) -> DataFrame:
    """The first label (the text itself, or another column) of each block of 256 code points that is not available."""
    from ..functions.text import block_of

    # Most letters are of the first block, which is told without splitting the text.
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    rest = F.filter(F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x{FF}]+", ""), "")), lambda c: c != "")
    codes = F.concat(F.when(F.col(text).rlike(r"[\x00-\x{FF}]"), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.transform(rest, code))
    each = labels.select(F.col(label or text).alias("label"), F.explode(codes).alias("code"))
    return each.withColumn("block", block_of("code")).where(~F.col("block").isin(*available)).groupBy("block").agg(F.min("label").alias("label"))


def order_breaks(rows: DataFrame, part: str, line: str, key: str) -> DataFrame:
    """Rows whose key is not above that of the row before."""
    return rows.withColumn("before", F.lag(key).over(Window.partitionBy(part).orderBy(line))).where(F.col("before") >= F.col(key))
