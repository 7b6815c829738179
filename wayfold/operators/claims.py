"""Claims: what a row has taken is not for a later row to take."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import connected


def first_holder(claims: DataFrame, claim: list[str], line: str) -> DataFrame:
    """The first line of each claim; ties by all other columns, so that the result is fixed."""
    rest = [c for c in claims.columns if c not in (*claim, line)]
    return claims.withColumn("__n", F.row_number().over(Window.partitionBy(*claim).orderBy(line, *rest))).where("__n = 1").drop("__n")


def claim_problems(claims: DataFrame, claim: list[str], line: str) -> DataFrame:
    """Claims that an earlier line holds (``holder``), or that the line has named before (``repeated``)."""
    w = Window.partitionBy(*claim)
    out = claims.withColumn("holder", F.min(line).over(w)).withColumn("repeated", F.row_number().over(Window.partitionBy(*claim, line).orderBy(F.lit(1))) > 1)
    return out.where((F.col("holder") < F.col(line)) | F.col("repeated"))


def conflict_groups(cands: DataFrame, row: str, thing: str) -> DataFrame:
    """Rows (row, conflict): rows that share candidates, directly or over others, have one conflict, the least of them.

    Each thing links its rows to the least of them, so a thing that very many rows share
    makes as many links as rows. A row that shares nothing is its own conflict; null things
    are shared by none.
    """
    pairs = cands.select(row, thing).distinct()
    hub = pairs.where(F.col(thing).isNotNull()).groupBy(thing).agg(F.min(row).alias("b"))
    edges = pairs.join(hub, thing).select(F.col(row).alias("a"), "b")
    roots = connected(edges).withColumnRenamed("node", row)
    return pairs.select(row).distinct().join(roots, row, "left").select(row, F.coalesce("root", row).alias("conflict"))


def resolve_in_order(cands: DataFrame, row: str, line: str, thing: str, order: list[str], decide: Callable[[pd.DataFrame], object] | None = None) -> DataFrame:
    """Rows (row, line, thing): what each row gets when rows choose in order of line.

    A row gets its first free candidate in ``order`` (or what ``decide`` picks of its free
    ones); what it gets is taken from then on. Rows only wait for rows they share candidates
    with: each conflict group is folded by itself, the rest in parallel. thing is null for a
    row that finds none free.
    """
    groups = conflict_groups(cands, row, thing)
    schema = cands.select(row, line, thing).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for (at, r), own in pdf.sort_values([line, row, *order], kind="stable").groupby([line, row], sort=True):
            free = own[~own[thing].isin(taken)]
            got = None if free.empty else decide(free) if decide else free.iloc[0][thing]
            if got is not None:
                taken.add(got)
            out.append((r, at, got))
        return pd.DataFrame(out, columns=[row, line, thing])

    return cands.join(groups, row).groupBy("conflict").applyInPandas(fold, schema)
