"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (a, b of one type that can be ordered): rows (node, root), root the least node.

    Alternates large-star and small-star steps until a round changes nothing. Each step is
    an aggregate with map-side combine and an equi-join, so a node with very many
    neighbours is summed before the shuffle and split by the adaptive skew join after it.
    Self-links and null ends are ignored; nodes without a link do not appear. The rounds grow
    with the logarithm of the longest chain, so ``rounds`` is out of reach: meeting it is an
    error. Rounds are written to the shared folder, so a lost executor costs a reread.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut(pairs, "links")
    seen = _checksum(pairs)
    for _ in range(rounds if seen[0] else 0):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _checksum(pairs)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _checksum(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]
