"""Clusters around centroids, exact although most distances are only estimated.

Vectors and centroids are whole numbers. A float32 matrix product estimates the distances of
a batch to all centroids at once, each with an interval that holds whatever rounding did;
centroids whose intervals reach below the least upper end are compared again with whole
numbers, ties going to the lowest number. So every assignment is the exact one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrices, whole

CLUSTERS, ROUNDS, DIM, SEED = 8, 10, 64, 3
#: Entries stay below this, so that a squared distance fits into 63 bits.
LARGEST = 1 << 27
#: Unit roundoff of float32 and of float64.
U32, U64 = 2.0**-24, 2.0**-53


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be the nearest of each vector (rows); the nearest ones always are among them.

    |x - c|^2 - |x|^2 = |c|^2 - 2 xc is estimated with xc as a float32 product. Rounding the
    entries to float32 (one roundoff each) and a sum of d products in any order err by at
    most g * sum |x_i c_i| with g = (d + 2) u / (1 - (d + 2) u), and that sum is at most
    |x| |c|. Norms, squares and the ends of the intervals are float64, whose own rounding
    the last terms cover.
    """
    d = x.shape[1]
    g = (d + 2) * U32 / (1 - (d + 2) * U32)
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    xx, cc = (np.einsum("ij,ij->i", m, m) for m in (x.astype(np.float64), c.astype(np.float64)))
    slack = 1 + 4 * (d + 8) * U64
    about = cc[None, :] - 2 * dot
    half = 2 * g * slack * np.sqrt(xx * slack)[:, None] * np.sqrt(cc * slack)[None, :] + (d + 8) * U64 * (cc[None, :] + 2 * np.abs(dot))
    low, high = about - half * slack, about + half * slack
    return low <= high.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the number of its nearest centroid, the squared distance, and how many vectors were compared again."""
    maybe = shortlist(x, c)
    found = maybe.argmax(axis=1)
    unsure = np.flatnonzero(maybe.sum(axis=1) > 1)
    if len(unsure):
        best = np.full(len(unsure), np.iinfo(np.int64).max)
        for k in range(len(c)):
            asked = np.flatnonzero(maybe[unsure, k])
            gap = x[unsure[asked]] - c[k]
            exact = (gap * gap).sum(axis=1)
            closer = exact < best[asked]
            best[asked[closer]] = exact[closer]
            found[unsure[asked[closer]]] = k
    gap = x - c[found]
    return found, (gap * gap).sum(axis=1), len(unsure)


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of ``seed:vec_id``, ascending; equal ids by their entries, rows without one last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def moved(rows: DataFrame, c: np.ndarray) -> np.ndarray:
    """One round: the floor of the mean of each centroid's vectors; a centroid without any stays."""
    sent = rows.sparkSession.sparkContext.broadcast(c)
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums = np.zeros((k, dim + 1), object)
        for _, x in matrices(batches, dim):
            found, _, _ = nearest(x, own)
            for j in np.unique(found):
                mine = x[found == j]
                sums[j] += np.concatenate(([len(mine)], mine.sum(axis=0)))
        some = np.flatnonzero(sums[:, 0])
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some].tolist(), pa.list_(pa.decimal128(38, 0)))], names=["cluster", "sums"])

    parts = rows.mapInArrow(run, "cluster int, sums array<decimal(38,0)>").select("cluster", F.posexplode("sums"))
    out = c.copy()
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "pos").agg(F.sum("col").alias("total")).collect():
        found.setdefault(r["cluster"], {})[r["pos"]] = int(r["total"])
    for j, sums in found.items():
        out[j] = [sums[i + 1] // sums[0] for i in range(dim)]
    sent.unpersist()
    return out


def clustered(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each kept vector.

    Kept are vectors of exactly ``dim`` entries, none null or non-finite, as whole numbers
    floor(1024 * entry); one of LARGEST or more is an error. Centroids start as the vectors
    with the least hashes; a round assigns all vectors and moves each centroid to the floor
    of their mean, an empty one stays. Rounds end early where nothing moves, as later ones
    would change nothing. With fewer vectors than ``k`` there are as many centroids as
    vectors. Repeated rows count as often as they are there; a null vec_id stays null and
    comes last among seeds; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = whole(df.where(F.size(vec_col) == dim), 0, id_col, vec_col, "whole-vectors")
    large = rows.where(F.exists("v", lambda e: F.abs(e) >= LARGEST)).limit(1).count()
    if large:
        raise ValueError(f"vectors with entries of {LARGEST // 1024} or more have no exact distances here")
    c = seeds(rows, k, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        before, c = c, moved(rows, c)
        if (before == c).all():
            break
    sent = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches, dim):
            found, distance, _ = nearest(x, sent.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    final = cut(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    each = {r["cluster"]: int(r["total"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    facts = [(j, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in sorted(each)]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
