"""Whitening of vectors by principal components, which cyclic Jacobi rotations find.

Tasks sum the vectors and then the products of their centred entries; the driver gets one
matrix of dimension by dimension, turns it until nothing is left off its diagonal, and
sends the whitening matrix back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrices, whole

COMPONENTS = 8
ADD = 100_000
#: Sweeps after which the rotations must have ended; a dozen do in practice.
SWEEPS = 60
EPS = np.finfo(float).eps


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """One sweep: all pairs of 0 to n - 1, in rounds of pairs that share no index."""
    ring, out = list(range(n + n % 2)), []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(a, b) < n]
        out.append(tuple(np.array(pairs, int).reshape(-1, 2).T))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    An entry counts as gone when it is below the rounding of its two diagonal entries, not of
    the largest one, which is what keeps small eigenvalues accurate. The rotations of a round
    touch different rows and columns, so they are applied together.
    """
    a = np.array(matrix, float)
    n = len(a)
    turned, sweep, least = np.eye(n), rounds(n), np.abs(a).max(initial=0.0) * EPS * EPS
    for _ in range(SWEEPS):
        still = True
        for p, q in sweep:
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            due = np.abs(apq) > np.maximum(EPS * np.sqrt(np.abs(app * aqq)), least)
            if not due.any():
                continue
            still = False
            p, q, apq, app, aqq = p[due], q[due], apq[due], app[due], aqq[due]
            # The smaller root of t^2 + 2 t cot(2 angle) - 1.
            cot = (aqq - app) / (2 * apq)
            t = np.where(cot < 0, -1.0, 1.0) / (np.abs(cot) + np.hypot(1.0, cot))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            for m in (a, turned):
                mp, mq = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * mp - s * mq, s * mp + c * mq
            rp, rq = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rp - s[:, None] * rq, s[:, None] * rp + c[:, None] * rq
            a[p, q] = a[q, p] = 0.0
        if still:
            break
    else:
        raise ArithmeticError("the rotations did not end")
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = turned[:, order]
    return values[order], vectors / np.linalg.norm(vectors, axis=0)


def _summed(parts: DataFrame, kind: str) -> dict[int, float]:
    """Sums by place of arrays, one of which a task has."""
    return {r["pos"]: r["total"] for r in parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast(kind)).alias("total")).collect()}


def totals(rows: DataFrame, dim: int, kind: str = "decimal(38,0)") -> tuple[int, list]:
    """Number of rows (id, vector of ``dim``) and the sum of each entry; whole numbers are summed exactly."""
    whole_numbers = kind.startswith("decimal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, object if whole_numbers else float)
        for _, x in matrices(batches, dim, np.int64 if whole_numbers else float):
            small = not whole_numbers or np.abs(x).max(initial=0) < 1 << 50
            n, sums = n + len(x), sums + (x.sum(axis=0) if small else x.astype(object).sum(axis=0))
        if n:
            every = [n, *sums.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([every], pa.list_(pa.decimal128(38, 0) if whole_numbers else pa.float64()))], names=["sums"])

    found = _summed(rows.mapInArrow(run, f"sums array<{kind if whole_numbers else 'double'}>"), kind)
    cast = int if whole_numbers else float
    return int(found.get(0, 0)), [cast(found.get(k + 1, 0)) for k in range(dim)]


def covariance(rows: DataFrame, dim: int, n: int, sums: list) -> np.ndarray:
    """The covariance (divisor n) of rows (id, vector); each is centred before it is multiplied."""
    upper = np.triu_indices(dim)
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, seen = np.zeros((dim, dim)), False
        for _, x in matrices(batches, dim, float):
            y = x - mean
            scatter, seen = scatter + y.T @ y, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([scatter[upper]], pa.list_(pa.float64()))], names=["sums"])

    found = _summed(rows.mapInArrow(run, "sums array<double>"), "double")
    out = np.zeros((dim, dim))
    out[upper] = [found[k] / n for k in range(len(upper[0]))]
    return np.triu(out) + np.triu(out, 1).T


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row the sum of (n * x - S) squared, exactly."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if most * most * max(1, x.shape[1]) < 1 << 62 else object
    z = n * x.astype(kind) - np.array(sums, kind)
    return (z * z).sum(axis=1).tolist() if x.shape[1] else [0] * len(x)


def whitened(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation decimal, whitened, explained, identity_error): ``components`` for each usable vector.

    Vectors that are null or hold null or non-finite entries are dropped; the rest are as
    whole numbers x = floor(1024 * entry) + ADD, all in the fit list, repeated rows as often
    as they are there. ``n`` and ``deviation`` are exact, whatever their size. Components are
    numbered by falling variance, as many as there are dimensions at most.

    All vectors should have one length; where they don't, the fit list is that of the most
    frequent length (of equally frequent ones the longest). A component without variance
    beyond rounding (fewer rows than dimensions, constant entries) can't be scaled: its
    ``whitened`` is 0 and it does not count in ``identity_error``. An empty table, or vectors
    without entries, give an empty result; a null vec_id stays null.
    """
    spark = df.sparkSession
    every = whole(df, ADD, id_col, vec_col, "vectors")
    lengths = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    rows = every.where(F.size("v") == dim)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    if not dim:
        return spark.createDataFrame([], f"{schema}, identity_error double")
    n, sums = totals(rows, dim)
    values, vectors = jacobi(covariance(rows, dim, n, sums))
    kept = min(components, dim)
    trace = float(values.sum())
    able = values[:kept] > max(trace, 0.0) * EPS * dim
    scale = np.where(able, 1 / np.sqrt(np.where(able, values[:kept], 1.0)), 0.0)
    matrix = spark.sparkContext.broadcast((np.array([s / n for s in sums]), vectors[:, :kept] * scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = matrix.value
        for ids, x in matrices(batches, dim):
            scores = pa.array(list((x - mean) @ turn), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, scores, pa.array(deviations(x, n, sums), pa.decimal128(38, 0))], names=["vec_id", "w", "deviation"])

    made = cut(rows.mapInArrow(run, "vec_id long, w array<double>, deviation decimal(38,0)"), "whitened", "zstd")
    scores = made.select("vec_id", "w")
    _, means = totals(scores, kept, "double")
    off = covariance(scores, kept, n, means) - np.eye(kept)
    error = float(np.abs(off[np.ix_(able, able)]).max(initial=0.0))
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in values[:kept]])
    each = made.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
