"""Vectors as whole numbers: which rows of a table have usable ones, and tables of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows that are held as a matrix at a time.
MATRIX_ROWS = 4096


def usable(df: DataFrame, col: str) -> DataFrame:
    """The rows whose vector is not null and holds neither null nor non-finite entries."""
    x = F.col(col)
    size = lambda v: F.abs(v.cast("double"))
    return df.where(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (size(v) == float("inf"))))


def whole(df: DataFrame, add: int, id_col: str, col: str, name: str) -> DataFrame:
    """A written table (vec_id long, v array<long>) of the usable rows: v is floor(1024 * entry) + ``add``.

    An entry whose number is no long is an error. Rows that repeat, and rows without an id, stay.
    """

    def number(e):
        scaled = e.cast("double") * 1024
        return F.when(F.abs(scaled) < float(1 << 62), F.floor(scaled) + F.lit(add).cast("long")).otherwise(F.raise_error(F.lit("an entry is too large for a whole number")).cast("long"))

    v = F.transform(F.col(col), number)
    return cut(usable(df, col).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")), name, "zstd")


def matrices(batches: Iterator[pa.RecordBatch], dim: int, dtype: type = np.int64) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and matrices (a row a vector) of batches (id, vector), all of ``dim`` entries."""
    for batch in batches:
        for k in range(0, len(batch), MATRIX_ROWS):
            part = batch.slice(k, MATRIX_ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(part), dim)
