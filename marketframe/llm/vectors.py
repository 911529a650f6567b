"""Whole-number vectors for the vector operators.

Each component ``x`` becomes ``floor(SCALE * x)``, with ``x`` as a double.
Vectors that are null, or hold a null or non-finite component, take no part.
Vectors shorter than the longest count as followed by zeros.  Results are exact
while ``|SCALE * x|`` stays below ``LIMIT``; larger components stand at it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import materialise

SCALE, LIMIT = 256, 1 << 28


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(row, vec_id, label, whole array<int>) of the vectors that take part,
    written once; ``row`` tells rows apart that repeat an id."""
    x = F.col(vec_col)
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))

    def whole(c):
        n = F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
        return n.cast("int")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return materialise(rows.where(x.isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        label.alias("label"), F.transform(x, whole).alias("whole")))


def dimension(whole: DataFrame) -> int:
    return whole.agg(F.max(F.size("whole"))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column as a matrix, zeros behind shorter ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out
