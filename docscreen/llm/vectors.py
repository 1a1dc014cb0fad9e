"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and some component that isn't zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1)


def widths(rows: DataFrame, column: str) -> list[int]:
    """The different lengths; vectors of different lengths are never compared."""
    return sorted(r["w"] for r in rows.select(F.size(column).alias("w")).distinct().collect())
