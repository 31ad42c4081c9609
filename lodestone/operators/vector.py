"""Exact nearest neighbours by cosine distance.

Distances are a matrix product per Arrow batch, and each batch passes on only rows
that could be among the k nearest, so what meets in the final top-k is k rows a
batch, not the table. Filters belong before this operator, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores are rounded to this many digits before they are compared, so equal texts tie.
DIGITS = 9


def _distances(vectors: pa.ListArray, query: np.ndarray, norm: float) -> np.ndarray:
    """1 - cosine; NaN for a row that is null, of another dimension or zero."""
    n, dim = len(vectors), len(query)
    out = np.full(n, np.nan)
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    if not len(rows) or not norm:
        return out
    same = vectors if len(rows) == n else vectors.take(pa.array(rows))
    m = same.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    size = np.sqrt((m * m).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out[rows] = np.where(size > 0, 1 - (m * query).sum(1) / (size * norm), np.nan)
    return out


def nearest(rows: DataFrame, query: list[float], limit: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The ``limit`` rows (one at least) nearest to ``query``, with distance and score = 1 / (1 + distance).

    Ties go by ``key``. Rows whose distance is not defined are left out.
    """
    limit = max(1, limit)
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    kept = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.inf
        for b in batches:
            d = np.round(_distances(b.column(vector), q, norm), DIGITS) + 0.0  # no negative zero
            near = np.flatnonzero(d <= bound)
            if len(near) > limit:
                bound = np.partition(d[near], limit - 1)[limit - 1]
                near = near[d[near] <= bound]
            pick = pa.array(near)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in kept), pa.array(d[near])], names=[*kept, "distance"])

    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("distance", T.DoubleType())])
    found = rows.select(*kept, vector).mapInArrow(run, schema)
    return found.orderBy("distance", key).limit(limit).withColumn("score", 1 / (1 + F.col("distance")))
