"""What the classifiers share: the bounded sample of labelled documents they learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT = 2


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out fold.

    The sample is the documents that come first in the order of a hash, taken whole;
    one that would make more than ``chars`` characters is passed over. Rows without a text, id or label are left out.
    Of repeated rows of an id the longest text counts, and its highest label.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    sizes = docs.select("doc_id", F.length("text").alias("n")).where("n > 0").groupBy("doc_id").agg(F.max("n").alias("n"))
    chosen, total = [], 0
    for r in marks.join(sizes, "doc_id").orderBy(order, "doc_id").limit(rows).collect():
        if total + r.n > chars:
            continue
        total += r.n
        chosen.append((r.doc_id, r.y))
    if not chosen:
        return [], np.empty(0)
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int")
    # At most ``rows`` ids: a proven bound for the broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null")
    # One text an id, so repeated rows do not add up on the driver.
    longest = found.groupBy("doc_id", "y").agg(F.max(F.struct(F.length("text").alias("n"), "text"))["text"].alias("text"))
    got = sorted((r.doc_id, r.text, r.y) for r in longest.collect())
    return [t for _, t, _ in got], np.array([y for _, _, y in got], np.float64)


def sigmoid(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
