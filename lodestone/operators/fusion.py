"""Merging two legs, competition ranks, and weighted reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition_rank(rows: DataFrame, score: str, out: str) -> DataFrame:
    """Ranks by score, highest first: equals share a rank and leave a gap. Rows without a score have none.

    Candidates are few by now (two limits at most), so one task ranks them.
    """
    w = Window.orderBy(F.col(score).desc_nulls_last())
    return rows.withColumn(out, F.when(F.col(score).isNotNull(), F.rank().over(w)))


def merge(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer join by id: (id, distance, score, fts_score, merge_order).

    Vector hits come first, by distance, then hits of the text search alone; a row
    that only the text search found has score 0.
    """
    order = lambda *by: F.row_number().over(Window.orderBy(*by))
    v = vector.select("id", "distance", "score", order("distance", "id").alias("v_order"))
    x = lexical.select("id", "fts_score", order(F.col("fts_score").desc(), "id").alias("l_order"))
    return v.join(x, "id", "full_outer").select(
        "id", "distance", F.coalesce("score", F.lit(0.0)).alias("score"), "fts_score",
        order(F.col("v_order").asc_nulls_last(), F.col("l_order").asc_nulls_last()).alias("merge_order"),
    )


def ranked(merged: DataFrame) -> DataFrame:
    """Adds vector_rank (of rows with a distance) and lexical_rank (of rows with a text score)."""
    v = merged.withColumn("_v", F.when(F.col("distance").isNotNull(), F.col("score")))
    return competition_rank(competition_rank(v, "_v", "vector_rank"), "fts_score", "lexical_rank").drop("_v")


def rrf(k: float, legs: dict[str, float]) -> Column:
    """The sum of weight / (k + rank) over the ranks that are there."""
    out = F.lit(0.0)
    for rank, weight in legs.items():
        out = out + F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    return F.round(out, 12)


def pruned(rows: DataFrame, limit: int, pool: int, k: float, vector: float, lexical: float) -> DataFrame:
    """The best max(limit, pool) candidates by the two legs' fused score. Ranks stay as they were."""
    pre = rows.withColumn("pre_score", rrf(k, {"vector_rank": vector, "lexical_rank": lexical}))
    return pre.orderBy(F.col("pre_score").desc(), "merge_order").limit(max(limit, pool))


def top(rows: DataFrame, limit: int, order: str = "merge_order") -> DataFrame:
    return rows.orderBy(F.col("fused_score").desc(), order, "id").limit(limit)
