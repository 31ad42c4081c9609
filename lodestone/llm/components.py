"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): the least node reachable, for nodes that have an edge.

    A step joins each node's edges with its least neighbour; hubs are rows of a
    sort-merge join, which Spark splits, and counts combine before they shuffle.
    Each round is written to the shared folder, and rounds end when none changes an
    edge. Self-edges and repeats are ignored.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct(), "edges")
    last = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "p").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return e.select(F.col("v").alias("node"), F.col("p").alias("root")).unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
        last = state
        both = e.select(F.col("v").alias("u"), F.col("p").alias("w")).unionByName(e.select(F.col("p").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("p")).distinct()
        root = large.groupBy("v").agg(F.min("p").alias("m"))
        small = large.join(root, "v").select(F.explode(F.when(F.col("p") > F.col("m"), F.array(F.struct(F.col("p").alias("v"), F.col("m").alias("p")), F.struct(F.col("v"), F.col("m").alias("p")))).otherwise(F.array(F.struct(F.col("v"), F.col("m").alias("p"))))).alias("e"))
        old, e = e, written(small.select("e.v", "e.p").distinct(), "edges")
        forget(old)
