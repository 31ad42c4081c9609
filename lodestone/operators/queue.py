"""The work queue as an event log: the newest event of a path counts, with its first time of entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(events: DataFrame) -> DataFrame:
    """(path, enqueued_at, updated_at, attempts), one row a path, and last_error of the newest if events have one.

    An event that comes anew does not take back attempts. Partial sums make hot paths cheap.
    """
    more = [F.max_by("last_error", F.struct("updated_at", "attempts")).alias("last_error")] if "last_error" in events.columns else []
    return events.groupBy("path").agg(F.min("enqueued_at").alias("enqueued_at"), F.max("updated_at").alias("updated_at"), F.max("attempts").alias("attempts"), *more)


def kind(decision: Column) -> Column:
    """The outcome that statistics count a decision as."""
    return F.when(decision.isin("missing", "content-changed", "config-changed"), "embedded").otherwise(decision)


def stats(results: DataFrame) -> DataFrame:
    """One row of counts over (path, outcome): outcomes embedded, metadata-only, unchanged, skipped, failed, queued."""
    n = lambda *names: F.coalesce(F.sum(F.col("outcome").isin(*names).cast("long")), F.lit(0))
    return results.agg(
        n("embedded", "metadata-only", "unchanged", "skipped").alias("processed"), n("embedded").alias("embedded"),
        n("metadata-only").alias("metadata_only"), n("unchanged").alias("unchanged"), n("failed").alias("failed"), n("queued").alias("queued"),
    )
