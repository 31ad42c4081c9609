"""The persistent queue: an append-only event log read as a stream, and a log of what became of it.

A micro-batch takes all that is queued, waits until the newest of it is QUIET_SECONDS
old, collapses it by path and indexes the notes that are there, in parallel, in one
commit. A note that fails holds up no other: it goes back to the log with one more
attempt and its error, and a batch of such retries alone waits for RETRY_SECONDS. A batch without failures has emptied the queue and
ends with the table's upkeep. A batch is replayed after a crash and commits once, as
its id is stored with the table, and its outcomes are written over.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import queue as work_list
from lodestone.plans.indexer import OUTCOMES, Indexer
from lodestone.sources.store import Files

EVENTS = "path string, enqueued_at string, updated_at string, attempts int, last_error string"
QUIET_SECONDS, RETRY_SECONDS = 0.75, 10.0


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Queue:
    """The queue kept at ``root``: events, outcomes and the stream's checkpoint."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def _append(self, rows: DataFrame) -> None:
        kinds = [c.split() for c in EVENTS.split(", ")]
        rows.select(*[F.col(c).cast(kind) for c, kind in kinds]).write.mode("append").parquet(f"{self.root}/events")

    def add(self, paths: list[str] | DataFrame, now: str | None = None) -> None:
        """Queues markdown paths that were made or changed; others are left out."""
        rows = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in paths], "path string")
        at = F.lit(now or _now())
        rows = rows.where(F.endswith("path", F.lit(".md"))).select("path", at.alias("enqueued_at"), at.alias("updated_at"), F.lit(0).alias("attempts"), F.lit("").alias("last_error"))
        self._append(rows)

    def add_all(self, indexer: Indexer, notes: DataFrame) -> None:
        """Queues every note, once the chunks of notes that are gone have been dropped."""
        indexer.remove_missing(notes)
        self.add(notes.select("path"))

    def renamed(self, indexer: Indexer, moves: DataFrame) -> None:
        """Moves chunks by (old_path, new_path) and queues the new paths."""
        indexer.rename(moves)
        self.add(moves.select(F.col("new_path").alias("path")))

    def removed(self, indexer: Indexer, live: DataFrame) -> int:
        """After deletions: drops the chunks of paths that are not live."""
        return indexer.remove_missing(live)

    def outcomes(self) -> DataFrame:
        """batch, path, updated_at (of the work that it ended), outcome and error."""
        schema = OUTCOMES + ", updated_at string, batch long"
        return self.spark.read.schema(schema).parquet(f"{self.root}/outcomes") if self.files.names("outcomes") else self.spark.createDataFrame([], schema)

    def pending(self) -> DataFrame:
        """path, enqueued_at, updated_at, attempts and last_error of what waits, in the order of updated_at."""
        events = self.spark.read.schema(EVENTS).parquet(f"{self.root}/events") if self.files.names("events") else self.spark.createDataFrame([], EVENTS)
        done = self.outcomes().groupBy("path").agg(F.max("updated_at").alias("until"))
        left = events.join(done, "path", "left").where(F.col("until").isNull() | (F.col("updated_at") > F.col("until")))
        return work_list.pending(left).orderBy("updated_at", "path")

    def status(self) -> dict:
        """queued, processed, embedded, metadata_only, unchanged, failed, and last_error: of the last batch, "" if nothing failed in it."""
        done = self.outcomes()
        counts = work_list.stats(done.select("path", work_list.kind(F.col("outcome")).alias("outcome"))).first().asDict()
        last = done.groupBy("batch").agg(F.min_by("error", F.struct(F.col("error").isNull(), "path")).alias("e")).orderBy(F.desc("batch")).first()
        return counts | {"queued": self.pending().count(), "last_error": (last.e or "") if last else ""}

    def start(self, notes: Callable[[], DataFrame], indexer: Indexer, trigger: dict | None = None, retry_seconds: float = RETRY_SECONDS) -> StreamingQuery:
        """Runs the queue; ``trigger`` is for writeStream.trigger: an interval repeats, availableNow drains. Stop the query to stop it."""

        def batch(events: DataFrame, number: int) -> None:
            self._wait(events, retry_seconds)
            work = work_list.pending(events).persist()
            chosen = notes().join(work.select("path"), "path", "left_semi")
            found = indexer.outcomes(chosen, f"{self.root}#{number}")
            # Paths that are gone, or no notes, are skipped.
            done = work.join(found, "path", "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))
            done.select("path", "outcome", "error", "updated_at").write.mode("overwrite").parquet(f"{self.root}/outcomes/batch={number}")
            failed = done.where("outcome = 'failed'")
            again = failed.select("path", "enqueued_at", F.lit(_now()).alias("updated_at"), (F.col("attempts") + 1).alias("attempts"), F.col("error").alias("last_error"))
            if failed.isEmpty():
                indexer.drained()
            else:
                self._append(again)
            work.unpersist()

        if not self.files.names("events"):  # a stream needs its folder
            self._append(self.spark.createDataFrame([], EVENTS))
        stream = self.spark.readStream.schema(EVENTS).parquet(f"{self.root}/events")
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**(trigger or {"processingTime": f"{round(QUIET_SECONDS * 1000)} milliseconds"})).start()

    @staticmethod
    def _wait(events: DataFrame, seconds: float) -> None:
        last, tried = events.agg(F.max("updated_at"), F.min("attempts")).first()
        if last is not None:
            pause = seconds if tried else QUIET_SECONDS
            time.sleep(min(max(0.0, datetime.fromisoformat(last).timestamp() + pause - time.time()), pause))
