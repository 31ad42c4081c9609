"""Indexing: decide, re-chunk and embed only what changed, one commit a batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import maintain
from lodestone.operators.lexical import StoredIndex
from lodestone.plans.settings import Settings
from lodestone.sources.store import Store, tried
from lodestone.sources.vault import only_markdown, prepare

#: What becomes of each path of a batch.
OUTCOMES = "path string, outcome string, error string"


class Indexer:
    """Keeps the chunk table of ``store``, and beside it the index of its texts if one is given."""

    def __init__(self, store: Store, settings: Settings, embedder: Callable[[list[str]], list[list[float]]], index: StoredIndex | None = None):
        self.store, self.settings, self.embedder, self.lexical = store, settings.clamped(), embedder, index
        self._work: str | None = None

    def index(self, notes: DataFrame, live: DataFrame | None = None, batch: int | str | None = None, now: str | None = None) -> DataFrame:
        """Brings the table up to date with ``notes``; with ``live`` paths, drops paths that are not among them.

        Returns the counts. If the model fails for a note, the others are indexed
        all the same and then its error is raised; ``outcomes`` reports it instead.
        """
        done, removed = self._run(notes, live, batch, now)
        bad = done.where("outcome = 'failed'").agg(F.count(F.lit(1)), F.min_by(F.struct("path", "error"), "path")).first()
        if bad[0]:
            raise RuntimeError(f"{bad[0]} notes failed, first {bad[1].path}: {bad[1].error}")
        counts = maintain.stats(done.withColumnRenamed("outcome", "decision"), removed)
        return self.store.spark.createDataFrame([tuple(counts.first())], counts.schema)

    def outcomes(self, notes: DataFrame, batch: int | str | None = None, now: str | None = None) -> DataFrame:
        """Like index; returns path, outcome (the decision, or failed) and error of each note, to be read before the next call."""
        return self._run(notes, None, batch, now)[0]

    def _run(self, notes: DataFrame, live: DataFrame | None, batch: int | str | None, now: str | None) -> tuple[DataFrame, int]:
        s, spark = self.settings, self.store.spark
        now = now or datetime.now(UTC).isoformat()
        notes = only_markdown(notes)
        # A few notes are held against their parts alone.
        chunks = self.store.read(notes.select("path")) if live is None else self.store.read()
        prepared = prepare(notes, s.chunk_size, s.chunk_overlap, s.embedding_model, now)
        decided = maintain.decide(prepared, maintain.path_state(chunks)).persist()
        if self._work:  # the report of the last call stands until now
            self.store.files.delete(self._work)
        self._work = f"work/{uuid.uuid4().hex}"
        at = lambda name: f"{self.store.root}/{self._work}/{name}"
        # Written, so that the model is asked once a text, and shared, so that a lost executor loses none.
        changed = decided.where(F.col("decision").isin("missing", "content-changed", "config-changed")).drop("decision")
        maintain.embedded(changed, s.chunk_size, s.chunk_overlap, self.embedder).write.parquet(at("records"))
        made = spark.read.parquet(at("records"))
        bad = made.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))
        done = decided.select("path", "decision").join(bad, "path", "left")
        done.select("path", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("decision")).alias("outcome"), "error").write.parquet(at("outcomes"))
        done = spark.read.schema(OUTCOMES).parquet(at("outcomes"))
        new = maintain.with_vectors(made.join(done.where("outcome = 'failed'"), "path", "left_anti"))
        drop = done.where(F.col("outcome").isin("missing", "content-changed", "config-changed")).select("path")
        edited = done.where("outcome = 'metadata-only'").select("path")
        touched, removed, gone = drop.unionByName(edited), 0, None
        if live is not None:
            gone = maintain.missing_paths(chunks, live)
            removed = gone.count()
            touched = touched.unionByName(gone) if removed else touched

        def change(old: DataFrame) -> DataFrame:
            old = maintain.delete(old, gone) if removed else old
            kept = maintain.update_metadata(old, decided.join(edited, "path", "left_semi"))
            return maintain.replace(kept, drop, new)

        self.store.rewrite(touched, change, batch)
        decided.unpersist()
        return done, removed

    def rename(self, moves: DataFrame) -> int:
        """Moves chunks by (old_path, new_path). The renamed notes are due for indexing, as their ids keep the old path."""
        paths = moves.select(F.col("old_path").alias("path")).unionByName(moves.select(F.col("new_path").alias("path")))
        return self.store.rewrite(paths, lambda old: maintain.rename(old, moves))

    def remove_missing(self, live: DataFrame) -> int:
        """Drops the chunks of paths that are no longer live; how many paths."""
        gone = maintain.missing_paths(self.store.read(), live)
        n = gone.count()
        if n:
            self.store.rewrite(gone, lambda old: maintain.delete(old, gone))
        return n

    def drained(self) -> None:
        """What an emptied queue leaves to do: merge small files, bring the text index up to date."""
        tried(self.store.compact)
        if self.lexical:
            tried(lambda: self.lexical.refresh(self.store.read()))

    def rebuild_lexical(self) -> bool:
        """Makes the text index anew; whether there is one."""
        return bool(self.lexical) and tried(lambda: self.lexical.rebuild(self.store.read())) is not None

    def status(self) -> dict:
        return maintain.status(self.store.read()).first().asDict()
