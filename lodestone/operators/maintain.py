"""Incremental maintenance: what each note needs, and set-based changes of the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.chunk import chunk
from lodestone.plans.settings import CHUNKS
from lodestone.sources.models import embed

STATE = ("content_hash", "body_hash", "frontmatter_hash", "chunking_config_hash", "embedding_model", "embedding_dim")
#: What a change of metadata alone rewrites.
METADATA = ("folder", "basename", "mtime", "size", "title", "status", "project", "type", "content_hash", "frontmatter_hash", "indexed_at", "tags", "inline_tags", "frontmatter_tags", "aliases", "frontmatter_keys", "tags_text", "aliases_text", "frontmatter_keys_text", "frontmatter_json")


def path_state(chunks: DataFrame) -> DataFrame:
    """The fingerprints of each indexed path, from its first chunk."""
    return chunks.groupBy("path").agg(*[F.min_by(c, "position").alias(c) for c in STATE])


def decision() -> Column:
    """missing, config-changed, unchanged, metadata-only or content-changed; the first that fits."""
    differs = lambda c: F.col(f"new.{c}") != F.col(f"old.{c}")
    return (
        F.when(F.col("old.path").isNull(), "missing")
        .when(differs("chunking_config_hash") | differs("embedding_model"), "config-changed")
        .when(~differs("content_hash"), "unchanged")
        .when(~differs("body_hash") & differs("frontmatter_hash"), "metadata-only")
        .otherwise("content-changed")
    )


def decide(prepared: DataFrame, state: DataFrame) -> DataFrame:
    """The prepared notes with their decision."""
    return prepared.alias("new").join(state.alias("old"), F.col("new.path") == F.col("old.path"), "left").select("new.*", decision().alias("decision"))


def stats(decided: DataFrame, removed: int = 0) -> DataFrame:
    """One row: scanned, embedded, metadata_only, unchanged, removed."""
    n = lambda *names: F.coalesce(F.sum(F.col("decision").isin(*names).cast("long")), F.lit(0)).alias
    return decided.agg(
        F.count(F.lit(1)).alias("scanned"), n("missing", "content-changed", "config-changed")("embedded"),
        n("metadata-only")("metadata_only"), n("unchanged")("unchanged"), F.lit(removed).cast("long").alias("removed"),
    )


def update_metadata(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """Chunks with the metadata of ``notes`` where they have the path; texts, vectors and ids stay."""
    cols = [c for c in METADATA if c in notes.columns and c in chunks.columns]
    new = notes.select("path", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in cols])
    return chunks.join(new, "path", "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else c for c in chunks.columns])


def rename(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """Chunks with path, basename and folder changed by (old_path, new_path). Ids keep the old path."""
    from lodestone.functions.text import basename, folder

    to = F.coalesce("new_path", "path")
    moved = chunks.join(moves.select(F.col("old_path").alias("path"), "new_path"), "path", "left")
    new = {"path": to, "folder": F.when(F.col("new_path").isNotNull(), folder(to)).otherwise(F.col("folder")), "basename": F.when(F.col("new_path").isNotNull(), basename(to)).otherwise(F.col("basename"))}
    return moved.select(*[new[c].alias(c) if c in new else c for c in chunks.columns])


def delete(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths.select("path"), "path", "left_anti")


def replace(chunks: DataFrame, paths: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with those of ``paths`` replaced by ``new``; a path without new chunks goes."""
    return delete(chunks, paths).unionByName(new.select(*chunks.columns))


def missing_paths(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """Indexed paths that are no longer live."""
    return chunks.select("path").distinct().join(live.select("path"), "path", "left_anti")


def embedded(changed: DataFrame, size: int, overlap: int, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Chunk rows of prepared notes with vectors, and error: why the model gave none."""
    rows = embed(chunk(changed, size, overlap), embedder, error="error").withColumn("embedding_dim", F.size("vector"))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CHUNKS], "error")


def with_vectors(rows: DataFrame) -> DataFrame:
    """Chunks that got no vector are dropped."""
    return rows.where(F.size("vector") > 0).select(*CHUNKS.names)


def status(chunks: DataFrame) -> DataFrame:
    """One row: chunks and the distinct paths they come from."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("path").alias("paths"))
