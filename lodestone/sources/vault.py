"""Notes from a folder of markdown files, or from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.values import frontmatter


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), mtime (ms), size and content of every .md file under ``root``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    # File URIs are percent-encoded; a plus sign in them is a plus sign.
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    return files.select(
        F.substring_index(uri, base, -1).alias("path"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"),
    )


def only_markdown(notes: DataFrame) -> DataFrame:
    return notes.where(F.endswith("path", F.lit(".md")))


def prepare(notes: DataFrame, size: int, overlap: int, model: str, now: str) -> DataFrame:
    """A row for each note: body, hashes and metadata, absent values as "" or []."""
    rows = notes.withColumns({"content": F.coalesce("content", F.lit("")), "body": X.body(F.coalesce("content", F.lit(""))), "raw": X.raw_frontmatter(F.coalesce("content", F.lit("")))})
    rows = rows.withColumn("fm", frontmatter("raw"))
    inline = X.inline_tags(F.col("body"))
    rows = rows.withColumns({"inline_tags": inline, "frontmatter_tags": X.unique(F.col("fm.frontmatter_tags")), "aliases": X.unique(F.col("fm.aliases")), "frontmatter_keys": X.unique(F.col("fm.frontmatter_keys"))})
    rows = rows.withColumn("tags", X.unique(F.array_union("frontmatter_tags", "inline_tags")))
    return rows.select(
        "path", X.folder(F.col("path")).alias("folder"), X.basename(F.col("path")).alias("basename"), "mtime", "size", "body",
        "fm.title", "fm.status", "fm.project", "fm.type",
        X.sha(F.col("content")).alias("content_hash"), X.sha(F.col("body")).alias("body_hash"),
        X.sha(F.coalesce(F.nullif("raw", F.lit("")), "fm.stable_json")).alias("frontmatter_hash"),
        F.lit(X.config_hash(size, overlap)).alias("chunking_config_hash"), F.lit(model).alias("embedding_model"), F.lit(now).alias("indexed_at"),
        "tags", "inline_tags", "frontmatter_tags", "aliases", "frontmatter_keys",
        X.list_text(F.col("tags")).alias("tags_text"), X.list_text(F.col("aliases")).alias("aliases_text"), X.list_text(F.col("frontmatter_keys")).alias("frontmatter_keys_text"),
        F.col("fm.frontmatter_json").alias("frontmatter_json"),
    )
