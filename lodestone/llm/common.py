"""Helpers that several operators share."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.shared import discard, scratch

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ARROW_ROWS = "1000"
NULL_ID_LAST = (1 << 63) - 1
NULL_ID_FIRST = -(1 << 63)


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when they start on a shared file system.

    Elsewhere, ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    # Small batches, for tables with very long texts.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here. ``files`` gathers a small one in so many."""
    path = scratch(df.sparkSession, name)
    (df.repartition(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no table still to be made reads."""
    for t in tables:
        discard(t.sparkSession, t._written)


def located(df: DataFrame, file: str, row: str) -> DataFrame:
    """Adds the name of each row's file and its number in it; a frame that is no table of files is written as one first."""

    def place(d: DataFrame) -> DataFrame:
        return d.select(*columns(d), d.metadataColumn("_metadata")["file_name"].alias(file), d.metadataColumn("_metadata")["row_index"].alias(row))

    try:
        return place(df)
    except AnalysisException:
        return place(written(df, "placed"))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that begin with the stems and are not in the frame (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """The frame's columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow that also takes columns whose names hold dots or backquotes."""
    odd = [c for c in df.columns if "." in c or "`" in c]
    safe = dict(zip(odd, fresh(df, *["odd"] * len(odd))))
    plain = T.StructType([T.StructField(safe.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
    return df.toDF(*[safe.get(c, c) for c in df.columns]).mapInArrow(run, plain).toDF(*schema.names) if odd else df.mapInArrow(run, schema)


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, within one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread_key(doc_id: str | Column = "doc_id") -> Column:
    """32 hex digits of an id: a fixed pseudo-random order that SQL engines share."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.coalesce(col.cast("string"), F.lit("")))


#: Rows that one task numbers, about.
NUMBERED = 1 << 17


def digits_for(n: int, most: int = NUMBERED) -> int:
    """How many hex digits cut ``n`` rows into parts of at most ``most``, about."""
    d = 1
    while n > most * 16**d:
        d += 1
    return d


def numbered(df: DataFrame, group: str, key: str, ties: list[Column], out: str, digits: int) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each group in the order of the hex string ``key``.

    No group meets in one task: rows are numbered within (group, first digits of
    the key), 16**digits parts each, and the parts' sizes, at most that many rows
    a group, are summed to give each part its start. ``group`` must not be null.
    """
    part, before, size = fresh(df, "part", "before", "size")
    parts = df.withColumn(part, F.substring(key, 1, digits))
    sizes = parts.groupBy(group, part).agg(F.count(F.lit(1)).alias(size))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy(group, part).orderBy(F.col(key), *ties)
    return (
        parts.join(starts, [group, part])
        .withColumn(out, (F.row_number().over(within) - 1 + F.col(before)).cast("long"))
        .drop(part, before)
    )


def table_of(spark: SparkSession, rows: list[list], schema: str) -> DataFrame:
    """A small table from Python values, as one literal of the plan."""
    names = [f.name for f in T._parse_datatype_string(schema)]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def file_number(name: Column) -> Column:
    """The number in the name of a file that Spark wrote: files in this order are the partitions in theirs."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("int")


def table_bytes(df: DataFrame, unknown: int) -> int:
    """The planner's estimate of a frame's bytes; ``unknown`` where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 56 else unknown
