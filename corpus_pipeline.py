"""From documents to token ids in five stages, each written as Parquet and reread by the next.

Stages return the columns of documents in their order, n_chars kept true to the
text; the last returns doc_id, lang, source, n_tokens, ids, intact and slot, the
row's place in the mixture, by which run() orders its rows. Null texts
pass as they are (and count as empty); an empty table passes through; other columns,
whatever their names, are carried along up to the last stage. Rows with a null
doc_id are documents of their own, which go by their texts. Rows that share an id are
one document to line dedup, which counts documents, and are judged by their own texts
elsewhere. Texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import bpe, line_dedup, mixing, quality, simhash
from lodestone.llm.common import columns, documents, file_number, fresh, labels, located, pattern, ready, tokenizer
from lodestone.sources.shared import discard, scratch

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents outside the held-out fold, does not reject."""
    model = quality.fitted(docs, labels(ready(spark), sf_dir))
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more of them hold, but for the last such document."""
    ready(spark)
    lines, dropped = fresh(docs, "lines", "dropped")
    out = line_dedup.dedup(docs, counts=(lines, dropped))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(lines, dropped)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word Jaccard of 0.8 or more.

    It is the row of the least doc_id, of these the first by text; rows without an id come last.
    """
    ready(spark)
    group, n = fresh(docs, "group", "n")
    rows = simhash.similar(docs, group)
    one = Window.partitionBy(group).orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return rows.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the files in order of their names hold it."""
    ready(spark)
    return mixing.in_order(docs, mixing.PRODUCTION_WEIGHTS)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text and slot: the row's place, from 0, in the files in order of their names.

    Partitions follow each other in that order. A frame that is no table of files is written as one first.
    """
    rows = located(docs.select("doc_id", "lang", "source", "text"), "file_name", "row_index")
    # One row a file.
    ends = rows.groupBy("file_name").agg((F.max("row_index") + 1).alias("n"))
    earlier = Window.orderBy(file_number(F.col("file_name"))).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file_name", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    total = ends.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    rows = rows.join(F.broadcast(starts), "file_name").withColumn("slot", F.col("start") + F.col("row_index"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("doc_id", "lang", "source", "text", "slot").repartitionById(parts, F.floor(F.col("slot") * parts / total).cast("int")).sortWithinPartitions("slot")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids; intact: whether decoding them gives its text again; slot: its place in the mixture.

    Like those of the mixing stage, the files in order of their names hold the mixture.
    """
    ready(spark)
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    rows = placed(docs).select("doc_id", "lang", "source", "slot", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "text")
    out = bpe.round_trip(rows, path, pattern())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("intact"), "slot")


STAGES = [
    ("quality", quality_classifier),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the trained classifier nor the merges of BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; the folders of those before it are deleted once they have been read."""
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES:
        last, path = path, scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            discard(spark, last)
    # Files are read by size, not by name.
    return docs.orderBy("slot")
