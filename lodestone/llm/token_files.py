"""Token ids in ORC files: stripes, integer run-length encoding, row indexes and Bloom filters on doc_id.

Documents are range-partitioned by doc_id, sorted and tokenized in that order, and
each partition becomes one file of columns doc_id, row (the place in the file) and
ids; files in the order of their numbers hold the ids in theirs. ORC encodes ids by its integer run-length encoding
and keeps, per stripe and per row group, minimum, maximum and a Bloom filter of doc_id,
so readers take stripes in parallel and skip those that cannot hold an id.

Null text is empty, so its document holds the end id alone; very long texts are
tokenized whole; repeated rows each have their place; ties in doc_id go by a hash of
the text, and by it a single id or null that many rows share is spread over files;
null doc_ids come first; other columns are left out; an empty table writes files
without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import file_number, scratch, written
from lodestone.llm.pieces import Store, gather, with_ids

END_ID = 2
CHUNK = 1 << 15
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), True))])


@lru_cache(maxsize=2)
def _store(path: str) -> Store:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    # Characters of the byte-level alphabet stand for one byte each.
    length = np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())], np.int64)
    length[[i for i, _ in t.get_added_tokens_decoder().items()]] = 1 << 40

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a space are tokenized in runs, cut again by bytes; others alone."""
        bytes_of = pc.binary_length(pa.array(strings, pa.string())).to_numpy().astype(np.int64)
        alone = [i for i, s in enumerate(strings) if s[:1] != " " or s == " "]
        rest = np.delete(np.arange(len(strings)), alone)
        runs = np.split(rest, np.flatnonzero(np.diff(np.cumsum(bytes_of[rest]) // CHUNK)) + 1) if len(rest) else []
        texts = [strings[i] for i in alone] + ["".join([strings[i] for i in own.tolist()]) for own in runs]
        coded = [np.array(e.ids, np.int32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        counts = [np.array([len(x) for x in coded[: len(alone)]], np.int64)]
        for own, ids in zip(runs, coded[len(alone) :]):
            at = np.searchsorted(np.cumsum(length[ids]), np.cumsum(bytes_of[own])) + 1
            if at[-1] != len(ids):
                raise ValueError("the tokenizer does not keep every byte")
            counts.append(np.diff(at, prepend=0))
        made, sizes = np.concatenate([*coded, np.empty(0, np.int32)]), np.concatenate(counts)
        place = np.empty(len(strings), np.int64)
        place[np.concatenate([np.array(alone, np.int64), rest])] = np.arange(len(strings))
        ends = np.cumsum(sizes)[place] if len(strings) else np.empty(0, np.int64)
        sizes = sizes[place]
        return gather(made, ends - sizes, ends), sizes

    # A text that cannot be cut at spaces is tokenized whole.
    return Store(encode, lambda s: [s])


def encode(df: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, text -> doc_id, row (its number in the partition) and ids by the tokenizers file at ``path``, then the end id. Row order is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in with_ids(batches, "text", "ids", _store(path)):
            row = pa.array(np.arange(done, done + b.num_rows))
            done += b.num_rows
            ids = b.column("ids")
            if end_id is not None:
                offsets = ids.offsets.to_numpy().astype(np.int64)
                offsets -= offsets[0]
                flat = np.insert(ids.flatten().to_numpy(), offsets[1:], end_id)
                ids = pa.ListArray.from_arrays(pa.array((offsets + np.arange(len(offsets))).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), row, ids], names=SCHEMA.names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = END_ID, parts: int | None = None) -> str:
    """Writes the documents' ids as ORC files in ascending doc_id order at ``out``."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    (
        encode(ordered, tokenizer, end_id).write.option("compression", "zstd").option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(out)
    )
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents with these ids; stripes and row groups that cannot hold them are skipped."""
    return read(spark, path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The CRC-32 of each row's ids as little-endian 32-bit integers."""
    for b in batches:
        ids = b.column("ids")
        raw = memoryview(np.ascontiguousarray(ids.flatten().to_numpy().astype("<u4", copy=False))).cast("B")
        at = ids.offsets.to_numpy().astype(np.int64) * 4
        at -= at[0]
        sums = [zlib.crc32(raw[at[i] : at[i + 1]]) for i in range(len(ids))]
        n = pa.array(np.diff(at) // 4, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "file", "row")), n, pa.array(sums, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files.

    A document's start is the ids of earlier files (a row a file) plus those before it in its own.
    """
    rows = read(spark, path).select("doc_id", "row", "ids", F.col("_metadata.file_name").alias("file"))
    # Written, so that the ids are read once: a few numbers a document.
    rows = written(rows.mapInArrow(_sums, "doc_id long, file string, row long, n_tokens long, ids_crc32 long"), "sums")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy(file_number(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select(
        "doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    return offsets(spark, write(docs, tokenizer, scratch(spark, "tokens")))
