"""Line dedup with two Bloom filters.

Two filters are built over the hashes of line keys: bits set once, and bits set at
least twice. Each partition gathers its own, and partials add up bit by bit (once
and once is twice), so every key that two documents hold has all its bits in the
second filter. Only keys found there, the suspected repeats, are shuffled; their
documents are then counted exactly and the one that keeps its lines is chosen.

The filters have about one bit to eight bytes of input, MOST_BITS at most; past
that, more lines are suspected without need and shuffle, and results stay the same.
Null or empty text is one empty line; very long texts are read whole, line by line;
repeated rows of a doc_id count as one document; a row with a null doc_id is a
document of its own, known by its text and below all others; other columns, whatever
their names, are carried along; an empty table stays empty.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import NULL_ID_FIRST, columns, fresh, mapped, table_bytes, written

LEAST_CHARS, LEAST_DOCS = 20, 3
SPACE = b" \t\n\x0b\x0c\r"
PART = 1 << 20
LEAST_BITS, MOST_BITS, DEFAULT_BITS = 1 << 20, 1 << 30, 1 << 24
FLUSH = 1 << 21


def key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def long_enough(k: bytes, least: int = LEAST_CHARS) -> bool:
    n = len(k)
    return n >= least and (n >= 4 * least or k.isascii() or len(k.decode("utf-8", "replace")) >= least)


def text_keys(text: str | None, least: int) -> list[bytes]:
    """The text's lines' keys; b"" for those too short to count."""
    return [k if long_enough(k := key(x), least) else b"" for x in (text or "").encode().split(b"\n")]


def _hash(k: bytes) -> bytes:
    return xxhash.xxh3_128_digest(k)


def _places(hashes: list[bytes], bits: int) -> np.ndarray:
    """The two bits of each key."""
    h = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return (h & np.uint64(bits - 1)).astype(np.int64)


def bits_for(docs: DataFrame) -> int:
    n = table_bytes(docs, DEFAULT_BITS * 8) // 8
    return min(max(1 << max(n - 1, 1).bit_length(), LEAST_BITS), MOST_BITS)


def seen_twice(docs: DataFrame, bits: int, least: int) -> list[tuple[int, bytes]]:
    """The second filter, in parts of PART bits (packed, compressed): at most bits / 8 bytes in all."""

    def emit(places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not places:
            return
        at, n = np.unique(np.concatenate(places), return_counts=True)
        cuts = np.flatnonzero(np.diff(at // PART)) + 1
        rows = [(int(p[0]) // PART, p % PART, c > 1) for p, c in zip(np.split(at, cuts), np.split(n, cuts))]
        pack = lambda p: zlib.compress(np.diff(p, prepend=0).astype("<u4").tobytes(), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([pack(r[1]) for r in rows], pa.binary()), pa.array([pack(r[1][r[2]]) for r in rows], pa.binary())],
            names=["part", "once", "twice"],
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            hashes = [_hash(k) for x in b.column("text") for k in {*text_keys(x.as_py(), least)} if k]
            if hashes:
                held.append(_places(hashes, bits).reshape(-1))
                size += len(held[-1])
            if size >= FLUSH:
                yield from emit(held)
                held, size = [], 0
        yield from emit(held)

    unpack = lambda x: np.cumsum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], names=["part", "bits"])

        for b in batches:
            for p, o, t in zip(b.column("part").to_pylist(), b.column("once").to_pylist(), b.column("twice").to_pylist()):
                if p != part:
                    if part is not None:
                        yield done()
                    part, once, twice = p, np.zeros(PART, bool), np.zeros(PART, bool)
                o, t = unpack(o), unpack(t)
                twice[o] |= once[o]
                twice[t] = True
                once[o] = True
        if part is not None:
            yield done()

    partial = docs.select("text").mapInArrow(gather, "part int, once binary, twice binary")
    n = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, bits // PART))
    added = partial.repartition(n, "part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary")
    return [(r[0], bytes(r[1])) for r in added.collect()]


class Twice:
    """The second filter as a worker holds it."""

    held: dict = {}

    @classmethod
    def of(cls, name: str, parts: Broadcast, bits: int) -> np.ndarray:
        if name not in cls.held:
            packed = np.zeros(bits // 8, np.uint8)
            for p, x in parts.value:
                packed[p * PART // 8 : (p + 1) * PART // 8] = np.frombuffer(zlib.decompress(x), np.uint8)
            cls.held = {name: packed}
        return cls.held[name]


def _in(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def known_by(doc_id: str = "doc_id") -> Column:
    """A document's number: its doc_id; without one, a number by its text in the lowest quarter of longs, where no ids are expected."""
    own = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(NULL_ID_FIRST)
    return F.coalesce(F.col(doc_id).cast("long"), own)


def repeats(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, doc_id: str = "doc_id") -> DataFrame:
    """id, keys array<binary>: the 128-bit hashes of the keys whose lines each document loses.

    Suspects are counted per (key, id) and then per key, both with partial sums, so
    a line that a third of all documents hold is a few rows by the time it meets.
    """
    bits = bits_for(docs)
    name, found = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(seen_twice(docs, bits, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Twice.of(name, found, bits)
        for b in batches:
            ids, keys = [], []
            for i, x in zip(b.column("id").to_pylist(), b.column("text")):
                hashes = [_hash(k) for k in {*text_keys(x.as_py(), least)} if k]
                if hashes:
                    keep = _in(packed, _places(hashes, bits))
                    keys += [h for h, k in zip(hashes, keep.tolist()) if k]
                    ids += [i] * int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])

    rows = docs.select(known_by(doc_id).alias("id"), "text")
    # Written, as it is read twice: the texts are not.
    held = written(rows.mapInArrow(suspects, "id long, key binary").groupBy("key", "id").agg(F.count(F.lit(1)).alias("n")).select("key", "id"), "suspects")
    often = held.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= least_docs)
    lost = held.join(often, "key").where(F.col("id") != F.col("keeper"))
    return lost.groupBy("id").agg(F.collect_list("key").alias("keys"))


def dedup(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with ``text`` less its repeated lines, and n_lines and n_dropped (``counts``) added or replaced.

    Null text stays null if it keeps its one empty line, which it always does.
    """
    docs = docs.drop(*counts)
    names = fresh(docs, "id", "keys")
    lost = repeats(docs, least, least_docs).withColumnsRenamed({"id": names[0], "keys": names[1]})
    rows = docs.withColumn(names[0], known_by()).join(lost, names[0], "left").drop(names[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(b.column("text").to_pylist(), b.column(names[1]).to_pylist()):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if keys:
                    gone = set(keys)
                    lines = [x for x, k in zip(lines, text_keys(text, least)) if not (k and _hash(k) in gone)]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append("\n".join(lines) if n_dropped[-1] else text)
            cols = {c: b.column(c) for c in b.schema.names if c != names[1]}
            cols |= {"text": pa.array(texts, b.column("text").type), counts[0]: pa.array(n_lines, pa.int64()), counts[1]: pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    return mapped(rows.select(*columns(docs), names[1]), run, schema)


def report(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    strip = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH lines AS (
        SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i)
    ), keyed AS (SELECT *, {lower.format(strip)} AS k FROM lines),
    often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
    marked AS (SELECT keyed.*, often.k IS NOT NULL AND keyed.doc_id <> often.keeper AS gone FROM keyed LEFT JOIN often USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""
