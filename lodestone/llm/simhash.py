"""SimHash near-duplicates by a binary trie self-join.

Distinct fingerprints are the leaves of a binary trie. The join walks pairs of trie
nodes together, starting with the root and itself: a pair whose bits differ spends
one of the allowed differences, and a pair that has spent more is pruned. The top of
the trie, cut where a subtree holds few enough fingerprints, is a table of nodes, and
the pairs of nodes that the budget lets meet are a table too; each such pair is a
task, which walks on in numpy and returns a spanning forest of its links, never the
pairs. Forests are joined into components by star contraction. The driver holds no
nodes, pairs or links.

Documents with equal fingerprints meet as one; no group of copies is expanded. A
text without words, null or empty, has fingerprint 0; very long texts are read whole,
in time in proportion. Links are between fingerprints, so documents with null or
repeated ids link by their texts alone. A component is named by its least doc_id;
null if all its ids are null. Repeated rows give repeated results; other columns are
left out; an empty table has no rows.

``similar`` is the operator at a similarity of 0.8 of five-word shingles (near.py):
there the trie is walked at a wide budget, within blocks, and links are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import near
from lodestone.llm.common import fresh, written
from lodestone.llm.components import components
from lodestone.llm.trie import close_pairs, merge

SHINGLE, SEED, BITS = 3, 42, 2
#: Fingerprints in a subtree that one task takes whole.
LEAST_LEAF, MOST_LEAF = 2048, 65536
#: Files of a table of nodes: a few million rows at most.
FILES = 8


def fingerprint_bytes(text: str | None, size: int = SHINGLE) -> bytes:
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) > size else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b"".join(fingerprint_bytes(x.as_py()) for x in b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.frombuffer(fp, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _task(table: pa.Table, bits: int) -> pa.Table:
    side, fp, rep = (table.column(c).to_numpy() for c in ("side", "fp", "rep"))
    fp = fp.view(np.uint64)
    order = np.argsort(fp, kind="stable")
    side, fp, rep = side[order], fp[order], rep[order]
    same = not side.any()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    label = np.arange(len(fp))
    for i, j in close_pairs(fp[left], fp[right], bits, same):
        label = merge(label, left[i], right[j])
    joined = np.flatnonzero(label != np.arange(len(fp)))
    return pa.table({"a": pa.array(rep[joined]), "b": pa.array(rep[label[joined]])})


def masks(depth: int, bits: int) -> list[int]:
    """All numbers of ``depth`` binary digits with at most ``bits`` ones, as signed longs."""
    out = [sum(1 << i for i in at) for k in range(bits + 1) for at in combinations(range(depth), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def leaves(distinct: DataFrame, n: int) -> DataFrame:
    """(depth, prefix): the subtrees, cut where one holds few enough fingerprints, that the leaves fall into.

    A node is the first ``depth`` bits. Fingerprints are counted a few bits deep, and the
    counts added up towards the root: a leaf is the highest node that is small enough.
    Nodes that are too large even at that depth are counted again six bits deeper, and so on.
    """
    most = min(max(n // 64, LEAST_LEAF), MOST_LEAF)
    above, depth = 0, min(max((n // most).bit_length() + 3, 4), 16)
    rows, found = distinct.select("fp"), None
    while True:
        counts = rows.groupBy(_prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        up = F.explode(F.sequence(F.lit(above), F.lit(depth)))
        nodes = counts.select(up.alias("depth"), "prefix", "n").select("depth", F.expr(f"shiftrightunsigned(prefix, {depth} - depth)").alias("prefix"), "n")
        nodes = written(nodes.groupBy("depth", "prefix").agg(F.sum("n").alias("n")), "nodes", FILES)
        # The parents of the highest nodes are too large, or there is none.
        parents = nodes.where(F.col("n") > most).select((F.col("depth") + 1).alias("depth"), "prefix")
        small = nodes.where((F.col("n") <= most) | F.lit(depth == 64) & (F.col("depth") == 64)).withColumn("parent", F.shiftrightunsigned("prefix", 1))
        below = small.alias("x").join(parents.alias("y"), (F.col("x.depth") == F.col("y.depth")) & (F.col("x.parent") == F.col("y.prefix")), "left_semi")
        here = below.unionByName(small.where(F.col("depth") == above)).select("depth", "prefix")
        found = here if found is None else found.unionByName(here)
        heavy = nodes.where((F.col("depth") == depth) & (F.col("n") > most)).select("prefix") if depth < 64 else nodes.limit(0).select("prefix")
        if heavy.isEmpty():
            return written(found, "leaves", FILES)
        rows = rows.join(heavy, _prefix(depth) == F.col("prefix"), "left_semi")
        above, depth = depth + 1, min(depth + 6, 64)


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(cut: DataFrame, bits: int) -> DataFrame:
    """(a_depth, a, b_depth, b): pairs of leaves, each once, whose common bits differ in at most ``bits``.

    What is left of walking both sides of the trie together to the leaves: a node
    meets the nodes that the error budget can reach from it, and no others are formed.
    """
    depths = sorted(r[0] for r in cut.select("depth").distinct().collect())  # some of 0 to 64
    # At most 2081 flips a depth (two of 64 bits).
    flips = cut.sparkSession.createDataFrame([(x, m) for x in depths for m in masks(x, bits)], "depth int, flip long")
    reach = cut.join(F.broadcast(flips), "depth").select(F.col("depth").alias("a_depth"), F.col("prefix").alias("a"), F.col("prefix").bitwiseXOR(F.col("flip")).alias("key"))
    higher = F.filter(F.array(*[F.lit(x) for x in depths]), lambda x: x <= F.col("b_depth"))
    deep = cut.select(F.col("depth").alias("b_depth"), F.col("prefix").alias("b")).withColumn("a_depth", F.explode(higher))
    deep = deep.withColumn("key", F.expr("CASE WHEN a_depth = 0 THEN 0L ELSE shiftrightunsigned(b, b_depth - a_depth) END"))
    return reach.join(deep, ["a_depth", "key"]).where((F.col("a_depth") < F.col("b_depth")) | (F.col("a") <= F.col("b"))).select("a_depth", "a", "b_depth", "b")


def trie_links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, rep), each fp once -> (a, b): links between reps that join every pair within ``bits`` bits, transitively."""
    cut = leaves(distinct, distinct.count())
    depths = sorted(r[0] for r in cut.select("depth").distinct().collect())
    if not depths:
        return distinct.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    pairs = written(node_pairs(cut, bits), "pairs", FILES)
    # Each fingerprint falls into the one leaf that is among its prefixes.
    own = F.explode(F.array(*[F.struct(F.lit(x).alias("depth"), _prefix(x).alias("prefix")) for x in depths]))
    placed = distinct.select("fp", "rep", own.alias("leaf")).select("fp", "rep", "leaf.*").join(cut, ["depth", "prefix"])
    as_a = placed.withColumnsRenamed({"depth": "a_depth", "prefix": "a"}).join(pairs, ["a_depth", "a"]).withColumn("side", F.lit(0))
    other = pairs.where((F.col("a_depth") != F.col("b_depth")) | (F.col("a") != F.col("b")))
    as_b = placed.withColumnsRenamed({"depth": "b_depth", "prefix": "b"}).join(other, ["b_depth", "b"]).withColumn("side", F.lit(1))
    dealt = as_a.unionByName(as_b).select("a_depth", "a", "b_depth", "b", "side", "fp", "rep")
    return dealt.groupBy("a_depth", "a", "b_depth", "b").applyInArrow(lambda t: _task(t, bits), "a long, b long")


def clusters(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable by links of at most ``bits`` bits."""
    fps = written(fingerprints(docs), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = trie_links(distinct.select("fp", F.col("fp").alias("rep")), bits)
    rooted = distinct.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, out: str = "component") -> DataFrame:
    """Adds the column ``out``: equal for documents that links of five-word Jaccard 0.8 or more join."""
    (root,) = fresh(docs, "root")
    found = near.roots(docs.select("text")).toDF(out, root)
    return near.with_sid(docs, out).join(found, out, "left").withColumn(out, F.coalesce(root, out)).drop(root)


def report(docs: DataFrame) -> DataFrame:
    return clusters(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
