"""Near-duplicates by five-word shingles: SimHash at a wide error budget, within blocks that no similar pair escapes.

At a similarity (Jaccard) of 0.8 the SimHashes of two texts differ in about ten of 64
bits, a budget at which a trie over a whole corpus prunes next to nothing. So the
corpus is first cut into blocks. A text is the set of its hashed shingles, and texts
of equal sets meet as one, so copies are never paired. In any one order of all
shingles, two sets of similarity LEAST or more share one among the first
n - ceil(LEAST n) + 1 of each; the sets that put a shingle forward are its block.
Within blocks, pairs whose SimHashes are further apart than BITS are pruned, in large
blocks by walking the trie of their fingerprints against itself, and what is left is
confirmed on all shingles.

The order is that of the hashes, but shingles that many sets put forward come last, so
common passages make no blocks: their places in a bitmap of a fixed size are sent to
all tasks, and as the bitmap decides for every text alike, a false mark costs nothing.
A large block is mostly a group of near copies: its sets are first compared with the
least of them alone. Blocks that this does not join whole are dealt to tasks by pairs
of buckets. A task that finds more than a few pairs to a set makes way for one that is
dealt all the sets' shingles and returns a spanning forest of the links it confirms, so
pairs never outgrow rows.

A text of up to SHINGLE words is one shingle; texts without words are equal. Links
are between sets, so ids play no part. Null is an empty text; very long texts cost
time in proportion and a fifth of their shingles; an empty table has no sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import forget, mapped, written
from lodestone.llm.components import components
from lodestone.llm.trie import close_pairs, merge

SHINGLE, SEED = 5, 42
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: The most bits in which similar sets differ, of 64 and of 128: five deviations beyond the ten and twenty expected
#: at LEAST. Sets of fewer shingles than SURE are not pruned by bits.
BITS, SURE = (24, 40), 16
#: Sets of a block that are all compared at once; of a larger block, the sets that a task compares with as many, and
#: if FEW pairs a set do not do, the shingles of such sets.
MOST_MET, BUCKET, FEW = 8, (1024, 1 << 18), 4
#: Pairs, or words of bits, that a step takes together.
CHECKED = 1 << 20
#: Prefixes' lengths over which frequent shingles are counted.
WIDE = 2
#: The bitmap of frequent shingles: its size, its parts, and how many shingles it marks at most.
HOT_BITS, HOT_PART, MOST_HOT = 1 << 26, 1 << 20, 1 << 22


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])) if len(words) > SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def set_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))


def set_ids(texts: list[str | None]) -> list[int]:
    return [set_id(shingles(t)) for t in texts]


def simhash(h: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints (as signed longs) of a set: of the hashes and of the hashes mixed."""
    ones = np.zeros(128, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        other = (part ^ part >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        ones += np.unpackbits(np.stack([part, other ^ other >> np.uint64(29)], 1).astype(">u8").view(np.uint8)).reshape(-1, 128).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(">i8").astype(np.int64)


def prefix(h: np.ndarray, hot: np.ndarray | None, times: int = 1) -> np.ndarray:
    n = len(h) - -(-LEAST[0] * len(h) // LEAST[1]) + 1
    if hot is not None and len(h):
        at = h & np.uint64(HOT_BITS - 1)
        late = (hot[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        h = np.concatenate([h[~late], h[late]])
    return h[: times * n].view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate([*rows, np.empty(0, np.int64)])))


def hot_shingles(docs: DataFrame) -> np.ndarray | None:
    """The bitmap of shingles that more than MOST_MET texts put forward; of the most frequent, if they are too many for it.

    Counted are as many shingles again as a text puts forward, as those that are moved to the end make room for them.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([prefix(shingles(x.as_py()), None, WIDE) for x in b.column("text")] or [np.empty(0, np.int64)]))], names=["h"])

    counts = docs.select("text").mapInArrow(heads, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_MET)
    often = written(counts.select("h", F.floor(F.log2("n")).cast("int").alias("level")), "often")
    levels, least, seen = dict(often.groupBy("level").count().collect()), None, 0  # at most 64
    for level in sorted(levels, reverse=True):
        seen += levels[level]
        if seen > MOST_HOT and least is not None:
            break
        least = level
    if least is None:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column("at").to_numpy()
            for p in np.unique(at // HOT_PART).tolist():
                parts.setdefault(p, np.zeros(HOT_PART, bool))[at[at // HOT_PART == p] % HOT_PART] = True
        rows = [(p, zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1)) for p, x in parts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "bits"])

    at = often.where(F.col("level") >= least).select(F.col("h").bitwiseAND(F.lit(HOT_BITS - 1)).alias("at")).distinct()
    out = np.zeros(HOT_BITS // 8, np.uint8)
    # At most HOT_BITS bits.
    for p, bits in at.repartition(HOT_BITS // HOT_PART, F.floor(F.col("at") / HOT_PART)).mapInArrow(pack, "part int, bits binary").collect():
        out[p * HOT_PART // 8 : (p + 1) * HOT_PART // 8] |= np.frombuffer(zlib.decompress(bits), np.uint8)
    forget(often)
    return out


def sets(docs: DataFrame) -> DataFrame:
    """sid, n (how many shingles), fp and fq (their SimHash), first (the prefix); a row for each distinct set."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [shingles(x.as_py()) for x in b.column("text")]
            prints = np.stack([simhash(h) for h in all_]) if all_ else np.empty((0, 2), np.int64)
            cols = [pa.array([set_id(h) for h in all_], pa.int64()), pa.array([len(h) for h in all_], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])]
            yield pa.RecordBatch.from_arrays([*cols, _lists([prefix(h, shared.value) for h in all_])], names=["sid", "n", "fp", "fq", "first"])

    rows = docs.select("text").mapInArrow(run, "sid long, n long, fp long, fq long, first array<long>")
    return written(rows.groupBy("sid").agg(*[F.any_value(c).alias(c) for c in ("n", "fp", "fq", "first")]), "sets")


def blocks(found: DataFrame) -> DataFrame:
    """h (the block), g (its sets), sid, pos (of h in the prefix), n, fp, fq; blocks of one set are left out."""
    posts = found.select("sid", F.posexplode("first").alias("pos", "h"))
    met = posts.groupBy("h").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    out = written(posts.join(met, "h").join(found.select("sid", "n", "fp", "fq"), "sid"), "blocks")
    forget(found)
    return out


def may_be_near(x: str, y: str) -> Column:
    """Whether sizes, places of the shared shingle and fingerprints of the sides x and y allow a similarity of LEAST."""
    c = lambda side, name: F.col(f"{side}.{name}")
    size = LEAST[1] * F.least(c(x, "n"), c(y, "n")) >= LEAST[0] * F.greatest(c(x, "n"), c(y, "n"))
    # The first shingle that two near sets share leaves each enough to share from there on.
    place = sum(LEAST) * F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= LEAST[0] * (c(x, "n") + c(y, "n"))
    one, two = (F.bit_count(c(x, k).bitwiseXOR(c(y, k))) for k in ("fp", "fq"))
    return size & place & ((F.least(c(x, "n"), c(y, "n")) < SURE) | ((one <= BITS[0]) & (one + two <= BITS[1])))


def first_pairs(met: DataFrame) -> DataFrame:
    """All pairs (a, b) of small blocks, and those of large blocks' least sets, that may be near."""
    pair = (F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))
    small, large = met.where(F.col("g") <= MOST_MET), met.where(F.col("g") > MOST_MET)
    all_ = small.alias("x").join(small.alias("y"), F.col("x.h") == F.col("y.h")).where(F.col("x.sid") < F.col("y.sid")).where(may_be_near("x", "y")).select(*pair)
    least = large.groupBy("h").agg(F.min(F.struct("sid", "n", "pos", "fp", "fq")).alias("l")).select("h", "l.*")
    star = large.alias("x").join(least.alias("y"), F.col("x.h") == F.col("y.h")).where(F.col("x.sid") != F.col("y.sid")).where(may_be_near("x", "y")).select(*pair)
    return written(all_.unionByName(star).distinct(), "pairs")


def _sides(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """A task's columns, and the rows of its two buckets (or twice those of one)."""
    v = {c: t.column(c).to_numpy() for c in ("sid", "pos", "n", "fp", "fq", "label", "u")}
    v |= {c: v[c].view(np.uint64) for c in ("fp", "fq")}
    return v, *(np.flatnonzero(v["u"] == t.column(c)[0].as_py()) for c in ("x", "y"))


def _met(v: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of pairs that may be near, of unlike labels: the tries of the sides' fingerprints walked together."""

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = v["n"][i], v["n"][j]
        keep = (v["label"][i] != v["label"][j]) & (LEAST[1] * np.minimum(n, m) >= LEAST[0] * np.maximum(n, m))
        keep &= sum(LEAST) * np.minimum(n - v["pos"][i], m - v["pos"][j]) >= LEAST[0] * (n + m)
        bits = np.bitwise_count(v["fp"][i] ^ v["fp"][j]).astype(int) + np.bitwise_count(v["fq"][i] ^ v["fq"][j])
        keep &= (bits <= BITS[1]) | (np.minimum(n, m) < SURE)
        return i[keep], j[keep]

    def members(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = side[np.argsort(v["fp"][side], kind="stable")]
        prints, start = np.unique(v["fp"][side], return_index=True)
        return side, prints, np.append(start, len(side))

    (a, fa, sa), (b, fb, sb) = members(left), members(right)
    same = len(left) == len(right) and bool((left == right).all())

    def prints() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if same:
            yield np.arange(len(fa)), np.arange(len(fa))
        yield from close_pairs(fa, fb, BITS[0], same)

    for i, j in prints():  # now of the sets that have them
        many = (sa[i + 1] - sa[i]) * (sb[j + 1] - sb[j])
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // CHECKED)) + 1
        for i_, j_, count in zip(np.split(i, cuts), np.split(j, cuts), np.split(many, cuts)):
            of = np.repeat(np.arange(len(i_)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = (sb[j_ + 1] - sb[j_])[of]
            yield fit(a[sa[i_][of] + k // wide], b[sb[j_][of] + k % wide])
    short = [s[v["n"][s] < 2 * SURE] for s in (left, right)]  # bits do not prune pairs with so few shingles
    for i in short[0]:
        yield fit(np.full(len(short[1]), i), short[1])


def _few(t: pa.Table) -> pa.Table:
    """Pairs (a, b) of a task that may be near; if they are more than FEW to a set, the block h alone, as crowded."""
    v, left, right = _sides(t)
    found, size = [np.empty((2, 0), np.int64)], 0
    for i, j in _met(v, left, right):
        pair = np.stack([np.minimum(v["sid"][i], v["sid"][j]), np.maximum(v["sid"][i], v["sid"][j])])
        found.append(np.unique(pair, axis=1))
        size += found[-1].shape[1]
        if size > FEW * len(t):
            return pa.table({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "h": t.column("h")[:1].combine_chunks()})
    out = np.concatenate(found, 1)
    return pa.table({"a": pa.array(out[0]), "b": pa.array(out[1]), "h": pa.nulls(out.shape[1], pa.int64())})


def _crowded(t: pa.Table) -> pa.Table:
    """Links of a task of a crowded block: a spanning forest of its pairs that are near."""
    v, left, right = _sides(t)
    # The shingles that two of these sets have, as bits.
    all_ = t.column("all").combine_chunks()
    flat, owner = all_.flatten().to_numpy(), np.repeat(np.arange(len(t)), all_.value_lengths().to_numpy())
    _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1
    shared = np.flatnonzero(many[at] > 1)
    held = np.zeros((len(t), int((many > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(held, (owner[shared], place[at[shared]] >> 6), np.uint64(1) << (place[at[shared]] & 63).astype(np.uint64))
    label = np.unique(v["label"], return_inverse=True)[1]
    root, made = np.arange(int(label.max()) + 1), [np.empty((2, 0), np.int64)]
    step = max(1, CHECKED // held.shape[1])
    for p, q in _met(v, left, right):
        for c in range(0, len(p), step):
            a, b = p[c : c + step], q[c : c + step]
            apart = root[label[a]] != root[label[b]]
            a, b = a[apart], b[apart]
            both = np.bitwise_count(held[a] & held[b]).sum(1, dtype=np.int64)
            near = sum(LEAST) * both >= LEAST[0] * (v["n"][a] + v["n"][b])
            a, b = a[near], b[near]
            _, first = np.unique(np.stack([root[label[a]], root[label[b]]]), axis=1, return_index=True)
            made.append(np.stack([v["sid"][a[first]], v["sid"][b[first]]]))
            root = merge(root, label[a[first]], label[b[first]])
    out = np.concatenate(made, 1)
    return pa.table({"a": pa.array(out.min(0)), "b": pa.array(out.max(0))})


def _dealt(rows: DataFrame, buckets: Column, *more: str) -> DataFrame:
    """Rows of blocks h, dealt to pairs (x, y) of ``buckets`` buckets by sid; u is a row's own."""
    own = rows.withColumn("s", F.ceil(buckets).cast("int")).withColumn("u", F.pmod(F.xxhash64("sid"), F.col("s")).cast("int"))
    both = own.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    return both.select("h", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "u", "sid", "pos", "n", "fp", "fq", "label", *more).groupBy("h", "x", "y")


def other_links(docs: DataFrame, met: DataFrame, joined: DataFrame) -> DataFrame | None:
    """Links within large blocks between sets that none joins yet; None if no such block is left."""
    large = met.where(F.col("g") > MOST_MET).join(joined, "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root")
    mixed = large.groupBy("h").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.sum("n").alias("size")).where("l <> m").select("h", "size")
    rows = written(large.join(mixed, "h"), "mixed")
    if rows.isEmpty():
        forget(rows)
        return None
    sets_ = whole(docs, rows.select("sid").distinct())
    found = written(_dealt(rows, F.col("g") / BUCKET[0]).applyInArrow(_few, "a long, b long, h long"), "few")
    pairs = written(found.where("h is null").select("a", "b").distinct(), "pairs")
    out, crowded = confirmed(pairs, sets_), found.where("h is not null").select("h").distinct()
    if not crowded.isEmpty():
        full = rows.join(crowded, "h").join(sets_, "sid")
        more = written(_dealt(full, F.col("size") / BUCKET[1], "all").applyInArrow(_crowded, "a long, b long").distinct(), "links")
        out = out.unionByName(more)
    forget(rows, found, pairs, sets_)
    return out


def whole(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """sid and all (the shingles) of the sets in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("sid"), _lists([shingles(x.as_py()).view(np.int64) for x in b.column("text")])], names=["sid", "all"])

    ids = written(ids, "ids")  # of a size that the planner knows, so that few of them do not move the texts
    one = with_sid(docs.select("text")).join(ids, "sid", "left_semi").groupBy("sid").agg(F.min("text").alias("text"))
    out = written(one.mapInArrow(run, "sid long, all array<long>"), "shingles")
    forget(ids)
    return out


def confirmed(pairs: DataFrame, sets_: DataFrame) -> DataFrame:
    """Of pairs (a, b) of sets, whose shingles ``sets_`` holds, those of similarity LEAST or more."""
    both = pairs.join(sets_.toDF("a", "x"), "a").join(sets_.toDF("b", "y"), "b")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return written(both.withColumn("same", same).where(LEAST[1] * F.col("same") >= LEAST[0] * (F.size("x") + F.size("y") - F.col("same"))).select("a", "b"), "links")


def with_sid(docs: DataFrame, out: str = "sid") -> DataFrame:
    """Adds the column ``out``: the number of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(set_ids(b.column("text").to_pylist()), pa.int64())], names=[*b.schema.names, out])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def roots(docs: DataFrame) -> DataFrame:
    """(sid, root): the least set reachable by links of similarity LEAST or more, for sets that have a link."""
    met = blocks(sets(docs))
    pairs = first_pairs(met)
    sets_ = whole(docs, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    links = confirmed(pairs, sets_)
    forget(pairs, sets_)
    joined = components(links).withColumnRenamed("node", "sid")
    more = other_links(docs, met, joined)
    forget(met)
    return joined if more is None else components(links.unionByName(more)).withColumnRenamed("node", "sid")
