"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of the corpus are laid end to end as byte symbols, in
a linked list. An inverted index holds, for each mergeable pair (by the rank of the
joined token), the positions where it stands. Ranks are taken in order; each merge
is applied to all its positions at once, and only the pairs with the touched
neighbours are looked up and indexed anew. Documents are then read off by word.

Blocks are runs of Arrow batches within a partition, so nothing shuffles, a lost
task is recomputed from its input, and memory is bounded by the block and by
MOST_KEPT strings. Null and empty texts have no ids; an empty id list decodes to no
bytes; an id outside the vocabulary raises ValueError. Very long texts are coded whole;
repeated rows have equal ids; other columns, whatever their names, are carried along,
but columns of the results' names are replaced; an empty table stays empty.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import mapped
from lodestone.llm.pieces import Store, gather, with_ids

SHIFT = 20
#: Strings whose ids a worker keeps, and ids decoded at a time.
MOST_KEPT = 150_000
STEP = 1 << 18


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each rank of a rank file."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Vocabulary:
    """Ranks of a rank file, and of every pair of tokens whose join has a rank."""

    def __init__(self, path: str):
        self.tokens = token_bytes(path)
        self.size = len(self.tokens)
        self.ranks = {token: rank for rank, token in enumerate(self.tokens) if token}
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        get = self.ranks.get
        pairs = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs))
        self.by_left = self._rows(left, right, rank)
        self.by_right = self._rows(right, left, rank)
        self.first = np.full((256, 256), -1, np.int32)
        of_byte = np.full(self.size, -1, np.int64)
        of_byte[self.byte] = np.arange(256)
        both = (of_byte[left] >= 0) & (of_byte[right] >= 0)
        self.first[of_byte[left[both]], of_byte[right[both]]] = rank[both]

    def _rows(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(a << SHIFT | b)
        return np.searchsorted(a[order], np.arange(self.size + 1)), b[order].astype(np.int32), rank[order].astype(np.int32)

    def paired(self, rows: tuple, one: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the joins of a token with others on its right (by_left) or left (by_right); -1: none."""
        starts, other, rank = rows
        lo, hi = starts[one], starts[one + 1]
        if lo == hi:
            return np.full(len(others), -1, np.int32)
        at = np.minimum(np.searchsorted(other[lo:hi], others), hi - lo - 1) + lo
        return np.where(other[at] == others, rank[at], np.int32(-1))

    def word(self, word: bytes) -> list[int]:
        """One word, a merge at a time: lowest rank first, leftmost of equals."""
        n, known = len(word), self.ranks.get
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, x, y) for i, (x, y) in enumerate(zip(parts, parts[1:])) if (r := known(x + y)) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, x, y = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:  # merged since
                continue
            parts[i], parts[j], after[i] = x + y, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := known(parts[left] + parts[after[left]])) is not None:
                    heapq.heappush(waiting, (r, left, parts[left], parts[after[left]]))
        return [self.ranks[p] for p in parts if p is not None]


def _alternate(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences in a row, the first, third, fifth, ..."""
    joined = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
    if not joined.any():
        return pos
    n = np.arange(len(pos))
    return pos[(n - np.maximum.accumulate(np.where(joined, 0, n))) % 2 == 0]


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words end to end, and how many each has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.int32), sizes
    ends = np.cumsum(sizes)
    full = sizes > 0
    sym = np.append(v.byte[raw], -1).astype(np.int32)
    nxt = np.arange(1, n + 2, dtype=np.int32)
    nxt[ends[full] - 1] = n
    prv = np.arange(-1, n, dtype=np.int32)
    prv[(ends - sizes)[full]] = n
    pair = np.full(n + 1, -1, np.int32)
    pair[: n - 1] = v.first[raw[:-1], raw[1:]]
    pair[ends[full] - 1] = -1
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(pos: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, p in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts) if len(cuts) else [pos]):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(waiting, r)

    start = np.flatnonzero(pair >= 0).astype(np.int32)
    if len(start):
        enter(start, pair[start])
    again: list[np.ndarray] = []
    while waiting:
        r = heapq.heappop(waiting)
        held = index.pop(r)
        pos = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
        pos = pos[pair[pos] == r]
        if not len(pos):
            continue
        pos = _alternate(pos, nxt)
        gone = nxt[pos]
        after = nxt[gone]
        sym[pos] = r
        sym[gone] = -2
        pair[gone] = -1
        nxt[pos] = after
        prv[after] = pos
        before = prv[pos]
        right = v.paired(v.by_left, r, sym[after])
        left = v.paired(v.by_right, r, sym[before])
        pair[pos] = right
        pair[before] = left
        pair[n] = -1
        sym[n] = -1
        touched = np.concatenate([pos[right >= 0], before[left >= 0]])
        if len(touched):
            touched = np.unique(touched)
            ranks = pair[touched]
            known = ranks >= 0
            touched, ranks = touched[known], ranks[known]
            if len(touched):
                if ranks.min() < r:  # a lower rank came up late: such words go one merge at a time
                    again.append(touched[ranks < r])
                enter(touched, ranks)
    alive = sym[:n] >= 0
    ids = sym[:n][alive]
    counts = np.add.reduceat(np.append(alive, False).astype(np.int64), np.minimum(ends - sizes, n))
    counts[~full] = 0
    if again:
        bad = np.unique(np.searchsorted(ends, np.concatenate(again), side="right"))
        cut = np.split(ids, np.cumsum(counts)[:-1])
        for i in bad.tolist():
            cut[i] = np.array(v.word(words[i]), np.int32)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        ids = np.concatenate(cut)
    return ids, counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _store(path: str, pattern: str) -> Store:
    v, words = vocabulary(path), regex.compile(pattern)

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [words.findall(s) for s in strings]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in cut for w in ws))}
        ids, counts = replay([w.encode() for w in known], v)
        ends = np.concatenate([[0], np.cumsum(counts)])
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter((known[w] for ws in cut for w in ws), np.int64, int(many.sum()))
        each = np.concatenate([[0], np.cumsum(counts[at])])
        stops = np.concatenate([[0], np.cumsum(many)])
        return gather(ids, ends[at], ends[at + 1]), np.diff(each[stops])

    return Store(encode, words.findall, MOST_KEPT)


def _schema(df: DataFrame, text: str, out: str) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != text] + [T.StructField(out, T.ArrayType(T.IntegerType(), False))])


def _clear(df: DataFrame, text: str, *out: str) -> DataFrame:
    """The frame without columns of the names to come; the text itself stays."""
    return df.drop(*[c for c in df.columns if c != text and c.lower() in {o.lower() for o in out}])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Replaces the column ``text``, and one named ``out``, by ``out`` array<int>: the ids by the rank file at ``path``."""
    df = _clear(df, text, out)
    return mapped(df, lambda it: with_ids(it, text, out, _store(path, pattern)), _schema(df, text, out))


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    token = token_bytes(path)
    for b in batches:
        col = b.column(ids)
        flat, null = col.flatten().to_numpy(zero_copy_only=False), col.is_null().to_pylist()
        ends = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        if len(flat) and not (0 <= flat.min() and flat.max() < len(token)):
            raise ValueError("an id outside the vocabulary")
        made: list[bytes | None] = []
        while len(made) < b.num_rows:  # whole rows, about STEP ids of them
            first = len(made)
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP, side="right")) - 1)
            words = list(map(token.__getitem__, flat[ends[first] : ends[last]].tolist()))
            cuts = (ends[first : last + 1] - ends[first]).tolist()
            made += [None if null[first + i] else b"".join(words[x:y]) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, out])


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` binary (or replaces it): the bytes that the ids stand for (null ids: null)."""
    df = _clear(df, ids, out)
    return mapped(df, lambda it: _decoded(it, path, ids, out), T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """decode(encode(df)): ids and decoded, in one pass of one worker."""
    df = _clear(df, text, "ids", "decoded")
    schema = T.StructType([*_schema(df, text, "ids").fields, T.StructField("decoded", T.BinaryType())])
    return mapped(df, lambda it: _decoded(with_ids(it, text, "ids", _store(path, pattern)), path, "ids", "decoded"), schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded documents."""
    coded = round_trip(docs.select("doc_id", "text"), path, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
