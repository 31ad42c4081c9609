"""Cutting texts at spaces into pieces that tokenize on their own, and a bounded store of their ids.

Where every space of a text is followed by a character that is not white space, no
match of the byte-level pattern crosses a space except by starting with it, so each
" piece" can be tokenized alone, once for all its occurrences. Other texts are cut
by the pattern itself (or tokenized whole). Arrow cuts and numbers the pieces of a
block; Python sees each distinct one once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space (a superset of the pattern's) or the end after a space: cut by the pattern instead.
UNSAFE = r" (?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|\z)"
#: Marks a string that is tokenized as it stands; other keys stand for " " + key.
RAW = "\n"
#: Text gathered before new pieces are tokenized together, and strings kept by a worker.
BLOCK_BYTES = 8 << 20
MOST_KEPT = 1_000_000


class Store:
    """String -> ids, for at most ``most`` strings and those of one block.

    ``encode`` turns strings into their ids end to end and each one's count;
    ``cut`` turns a text that cannot be cut at spaces into strings.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable[[str], list[str]], most: int = MOST_KEPT):
        self.encode, self.cut, self.most = encode, cut, most
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.clear()

    def clear(self) -> None:
        """Forgets all strings; a new dictionary would leave the old to the cycle collector."""
        self.index.clear()
        self.flat = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def _learn(self) -> None:
        known = len(self.ends) - 1
        new = list(islice(self.index, known, None))
        if not new:
            return
        flat, counts = self.encode([k[1:] if k[:1] == RAW else " " + k for k in new])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int64)])

    def column(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (null: none)."""
        if len(self.index) > self.most:
            self.clear()
        texts = texts.fill_null("")
        unsafe = np.flatnonzero(pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False))
        odd = {int(i): self._numbers([RAW + x for x in self.cut(texts[int(i)].as_py())]) for i in unsafe}
        if odd:
            mask = np.zeros(len(texts), bool)
            mask[unsafe] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        split = pc.split_pattern(pc.binary_join_element_wise(RAW, texts, ""), " ")
        coded = split.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        stops = split.offsets.to_numpy().astype(np.int64)
        if odd:
            rows = [odd[i] if i in odd else at[stops[i] : stops[i + 1]] for i in range(len(texts))]
            at, stops = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self._learn()
        counts = np.diff(self.ends)[at]
        offsets = np.concatenate([[0], np.cumsum(counts)])[stops]
        flat = gather(self.flat, self.ends[at], self.ends[at + 1])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))


def gather(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """flat[starts[0]:ends[0]], flat[starts[1]:ends[1]], ... end to end."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches with about ``most`` bytes of text each."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_ids(batches: Iterator[pa.RecordBatch], column: str, out: str, store: Store) -> Iterator[pa.RecordBatch]:
    """Replaces the text column by its ids (null: none)."""
    for run in blocks(batches, column):
        ids = store.column(pa.concat_arrays([b.column(column) for b in run]))
        at = 0
        for b in run:
            cols = {n: b.column(n) for n in b.schema.names if n != column}
            cols[out] = ids[at : at + b.num_rows]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
