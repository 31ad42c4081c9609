"""Quality classifier by supervised subword embeddings.

A document is the mean of the vectors of its features: its words, their character
n-grams and its word bigrams, all hashed into one table of vectors. A softmax layer
over the mean gives the two classes. Vectors and layer are trained together by
stochastic gradient descent in numpy, on the sample of training.py; the model is then
two numbers a bucket, summed over whole texts.

A bigram's hash is that of the difference of its words' hashes, so every bigram of a
word and itself has one bucket, whose vector is learned like any other.

Null and empty texts have no features and score by the bias; texts of any length are
scored whole; repeated rows score alike; other columns, whatever their names, are
carried along, but a column of the score's name is replaced; an empty table has no
scores, and without labels of both kinds the score is a constant. Scores are
deterministic for a given table.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import mapped
from lodestone.llm.pieces import gather
from lodestone.llm.training import HELD_OUT, fold, sample, sigmoid

BITS, SIZE, GRAMS = 16, 8, (1, 2, 3)
BUCKETS = 1 << BITS
EPOCHS, BATCH, RATE, LEAST_STEPS = 6, 32, 2.0, 500
#: Labelled documents it learns from, characters of them at most.
SAMPLE = (2500, 10_000_000)
SPLIT = 0.7
MOST_KEPT = 400_000
#: Words whose features are made at a time.
WORDS = 10_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code * SPREAD >> np.uint64(64 - BITS)).astype(np.uint16)


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word and of its n-grams of code points, end to end, and how many each word has.

    Words stand between marks, which count as characters of their n-grams.
    """
    raw = [f"<{w}>" for w in words]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(raw)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))
    where, codes = [np.arange(len(raw))], [hashes(words)]
    code = np.zeros(len(flat), np.uint64)
    for g in range(1, max(GRAMS) + 1):
        shifted = np.concatenate([flat[g - 1 :], np.zeros(min(g - 1, len(flat)), np.uint64)])
        code = code * np.uint64(0x110000) + shifted + np.uint64(1)
        if g in GRAMS:
            whole = left >= g
            where.append(word[whole])
            codes.append(code[whole])
    at, code = np.concatenate(where), np.concatenate(codes)
    order = np.argsort(at, kind="stable")
    return _bucket(code)[order], np.bincount(at, minlength=len(raw))


def bigrams(h: np.ndarray) -> np.ndarray:
    """The buckets of the bigrams of words with the hashes ``h``, in order."""
    return _bucket(h[1:] - h[:-1])


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its vector times the difference of the layer's rows
    bias: float

    def __post_init__(self):
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.sums, self.hashes = np.empty((0, 2)), np.empty(0, np.uint64)

    def __reduce__(self):
        return Model, (self.weight, self.bias)

    def _learn(self) -> None:
        new = islice(self.known, len(self.sums), None)
        sums, hashed = [self.sums], [self.hashes]
        while part := list(islice(new, WORDS)):
            flat, n = features(part)
            sums.append(np.stack([np.add.reduceat(self.weight[flat], np.cumsum(n) - n), n], 1))
            hashed.append(hashes(part))
        self.sums, self.hashes = np.concatenate(sums), np.concatenate(hashed)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > MOST_KEPT:
            self.known.clear()  # a new one would leave the old to the cycle collector
            self.sums, self.hashes = np.empty((0, 2)), np.empty(0, np.uint64)
        words = [(t or "").split() for t in texts]
        at = [np.fromiter(map(self.known.__getitem__, w), np.int64, len(w)) for w in words]
        self._learn()
        out = np.full(len(texts), self.bias)
        for i, k in enumerate(at):
            if len(k):
                total, n = self.sums[k].sum(0)
                out[i] += (total + self.weight[bigrams(self.hashes[k])].sum()) / (n + len(k) - 1)
        return sigmoid(out)


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> Model:
    """Vectors and softmax layer by stochastic gradient descent, the rate falling to zero."""
    if not len(texts) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0 if not len(texts) else (4.0 if y[0] else -4.0))
    place: dict[str, int] = defaultdict()
    place.default_factory = place.__len__
    for t in texts:
        for w in t.split():
            place[w]
    words = iter(place)
    made = [(*features(part), hashes(part)) for part in iter(lambda: list(islice(words, WORDS)), [])]
    flat, many, hashed = (np.concatenate([m[i] for m in made] or [np.empty(0, np.int64)]) for i in (0, 1, 2))
    del made
    ends = np.cumsum(many)
    cells, shares = [], []  # two and four bytes a feature, as these are most of the memory
    for t in texts:
        ws = np.fromiter(map(place.__getitem__, t.split()), np.int64)
        c = Counter(ws.tolist())
        at = np.fromiter(c, np.int64, len(c))
        found = gather(flat, ends[at] - many[at], ends[at])
        n = np.bincount(found, np.repeat(np.fromiter(c.values(), np.float64, len(c)), many[at]), BUCKETS)
        n += np.bincount(bigrams(hashed[ws]), minlength=BUCKETS)
        k = np.flatnonzero(n)
        cells.append(k.astype(np.uint16))
        shares.append((n[k] / max(n.sum(), 1)).astype(np.float32))
    del place, flat
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    layer, bias = np.zeros((2, SIZE)), np.zeros(2)
    target = np.stack([1 - y, y], 1)
    each, step = -(-len(texts) // BATCH), 0
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            n = np.array([len(cells[j]) for j in own])
            flat, share = np.concatenate([cells[j] for j in own]), np.concatenate([shares[j] for j in own])
            row = np.repeat(np.arange(len(own)), n)
            part = table[flat] * share[:, None]
            mean = np.stack([np.bincount(row, part[:, d], len(own)) for d in range(SIZE)], 1)
            z = mean @ layer.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            gap = p - target[own]
            back = (gap @ layer)[row] * share[:, None]
            layer -= rate / len(own) * gap.T @ mean
            bias -= rate / len(own) * gap.sum(0)
            for d in range(SIZE):  # each document's features learn at full rate, as one step of each would
                table[:, d] -= rate * np.bincount(flat, back[:, d], BUCKETS)
    return Model(table @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


_held: dict[int, Model] = {}


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Adds the column ``out`` (or replaces it): the probability of label 1."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # BUCKETS numbers
    key = hash((model.weight.tobytes(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            _held[key] = Model(*shared.value)
        for b in batches:
            s = _held[key].scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    return train(*sample(docs, labels, label, *SAMPLE))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fitted(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= SPLIT).cast("int").alias("predicted")
    )
