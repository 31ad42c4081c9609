"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the
sum of its distinct words' weights; a word's weight is that of its own and of its
prefixes of STEMS letters, so forms of a stem that are too rare to learn one by one
share what is learnt of it. Sentences combine by noisy-or, so a document is
toxic unless every sentence is clean: 1 - prod(1 - p). Only document labels train
it: the gradient of the document's likelihood passes to each sentence in proportion
to how far it could explain the label. Trained, the sentence scores locate what
offends.

Words and prefixes are hashed after case and anything but letters are stripped, so marks around
a word do not hide it. Null and empty texts have no sentences and score LEAK;
repeated rows score alike; very long texts are scored whole, and as clean words
weigh next to nothing, length alone does not make a text toxic; other columns, whatever
their names, are carried along, but one of the score's name is replaced; an empty table
has no scores, and without labels of both kinds all sentences score alike, next to nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import mapped
from lodestone.llm.pieces import gather
from lodestone.llm.training import HELD_OUT, fold, sample, sigmoid

BUCKETS = 1 << 20
EPOCHS, BATCH, RATE, DECAY, KEEP, LEAST_STEPS = 20, 64, 1.0, 0.02, 0.5, 800
#: Labelled documents it learns from, characters of them at most.
SAMPLE = (4000, 16_000_000)
START = -7.0
#: A document's chance of being marked toxic though no sentence is.
LEAK = 0.02
#: Lengths of the prefixes that a word is also known by.
STEMS = (4, 5, 6)
SPLIT = 0.3
MOST_KEPT = 400_000
ENDS = re.compile(r"[.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def letters(word: str) -> str:
    return "".join(LETTERS.findall(word)).lower()


def features(word: str) -> list[int]:
    """The buckets of a word of letters and of its prefixes; none if it has no letter."""
    parts = [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)] if word else []
    return [zlib.crc32(x.encode()) % BUCKETS for x in parts]


def sentences(text: str | None) -> list[str]:
    return [s for s in ENDS.split(text or "") if s.strip()]


class Words:
    """Words' features, kept for at most MOST_KEPT words and those of one batch."""

    def __init__(self):
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.plain: dict[str, int] = defaultdict()  # by letters alone
        self.plain.default_factory = self.plain.__len__
        self.clear()

    def clear(self) -> None:
        """Forgets all words; new dictionaries would leave the old to the cycle collector."""
        self.known.clear()
        self.plain.clear()
        self.as_plain = np.empty(0, np.int64)
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.sums = np.empty(0)

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, word by its letters) of each distinct word of a sentence, and the document of each sentence."""
        if len(self.known) > MOST_KEPT:
            self.clear()
        cut = [sentences(t) for t in texts]
        of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        words = [s.split() for c in cut for s in c]
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((k for ws in words for k in map(self.known.__getitem__, ws)), np.int64, int(n.sum()))
        new = list(islice(self.known, len(self.as_plain), None))
        self.as_plain = np.concatenate([self.as_plain, np.fromiter((self.plain[letters(w)] for w in new), np.int64, len(new))])
        made = [features(w) for w in islice(self.plain, len(self.ends) - 1, None)]
        self.flat = np.concatenate([self.flat, np.fromiter((x for m in made for x in m), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(m) for m in made], dtype=np.int64)])
        size = max(len(self.plain), 1)
        pair = np.unique(np.repeat(np.arange(len(words)), n) * size + self.as_plain[at])
        return pair // size, pair % size, of

    def weights(self, weight: np.ndarray) -> np.ndarray:
        """The sum of each word's features' weights; all calls since the last reset are of one model."""
        first = len(self.sums)
        ends = self.ends[first:] - self.ends[first]
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.sums = np.concatenate([self.sums, np.bincount(of, weight[self.flat[self.ends[first] :]], len(ends) - 1)])
        return self.sums


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def sentence_scores(self, words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        row, word, of = words.bags(texts)
        return sigmoid(self.bias + np.bincount(row, words.weights(self.weight)[word], len(of))), of

    def scores(self, words: Words, texts: list[str | None]) -> np.ndarray:
        p, of = self.sentence_scores(words, texts)
        return 1 - (1 - LEAK) * np.exp(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)))


def train(texts: list[str], y: np.ndarray, seed: int = 11) -> Model:
    """Weights by stochastic gradient descent on the noisy-or likelihood of the documents' labels.

    Updates are scaled by each weight's past gradients, and small weights are pulled to zero.
    """
    weight, seen, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1.0), START
    if not len(texts) or y.min() == y.max():
        return Model(weight, START)
    words, rng = Words(), np.random.default_rng(seed)
    row, word, of = words.bags(texts)
    word = word.astype(np.int32)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    cell = np.searchsorted(row, np.arange(len(of) + 1))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(texts) // BATCH)))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            s = np.concatenate([np.arange(first[d], first[d + 1]) for d in own])
            doc = np.repeat(np.arange(len(own)), first[own + 1] - first[own])
            # Half of the sentences, drawn anew each time, so none leaves the explaining to another for good.
            kept = rng.random(len(s)) < KEEP
            s, doc = s[kept], doc[kept]
            n = cell[s + 1] - cell[s]
            at = np.repeat(cell[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            w = word[at]
            many = words.ends[w + 1] - words.ends[w]
            r = np.repeat(np.repeat(np.arange(len(s)), n), many)
            c = gather(words.flat, words.ends[w], words.ends[w + 1])
            p = sigmoid(bias + np.bincount(r, weight[c], len(s)))
            clean = np.exp(np.bincount(doc, np.log1p(-p), len(own))) * (1 - LEAK)
            toxic = np.maximum(1 - clean, 1e-6)
            # d log-likelihood / d z of a sentence: -p for a clean document, p * clean / toxic for a toxic one
            pull = np.where(y[own] > 0, clean / toxic, -1.0)[doc] * p
            hit, back = np.unique(c, return_inverse=True)
            g = np.bincount(back, pull[r], len(hit))
            seen[hit] += g**2
            step = weight[hit] + RATE * g / np.sqrt(seen[hit])
            weight[hit] = np.sign(step) * np.maximum(np.abs(step) - DECAY / np.sqrt(seen[hit]), 0)
    return Model(weight, bias)


_held: dict[int, tuple[Model, Words]] = {}


def _worker(key: int, shared) -> tuple[Model, Words]:
    if key not in _held:
        _held.clear()
        _held[key] = (Model(*shared.value), Words())
    return _held[key]


def _share(docs: DataFrame, model: Model):
    return hash((model.weight.tobytes(), model.bias)), docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Adds the column ``out`` (or replaces it): the probability that a document is toxic."""
    docs = docs.drop(out)
    key, shared = _share(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = _worker(key, shared)
        for b in batches:
            s = m.scores(words, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number from 0), text, score of the sentences that score ``least`` or more."""
    key, shared = _share(docs, model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = _worker(key, shared)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            p, of = m.sentence_scores(words, texts)
            cut = [s for t in texts for s in sentences(t)]
            first = np.searchsorted(of, np.arange(len(texts)))
            hit = np.flatnonzero(p >= least).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[of[i]] for i in hit], b.column("doc_id").type), pa.array([i - int(first[of[i]]) for i in hit], pa.int32()), pa.array([cut[i] for i in hit], pa.string()), pa.array(p[hit], pa.float64())],
                names=["doc_id", "sentence", "text", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence int, text string, score double")


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    return train(*sample(docs, labels, label, *SAMPLE))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fitted(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= SPLIT).cast("int").alias("predicted")
    )
