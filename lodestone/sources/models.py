"""Connectors to embedding and reranking servers, and a deterministic embedder."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Post = Callable[[str, dict], Any]


def join_url(base: str, path: str) -> str:
    return base.rstrip("/") + ("" if path.startswith("/") else "/") + path


def post_json(url: str, body: dict) -> Any:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=120) as response:  # noqa: S310
        return json.load(response)


@dataclass(frozen=True)
class HttpEmbedder:
    """POSTs {model, input}; reads data[].embedding, embeddings or embedding."""

    url: str
    model: str
    post: Post = post_json

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        out = self.post(self.url, {"model": self.model, "input": texts})
        if isinstance(out, dict):
            if isinstance(out.get("data"), list):
                return [x.get("embedding") for x in out["data"]]
            if isinstance(out.get("embeddings"), list):
                return out["embeddings"]
            if isinstance(out.get("embedding"), list):
                return [out["embedding"]]
        raise ValueError("the embedding server's response holds no embeddings")


@dataclass(frozen=True)
class HttpReranker:
    """POSTs {model, query, documents} and returns the response as it is."""

    url: str
    model: str
    post: Post = post_json

    def __call__(self, query: str, texts: list[str]) -> Any:
        return self.post(self.url, {"model": self.model, "query": query, "documents": texts})


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors of hashed words: the same everywhere, and near for texts that share words."""

    dim: int = 64
    model: str = "hash"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(size > 0, size, 1)).tolist()


def answers(embedder: Callable[[list[str]], list[list[float]]], texts: list[str], strict: bool) -> tuple[list, list[str | None]]:
    """A vector or None and an error or None of each text; unless ``strict``, texts that fail together are tried in halves."""
    try:
        vectors = list(embedder(texts))
    except Exception as e:  # noqa: BLE001 - whatever a model raises is the failure of a text
        if strict:
            raise
        if len(texts) == 1:
            return [None], [str(e) or type(e).__name__]
        half = len(texts) // 2
        (v, x), (w, y) = answers(embedder, texts[:half], False), answers(embedder, texts[half:], False)
        return v + w, x + y
    return (vectors + [None] * len(texts))[: len(texts)], [None] * len(texts)


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 64, error: str | None = None) -> DataFrame:
    """Adds vector: texts of many notes go to the model together. Null where the model gives none.

    With a column ``error``, a failing text does not fail the others: its message is kept there.
    """
    added = ["vector", *([error] if error else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors, errors = answers(embedder, part.column(text).to_pylist(), error is None)
                more = [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more[: len(added)]], names=[*part.schema.names, *added])

    kinds = [T.ArrayType(T.FloatType(), True), T.StringType()]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(added, kinds)]]))
