"""Reranking a pool of candidates with a model."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (query, texts) -> the model's response: a list, or an object with results.
Reranker = Callable[[str, list[str]], Any]


def scores(response: Any, n: int) -> dict[int, float] | None:
    """Scores by position; None if the response has no list. Of repeats the last counts."""
    items = response.get("results") if isinstance(response, dict) else response
    if not isinstance(items, list):
        return None
    out = {}
    for at, item in enumerate(items):
        if not isinstance(item, dict):
            continue
        i = item["index"] if isinstance(item.get("index"), int) else at
        value = item.get("relevance_score", item.get("score"))
        if 0 <= i < n and isinstance(value, (int, float)):
            out[i] = float(value)
    return out


def rerank(pool: DataFrame, query: str, model: Reranker) -> DataFrame:
    """Adds rerank_score and rerank_order to at most a pool of candidates (with text and merge_order).

    A response that cannot be read leaves the order as it was.
    """
    rows = pool.select("id", "merge_order", "text", "score").orderBy("merge_order").collect()
    found = (scores(model(query, [r.text for r in rows]), len(rows)) if rows else None) or {}
    by = sorted(range(len(rows)), key=lambda i: -(found.get(i, rows[i].score or 0.0))) if found else range(len(rows))
    place = {i: n for n, i in enumerate(by)}
    scored = pool.sparkSession.createDataFrame([(r.id, found.get(i), place[i]) for i, r in enumerate(rows)], f"id {pool.schema['id'].dataType.simpleString()}, rerank_score double, rerank_order int")
    return pool.join(F.broadcast(scored), "id", "left")


def overlap(query: str, texts: list[str]) -> list[dict[str, Any]]:
    """A model for tests: the share of the query's words that a text holds."""
    words = set(query.lower().split())
    return [{"index": i, "relevance_score": len(words & set(t.lower().split())) / max(len(words), 1)} for i, t in enumerate(texts)]
