"""Settings, search options and schemas."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType(), True)


@dataclass(frozen=True)
class Settings:
    """The engine's knobs; ``clamped`` gives the values that are used."""

    embedding_url: str = "http://127.0.0.1:11434"
    embedding_path: str = "/v1/embeddings"
    embedding_model: str = "nomic-embed-text"
    rerank_url: str = "http://127.0.0.1:11434"
    rerank_path: str = "/v1/rerank"
    rerank_model: str = ""
    use_rerank: bool = False
    chunk_size: int = 1200
    chunk_overlap: int = 180
    default_limit: int = 10
    default_source: str = ""
    use_lexical: bool = True
    candidate_multiplier: int = 4
    rerank_pool_size: int = 50
    rrf_k: float = 60
    weight_rerank: float = 1.0
    weight_vector: float = 0.6
    weight_lexical: float = 0.4

    def clamped(self) -> "Settings":
        least = {"chunk_size": 300, "chunk_overlap": 0, "default_limit": 1, "candidate_multiplier": 1, "rerank_pool_size": 1, "rrf_k": 1, "weight_rerank": 0, "weight_vector": 0, "weight_lexical": 0}
        return replace(self, **{k: number(getattr(self, k), getattr(Settings, k), v, k in ("candidate_multiplier", "rerank_pool_size")) for k, v in least.items()})


def number(value: Any, default: float, least: float, whole: bool = False) -> float:
    """A number from user input: the default for what is none, not below ``least``."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        x = default
    x = x if math.isfinite(x) else default
    x = max(least, round(x) if whole else x)
    return int(x) if float(x).is_integer() else x


def load_settings(stored: dict | None) -> Settings:
    """Stored values over the defaults; unknown names are ignored."""
    names = {f.name for f in fields(Settings)}
    return Settings(**{k: v for k, v in (stored or {}).items() if k in names})


def save_settings(settings: Settings) -> dict:
    """What load_settings reads."""
    return asdict(settings)


@dataclass(frozen=True)
class SearchOptions:
    """What narrows a search. ``allowed_paths`` is a one-column frame; None filters nothing."""

    limit: int | None = None
    source: str | None = None
    path_query: str | None = None
    allowed_paths: DataFrame | None = None
    where: str | None = None
    tags: tuple[str, ...] = ()
    frontmatter: dict[str, Any] = field(default_factory=dict)


NOTES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.StringType()),
])

CHUNKS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "path", "folder", "basename")]
    + [T.StructField("mtime", T.LongType()), T.StructField("size", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType(), True))]
    + [T.StructField(c, T.StringType()) for c in ("title", "status", "project", "type", "content_hash", "body_hash", "frontmatter_hash", "chunking_config_hash", "embedding_model")]
    + [T.StructField("embedding_dim", T.IntegerType()), T.StructField("indexed_at", T.StringType())]
    + [T.StructField(c, TEXTS) for c in ("tags", "inline_tags", "frontmatter_tags", "aliases", "frontmatter_keys")]
    + [T.StructField(c, T.StringType()) for c in ("tags_text", "aliases_text", "frontmatter_keys_text", "frontmatter_json")]
)
