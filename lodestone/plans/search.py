"""A search from question to ranked chunks, as one DataFrame plan."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analysis import Analyzer
from lodestone.operators import filters, fusion, lexical, pathset, rerank, vector
from lodestone.plans.settings import SearchOptions, Settings

log = logging.getLogger(__name__)
#: Results of one search; windows over the candidates of its two legs run in one task.
MOST_HITS = 10_000
SHOWN = ("id", "path", "folder", "basename", "mtime", "size", "position", "text", "tags", "frontmatter_json")


class SearchService:
    """``index`` is one of the chunks' text, kept or at hand; without one, the text is analyzed at each search."""

    def __init__(self, chunks: DataFrame, settings: Settings, embedder: Callable[[list[str]], list[list[float]]], reranker: rerank.Reranker | None = None, provider: pathset.NotesProvider | None = None, index: lexical.Index | lexical.StoredIndex | None = None, analyzer: Analyzer = Analyzer()):
        self.chunks, self.settings, self.embedder, self.reranker, self.provider, self.index, self.analyzer = chunks, settings.clamped(), embedder, reranker, provider, index, analyzer

    def paths(self, o: SearchOptions) -> DataFrame | None:
        if o.allowed_paths is not None:
            return o.allowed_paths
        return pathset.resolve(self.provider, self.settings.default_source if o.source is None else o.source, o.path_query)

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        s, text = self.settings, query.strip()
        limit = min(max(1, options.limit if options.limit is not None else s.default_limit), MOST_HITS)
        rows = filters.narrowed(self.chunks, options.where, options.tags, options.frontmatter, self.paths(options))
        if not text:
            rows, text = rows.limit(0), "-"
        wide = max(limit * max(1, s.candidate_multiplier), limit)
        near = vector.nearest(rows.select("id", "vector"), self.embedder([text])[0], wide)
        found = near.select("id", F.lit(None).cast("double").alias("fts_score")).limit(0)
        if s.use_lexical:
            try:
                kept = self.index.index() if isinstance(self.index, lexical.StoredIndex) else self.index
                found = lexical.search(kept or lexical.live(self.chunks, text, self.analyzer), text, wide, rows.select("id"))
            except Exception as e:  # the vectors answer alone
                log.warning("text search failed: %s", e)
        merged = fusion.ranked(fusion.merge(near, found))
        pool = fusion.pruned(merged, limit, s.rerank_pool_size, s.rrf_k, s.weight_vector, s.weight_lexical)
        legs = {"vector_rank": s.weight_vector, "lexical_rank": s.weight_lexical}
        # At most max(limit, rerank_pool_size) ids from here on.
        pool = self.chunks.select(*SHOWN).join(F.broadcast(pool), "id")
        order = "merge_order"
        if s.use_rerank and s.rerank_model and self.reranker:
            pool = fusion.competition_rank(rerank.rerank(pool, text, self.reranker), "rerank_score", "rerank_rank")
            legs["rerank_rank"], order = s.weight_rerank, "rerank_order"
        else:
            pool = pool.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_rank": F.lit(None).cast("int")})
        return fusion.top(pool.withColumn("fused_score", fusion.rrf(s.rrf_k, legs)), limit, order).drop("rerank_order", "merge_order", "pre_score")
