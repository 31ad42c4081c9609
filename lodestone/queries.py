"""The engine's queries over the test tables, and DuckDB SQL that must give the same rows.

Fixtures (notes, two versions of them, chunks) are SQL that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.analysis import PLAIN_ANALYZER, Analyzer
from lodestone.operators import filters, fusion, lexical, maintain, pathset, queue, rerank, vector
from lodestone.operators.chunk import chunk
from lodestone.plans.indexer import Indexer
from lodestone.plans.search import SearchService
from lodestone.plans.settings import CHUNKS, SearchOptions, Settings
from lodestone.sources.shared import scratch
from lodestone.sources.store import Store
from lodestone.sources.vault import prepare

SIZE, OVERLAP = 1200, 180
QUESTION = "the and thand idiot der les"
WIDE = 400

#: One note a document: front matter, a line of tags, and the text with blank lines between its lines.
NOTES = """
SELECT d.doc_id, concat(coalesce(d.source, ''), '/', coalesce(d.lang, ''), '/', cast(d.doc_id AS STRING), '.md') AS path,
    cast(d.doc_id * 1000 AS BIGINT) AS mtime, cast(length(coalesce(d.text, '')) AS BIGINT) AS size,
    concat('Note ', cast(d.doc_id AS STRING)) AS title,
    CASE WHEN l.quality = 1 THEN 'active' WHEN l.quality = 0 THEN 'draft' ELSE '' END AS status,
    coalesce(d.source, '') AS project, coalesce(d.lang, '') AS type,
    concat('{"title":"Note ', cast(d.doc_id AS STRING), '","rank":', cast(d.doc_id % 20 AS STRING), '}') AS frontmatter_json,
    concat('---', chr(10), 'title: Note ', cast(d.doc_id AS STRING), chr(10), 'rank: ', cast(d.doc_id % 20 AS STRING), chr(10), '---', chr(10),
        '#', coalesce(d.source, ''), ' #lang/', coalesce(d.lang, ''), ' #', coalesce(d.source, ''), chr(10), chr(10),
        replace(coalesce(d.text, ''), chr(10), concat(chr(10), chr(10)))) AS content
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

#: The notes as they were: by kind, alike, other front matter, other body, CRLF, under another path, another model.
EARLIER = """
SELECT CASE WHEN k = 4 THEN concat('old/', path) ELSE path END AS path, mtime, size,
    CASE k WHEN 1 THEN replace(content, 'rank: ', 'rank: 1') WHEN 2 THEN concat(content, 'x') WHEN 3 THEN replace(content, chr(10), concat(chr(13), chr(10))) ELSE content END AS content,
    CASE WHEN k = 5 THEN 'other' ELSE 'hash' END AS embedding_model
FROM (SELECT *, doc_id % 6 AS k FROM notes) t
"""

#: Notes with more in their front matter: lists, an alias, a status.
RICH = """
SELECT doc_id, path, mtime, size, replace(content, concat('rank: ', cast(doc_id % 20 AS STRING), chr(10), '---'),
    concat('rank: ', cast(doc_id % 20 AS STRING), chr(10), 'status: active', chr(10), 'tags: [b tag, "#a/b"]', chr(10), 'alias: One Two', chr(10), 'project: [x, y]', chr(10), '---')) AS content
FROM notes
"""

TAGS_SQL = "list_transform(list_sort(list_distinct(regexp_extract_all({}, '(^|[\\t\\n\\x0B\\f\\r ])#([A-Za-z0-9/_-]+)', 2))), lambda t: t)"
BODY_SQL = """CASE WHEN starts_with(n, '---' || chr(10)) AND instr(substr(n, 5), chr(10) || '---') > 0 THEN
    CASE WHEN instr(substr(n, 4 + instr(substr(n, 5), chr(10) || '---') + 4), chr(10)) = 0 THEN ''
    ELSE substr(n, 4 + instr(substr(n, 5), chr(10) || '---') + 4 + instr(substr(n, 4 + instr(substr(n, 5), chr(10) || '---') + 4), chr(10))) END ELSE n END"""
RAW_SQL = """CASE WHEN starts_with(n, '---' || chr(10)) AND instr(substr(n, 5), chr(10) || '---') > 0 THEN
    CASE WHEN instr(substr(n, 4 + instr(substr(n, 5), chr(10) || '---') + 4), chr(10)) = 0 THEN n
    ELSE substr(n, 1, 4 + instr(substr(n, 5), chr(10) || '---') + 4 + instr(substr(n, 4 + instr(substr(n, 5), chr(10) || '---') + 4), chr(10)) - 2) END ELSE '' END"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NOTES.replace("documents d", "{documents} d").replace("labels l", "{labels} l").replace('\'{"title"', "'{{\"title\"").replace("'}')", "'}}')"), documents=_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels"))


def earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EARLIER.replace("FROM notes", "FROM {notes}"), notes=notes(spark, sf_dir))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RICH.replace("FROM notes", "FROM {notes}"), notes=notes(spark, sf_dir))


def parsed(rows: DataFrame) -> DataFrame:
    """Body, hashes and tags of notes, by built-in expressions alone."""
    body = rows.withColumns({"body": X.body(F.col("content")), "raw": X.raw_frontmatter(F.col("content"))})
    body = body.withColumn("tags", X.inline_tags(F.col("body")))
    return body.withColumns({"content_hash": X.sha(F.col("content")), "body_hash": X.sha(F.col("body")), "frontmatter_hash": X.sha(F.col("raw")), "tags_text": X.list_text(F.col("tags"))})


def parsed_sql(rows: str = "notes") -> str:
    return f"""SELECT *, sha256(content) AS content_hash, sha256(body) AS body_hash, sha256(raw) AS frontmatter_hash,
        concat('|', array_to_string(list_transform(tags, lambda t: lower(t)), '|'), '|') AS tags_text
    FROM (SELECT *, {TAGS_SQL.format('body')} AS tags FROM (SELECT *, {BODY_SQL} AS body, {RAW_SQL} AS raw FROM (SELECT *, replace(content, chr(13) || chr(10), chr(10)) AS n FROM {rows})))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(parsed(notes(spark, sf_dir)).select("path", "status", "project", "type", "title", "frontmatter_json", "tags_text", "body", "body_hash"), SIZE, OVERLAP)


def chunks_sql() -> str:
    step, half = SIZE - OVERLAP, SIZE // 2
    trim = lambda x: f"regexp_replace({x}, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g')"
    return f"""SELECT path, status, project, type, title, frontmatter_json, tags_text, body_hash, row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS position, text,
        path || '#' || substr(body_hash, 1, 12) || '#' || (row_number() OVER (PARTITION BY path ORDER BY s) - 1) AS id
    FROM (
        SELECT *, {trim("substr(clean, s + 1, CASE WHEN e < len AND back > 0 THEN w + length(seen) - back - 1 ELSE e END - s)")} AS text
        FROM (SELECT *, instr(reverse(seen), chr(10) || chr(10)) AS back FROM (SELECT *, substr(clean, w + 1, e + 2 - w) AS seen FROM (
            SELECT p.*, i * {step} AS s, least(len, i * {step} + {SIZE}) AS e, i * {step} + {half + 1} AS w
            FROM (SELECT *, length(clean) AS len FROM (SELECT *, {trim('body')} AS clean FROM ({parsed_sql()}))) p,
            unnest(range(CASE WHEN len = 0 THEN 0 WHEN len <= {SIZE} THEN 1 ELSE 1 + ceil((len - {SIZE}) / {float(step)})::BIGINT END)) AS r(i))))
    ) WHERE text <> ''"""


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])


def near(spark: SparkSession, sf_dir: str, limit: int, rows: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    e = rows(_table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.nearest(e, first_vector(spark, sf_dir), limit)


def near_sql(limit: int, where: str = "true") -> str:
    dot = "list_dot_product(e.embedding::DOUBLE[], q.v)"
    return f"""SELECT id, distance, 1 / (1 + distance) AS score FROM (
        SELECT vec_id AS id, round(1 - {dot} / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v))), 9) + 0.0 AS distance
        FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE {where})
    ORDER BY distance, id LIMIT {limit}"""


def found(spark: SparkSession, sf_dir: str, limit: int | None, analyzer: Analyzer = PLAIN_ANALYZER) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.search(lexical.live(d, QUESTION, analyzer), QUESTION, limit)


def found_sql(limit: int | None) -> str:
    terms = ", ".join(f"'{w}'" for w in sorted(set(QUESTION.split())))
    return f"""SELECT id, fts_score FROM (
        WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
        s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
        p AS (SELECT id, len(w) AS dl, q.term, len(list_filter(w, lambda x: x = q.term)) AS tf FROM t, (SELECT unnest([{terms}]) AS term) q),
        h AS (SELECT * FROM p WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
        SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 9) AS fts_score
        FROM h JOIN f USING (term), s GROUP BY id)
    ORDER BY fts_score DESC, id{f" LIMIT {limit}" if limit else ""}"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.ranked(fusion.merge(near(spark, sf_dir, WIDE), found(spark, sf_dir, WIDE)))


def merged_sql() -> str:
    return f"""SELECT *, CASE WHEN distance IS NOT NULL THEN rank() OVER (ORDER BY CASE WHEN distance IS NOT NULL THEN score END DESC NULLS LAST) END AS vector_rank,
        CASE WHEN fts_score IS NOT NULL THEN rank() OVER (ORDER BY fts_score DESC NULLS LAST) END AS lexical_rank
    FROM (SELECT coalesce(v.id, x.id) AS id, distance, coalesce(score, 0.0::DOUBLE) AS score, fts_score,
            row_number() OVER (ORDER BY vo NULLS LAST, lo NULLS LAST) AS merge_order
        FROM (SELECT *, row_number() OVER (ORDER BY distance, id) AS vo FROM ({near_sql(WIDE)})) v
        FULL OUTER JOIN (SELECT *, row_number() OVER (ORDER BY fts_score DESC, id) AS lo FROM ({found_sql(WIDE)})) x ON v.id = x.id)"""


RRF_SQL = "round(coalesce(0.6::DOUBLE / (60.0 + vector_rank), 0.0::DOUBLE) + coalesce(0.4::DOUBLE / (60.0 + lexical_rank), 0.0::DOUBLE), 12)"
LEGS = {"vector_rank": 0.6, "lexical_rank": 0.4}
LONGS = lambda d: d.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) if t in ("int", "smallint") else F.col(c) for c, t in d.dtypes])


def pool(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    return fusion.pruned(merged(spark, sf_dir), 10, size, 60, 0.6, 0.4)


def pool_sql(size: int = 50) -> str:
    return f"SELECT *, {RRF_SQL} AS pre_score FROM ({merged_sql()}) ORDER BY pre_score DESC, merge_order LIMIT {size}"


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    best = pool(spark, sf_dir)
    # At most 50 ids pick their texts, so the documents do not shuffle.
    texts = docs.join(F.broadcast(best.select("id")), "id")
    rows = best.join(texts, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = fusion.competition_rank(rerank.rerank(rows, QUESTION, rerank.overlap), "rerank_score", "rerank_rank")
    out = rows.withColumn("fused_score", fusion.rrf(60, {"vector_rank": 0.6, "lexical_rank": 0.4, "rerank_rank": 1.0}))
    return LONGS(fusion.top(out, 10, "rerank_order").select("id", "rerank_score", "rerank_rank", "fused_score"))


def reranked_sql() -> str:
    words = sorted(set(QUESTION.split()))
    has = " + ".join(f"CASE WHEN list_contains(w, '{x}') THEN 1 ELSE 0 END" for x in words)
    return f"""SELECT id, rerank_score, rerank_rank, fused_score FROM (
        SELECT *, round(coalesce(0.6::DOUBLE / (60.0 + vector_rank), 0.0::DOUBLE) + coalesce(0.4::DOUBLE / (60.0 + lexical_rank), 0.0::DOUBLE) + 1.0::DOUBLE / (60.0 + rerank_rank), 12) AS fused_score
        FROM (SELECT *, rank() OVER (ORDER BY rerank_score DESC) AS rerank_rank FROM (
            SELECT p.*, ({has}) / {len(words)}::DOUBLE AS rerank_score
            FROM (SELECT p.*, regexp_split_to_array(lower(coalesce(d.text, '')), '\\s+') AS w FROM ({pool_sql()}) p LEFT JOIN documents d ON d.doc_id = p.id) p)))
    ORDER BY fused_score DESC, rerank_score DESC, merge_order, id LIMIT 10"""


def narrowed(**by) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.narrowed(chunks(spark, sf_dir), **by).select("id")

    return run


def _state(rows: DataFrame, model: str | None) -> DataFrame:
    p = parsed(rows)
    return p.select("path", "content_hash", "body_hash", "frontmatter_hash", F.lit(X.config_hash(SIZE, OVERLAP)).alias("chunking_config_hash"), (F.lit(model) if model else F.col("embedding_model")).alias("embedding_model"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.decide(_state(notes(spark, sf_dir), "hash"), _state(earlier(spark, sf_dir), None)).select("path", "decision")


def decided_sql() -> str:
    return f"""SELECT n.path, CASE WHEN o.path IS NULL THEN 'missing' WHEN o.embedding_model <> 'hash' THEN 'config-changed'
        WHEN n.content_hash = o.content_hash THEN 'unchanged' WHEN n.body_hash = o.body_hash AND n.frontmatter_hash <> o.frontmatter_hash THEN 'metadata-only'
        ELSE 'content-changed' END AS decision
    FROM ({parsed_sql()}) n LEFT JOIN ({parsed_sql('earlier')}) o ON n.path = o.path"""


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.missing_paths(earlier(spark, sf_dir).select("path"), notes(spark, sf_dir)).select("path")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the earlier notes."""
    return chunk(parsed(earlier(spark, sf_dir)).withColumn("status", F.lit("old")).select("path", "mtime", "status", X.folder(F.col("path")).alias("folder"), X.basename(F.col("path")).alias("basename"), "body", "body_hash", "content_hash"), SIZE, OVERLAP)


KEPT_SQL = lambda: chunks_sql().replace("status, project, type, title, frontmatter_json, tags_text, body_hash,", "status, mtime, content_hash, body_hash, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS basename,").replace(parsed_sql(), "SELECT *, 'old' AS status FROM (" + parsed_sql("earlier") + ")")


def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = parsed(notes(spark, sf_dir)).join(decided(spark, sf_dir).where("decision = 'metadata-only'"), "path", "left_semi")
    out = maintain.update_metadata(_kept(spark, sf_dir), hit.select("path", "mtime", "status", "content_hash"))
    return LONGS(out.select("id", "path", "status", "content_hash", "body_hash"))


def rename_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = notes(spark, sf_dir).select(F.concat(F.lit("old/"), "path").alias("old_path"), F.col("path").alias("new_path"))
    return maintain.rename(_kept(spark, sf_dir), moves).select("id", "path", "folder", "basename")


def replace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = _kept(spark, sf_dir).select("id", "path", "text"), chunks(spark, sf_dir).select("id", "path", "text")
    changed = decided(spark, sf_dir).where("decision IN ('missing', 'content-changed', 'config-changed')").select("path")
    out = maintain.replace(old, changed, now.join(changed, "path", "left_semi"))
    return out.select("id", "path", X.sha(F.col("text")).alias("text_hash"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("enqueued_at"), F.col("ts").alias("updated_at"), F.col("event_id").alias("attempts"))


OUTCOME = "CASE event_type WHEN 'purchase' THEN 'embedded' WHEN 'signup' THEN 'metadata-only' WHEN 'view' THEN 'unchanged' WHEN 'error' THEN 'failed' ELSE 'queued' END"


NOW = "2024-01-01T00:00:00Z"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prepare(rich(spark, sf_dir).select("path", "mtime", "size", "content"), SIZE, OVERLAP, "hash", NOW).drop("body")
    return out.select(*[F.array_join(c, " ").alias(c) if kind == "array<string>" else F.col(c) for c, kind in out.dtypes])


def prepared_sql() -> str:
    text = "list_transform(tags, lambda t: lower(t))"
    return f"""SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS basename, mtime, size,
        'Note ' || doc_id AS title, 'active' AS status, 'x, y' AS project, '' AS type, content_hash, body_hash, frontmatter_hash,
        '{X.config_hash(SIZE, OVERLAP)}' AS chunking_config_hash, 'hash' AS embedding_model, '{NOW}' AS indexed_at,
        array_to_string(tags, ' ') AS tags, array_to_string(inline_tags, ' ') AS inline_tags, 'a/b b tag' AS frontmatter_tags, 'One Two' AS aliases, 'alias project rank status tags title' AS frontmatter_keys,
        '|' || array_to_string({text}, '|') || '|' AS tags_text, '|one|two|' AS aliases_text, '|alias|project|rank|status|tags|title|' AS frontmatter_keys_text,
        '{{"title":"Note ' || doc_id || '","rank":' || doc_id % 20 || ',"status":"active","tags":["b tag","#a/b"],"alias":"One Two","project":["x","y"]}}' AS frontmatter_json
    FROM (SELECT * REPLACE (list_sort(list_distinct(list_concat(tags, ['a/b', 'b', 'tag']))) AS tags), tags AS inline_tags FROM ({parsed_sql('rich')}))"""


SOURCE = '(#lang/en or "src1") and -#SRC0'
PATH_QUERY = 'TABLE title FROM #lang and -"src2" WHERE rank >= 10 AND status = "active" OR title = "Note 3"'


def provider(spark: SparkSession, sf_dir: str) -> pathset.NotesProvider:
    return pathset.NotesProvider(parsed(notes(spark, sf_dir)).select("path", "tags", "title", "status", "frontmatter_json"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after a keyword, part of a word, or nothing."""
    before = F.expr("CASE doc_id % 6 WHEN 0 THEN ' list ' WHEN 1 THEN 'TABLE' WHEN 2 THEN concat(chr(10), 'Calendar', chr(10)) WHEN 3 THEN 'task' ELSE '' END")
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(before, F.coalesce("text", F.lit(""))).alias("text"))


def path_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(notes(spark, sf_dir)).withColumns({"chunking_config_hash": F.lit(X.config_hash(SIZE, OVERLAP)), "embedding_model": F.lit("hash"), "embedding_dim": F.lit(64).cast("long")})
    return maintain.path_state(chunk(rows.select("path", *maintain.STATE, "body"), SIZE, OVERLAP))


def found_in_store(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """BM25 over postings kept as tables: an index of most documents, brought up to date with the rest."""
    kept = lexical.StoredIndex(spark, scratch(spark, "postings"), PLAIN_ANALYZER)
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    kept.refresh(d.where("id % 10 <> 3").unionByName(d.where("id % 50 = 3").select((-1 - F.col("id")).alias("id"), "text")))
    kept.refresh(d)
    return lexical.search(kept.index(), QUESTION, limit)


class Letters:
    """A model that counts eight letters, so that SQL can do the same."""

    names = "etaoinsh"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in self.names] for t in texts]


def service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: notes indexed into a store, its texts into postings, and a narrowed search over both."""
    store, kept = Store(spark, scratch(spark, "chunks"), CHUNKS), lexical.StoredIndex(spark, scratch(spark, "postings"), PLAIN_ANALYZER)
    Indexer(store, Settings(embedding_model="letters"), Letters()).index(notes(spark, sf_dir).select("path", "mtime", "size", "content"))
    kept.refresh(store.read())
    search = SearchService(store.read(), Settings(), Letters(), index=kept).search(QUESTION, SearchOptions(tags=("#lang/EN",), where="length(text) > 300"))
    return LONGS(search.select("id", "path", "distance", "fts_score", "vector_rank", "lexical_rank", "fused_score")).fillna(0.0, ["distance", "fts_score"])


def service_sql(limit: int = 10, pool: int = 50) -> str:
    q = Letters()([QUESTION])[0]
    terms, wide = ", ".join(f"'{w}'" for w in sorted(set(QUESTION.split()))), 4 * limit
    counts = ", ".join(f"(length(low) - length(replace(low, '{c}', '')))::DOUBLE" for c in Letters.names)
    return f""", c AS MATERIALIZED (SELECT *, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+') AS w, [{counts}] AS v FROM (SELECT *, lower(text) AS low FROM ({chunks_sql()}))),
        ok AS MATERIALIZED (SELECT * FROM c WHERE tags_text LIKE '%|lang/en|%' AND length(text) > 300),
        near AS (SELECT *, 1 / (1 + distance) AS score, row_number() OVER (ORDER BY distance, id) AS vo FROM (
            SELECT id, round(1 - list_dot_product(v, {q}::DOUBLE[]) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({q}::DOUBLE[], {q}::DOUBLE[]))), 9) + 0.0 AS distance
            FROM ok WHERE list_dot_product(v, v) > 0) ORDER BY distance, id LIMIT {wide}),
        s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM c),
        h AS (SELECT * FROM (SELECT id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM c, (SELECT unnest([{terms}]) AS term)) WHERE tf > 0),
        f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
        fts AS (SELECT *, row_number() OVER (ORDER BY fts_score DESC, id) AS lo FROM (
            SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 9) AS fts_score
            FROM h JOIN f USING (term), s WHERE id IN (SELECT id FROM ok) GROUP BY id) ORDER BY fts_score DESC, id LIMIT {wide}),
        m AS (SELECT coalesce(near.id, fts.id) AS id, distance, coalesce(score, 0.0::DOUBLE) AS score, fts_score, row_number() OVER (ORDER BY vo NULLS LAST, lo NULLS LAST) AS merge_order FROM near FULL OUTER JOIN fts ON near.id = fts.id),
        r AS (SELECT *, CASE WHEN distance IS NOT NULL THEN rank() OVER (ORDER BY CASE WHEN distance IS NOT NULL THEN score END DESC NULLS LAST) END AS vector_rank,
            CASE WHEN fts_score IS NOT NULL THEN rank() OVER (ORDER BY fts_score DESC NULLS LAST) END AS lexical_rank FROM m),
        p AS (SELECT *, {RRF_SQL} AS fused_score FROM r ORDER BY fused_score DESC, merge_order LIMIT {pool})
        SELECT id, path, coalesce(distance, 0.0::DOUBLE) AS distance, coalesce(fts_score, 0.0::DOUBLE) AS fts_score, coalesce(vector_rank, 0) AS vector_rank, coalesce(lexical_rank, 0) AS lexical_rank, fused_score
        FROM p JOIN (SELECT id, path FROM c) USING (id) ORDER BY fused_score DESC, merge_order, id LIMIT {limit}"""


def _with(sql: str, *tables: str) -> str:
    """SQL with the fixtures it needs before it."""
    return "WITH notes AS (" + NOTES + "), earlier AS (" + EARLIER + "), rich AS (" + RICH + ")\n" + sql


def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = notes(spark, sf_dir).where("status = 'active'").select("path")
    return filters.narrowed(chunks(spark, sf_dir), paths=paths).select("id")


def _empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.narrowed(chunks(spark, sf_dir), paths=notes(spark, sf_dir).where("status = 'nowhere'").select("path")).select("id")


#: Rows with and without a fused score, and with and without a rerank part.
LABELLED = "SELECT id, score, vector_rank, lexical_rank, CASE WHEN id % 5 = 0 THEN NULL ELSE fused_score END AS fused_score, CASE WHEN id % 3 = 0 THEN (id % 1000) / 8.0E0 END AS rerank FROM fused"


def _labels(d: DataFrame) -> DataFrame:
    rows = d.sparkSession.sql(LABELLED.replace("FROM fused", "FROM {fused}"), fused=d)
    rank = F.when(F.col("rerank").isNotNull(), F.lit(1))
    return rows.select("id", X.score_label(F.col("fused_score"), rank, F.col("rerank"), F.col("vector_rank"), F.col("lexical_rank"), F.col("score")).alias("label"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).withColumn("fused_score", fusion.rrf(60, LEGS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vector_topk": lambda s, d: near(s, d, 10),
    "vector_topk_filtered": lambda s, d: near(s, d, 10, lambda e: e.where("label = 1")),
    "bm25_topk": lambda s, d: found(s, d, 40),
    "bm25_all": lambda s, d: found(s, d, None),
    "bm25_stemmed": lambda s, d: found(s, d, 40, Analyzer()),
    "hybrid_rrf": lambda s, d: LONGS(_fused(s, d)),
    "hybrid_topk": lambda s, d: LONGS(fusion.top(pool(s, d).withColumn("fused_score", fusion.rrf(60, LEGS)), 10).select("id", "vector_rank", "lexical_rank", "fused_score")),
    "hybrid_pool_pruned": lambda s, d: LONGS(pool(s, d, 25).select("id", "vector_rank", "lexical_rank", "pre_score")),
    "hybrid_reranked": reranked,
    "competition_rank": lambda s, d: LONGS(fusion.competition_rank(_table(s, d, "embeddings").groupBy("label").count().withColumn("score", F.col("label") % 3), "score", "place").select("label", "score", "place")),
    "chunk_documents": lambda s, d: LONGS(chunks(s, d).select("id", "path", "position", X.sha(F.col("text")).alias("text_hash"), F.length("text").alias("n"))),
    "chunk_stats": lambda s, d: LONGS(chunks(s, d).groupBy("path").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("n"))),
    "strip_frontmatter": lambda s, d: parsed(notes(s, d)).select("path", X.sha(F.col("body")).alias("body_hash"), F.col("raw").alias("raw")),
    "fingerprints": lambda s, d: _state(notes(s, d), "hash"),
    "inline_tags": lambda s, d: parsed(notes(s, d)).select("path", F.explode("tags").alias("tag")),
    "tags_text": lambda s, d: parsed(notes(s, d)).select("path", "tags_text"),
    "note_names": lambda s, d: notes(s, d).select("path", X.folder(F.col("path")).alias("folder"), X.basename(F.col("path")).alias("basename")),
    "note_prepare": prepared,
    "filter_tags_all": narrowed(tags=("#lang/en", "SRC1")),
    "filter_frontmatter_like": narrowed(fm={"rank": 1}),
    "filter_scalar": narrowed(fm={"status": "active", "type": "fr"}),
    "filter_where": narrowed(where="position > 0 AND length(text) < 1000"),
    "allowed_paths_semi": _semi,
    "allowed_paths_empty": _empty,
    "path_scan": lambda s, d: chunks(s, d).select("path").distinct(),
    "decide_index": decided,
    "index_stats": lambda s, d: maintain.stats(decided(s, d), 0),
    "metadata_update": metadata_update,
    "rename_paths": rename_paths,
    "replace_paths": replace_paths,
    "remove_missing": _gone,
    "queue_dedupe": lambda s, d: queue.pending(events(s, d)),
    "queue_stats": lambda s, d: queue.stats(_table(s, d, "events").select(F.expr(OUTCOME).alias("outcome"))),
    "status_counts": lambda s, d: maintain.status(chunks(s, d)),
    "render_scores": lambda s, d: _labels(_fused(s, d)),
    "excerpt": lambda s, d: chunks(s, d).select("id", X.excerpt(F.col("text")).alias("excerpt")),
    "path_query": lambda s, d: questions(s, d).select("doc_id", X.is_path_query(F.col("text")).alias("is_query")),
    "path_set_source": lambda s, d: provider(s, d).by_source(SOURCE),
    "path_set_query": lambda s, d: provider(s, d).by_query(PATH_QUERY),
    "path_state": path_state,
    "filter_path": lambda s, d: chunks(s, d).where(filters.at_path("src1/en/1.md") | filters.at_path("src3/fr/3.md") | filters.at_path("src0/fr/0.md")).select("id", "path"),
    "bm25_stored": lambda s, d: found_in_store(s, d, 40),
    "service_search": service,
}


def sql() -> dict[str, str]:
    one = lambda what, frm: _with(f"SELECT {what} FROM ({frm})")
    narrow = lambda cond: _with(f"SELECT id FROM ({chunks_sql()}) c WHERE {cond}")
    config = X.config_hash(SIZE, OVERLAP)
    changed = f"SELECT path FROM ({decided_sql()}) WHERE decision IN ('missing', 'content-changed', 'config-changed')"
    return {
        "vector_topk": near_sql(10),
        "vector_topk_filtered": near_sql(10, "label = 1"),
        "bm25_topk": found_sql(40),
        "bm25_all": found_sql(None),
        "hybrid_rrf": f"SELECT * REPLACE (coalesce(vector_rank, 0) AS vector_rank, coalesce(lexical_rank, 0) AS lexical_rank), {RRF_SQL} AS fused_score FROM ({merged_sql()})",
        "hybrid_topk": f"SELECT id, coalesce(vector_rank, 0) AS vector_rank, coalesce(lexical_rank, 0) AS lexical_rank, {RRF_SQL} AS fused_score FROM ({pool_sql()}) ORDER BY fused_score DESC, merge_order LIMIT 10",
        "hybrid_pool_pruned": f"SELECT id, coalesce(vector_rank, 0) AS vector_rank, coalesce(lexical_rank, 0) AS lexical_rank, pre_score FROM ({pool_sql(25)})",
        "hybrid_reranked": reranked_sql(),
        "competition_rank": "SELECT label::BIGINT AS label, (label % 3)::BIGINT AS score, rank() OVER (ORDER BY label % 3 DESC) AS place FROM (SELECT DISTINCT label FROM embeddings)",
        "chunk_documents": one("id, path, position, sha256(text) AS text_hash, length(text) AS n", chunks_sql()),
        "chunk_stats": _with(f"SELECT path, count(*) AS chunks, sum(length(text))::BIGINT AS n FROM ({chunks_sql()}) GROUP BY path"),
        "strip_frontmatter": one("path, sha256(body) AS body_hash, raw", parsed_sql()),
        "fingerprints": one(f"path, content_hash, body_hash, frontmatter_hash, '{config}' AS chunking_config_hash, 'hash' AS embedding_model", parsed_sql()),
        "inline_tags": one("path, unnest(tags) AS tag", parsed_sql()),
        "tags_text": one("path, tags_text", parsed_sql()),
        "note_names": _with("SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS basename FROM notes"),
        "filter_tags_all": narrow("tags_text LIKE '%|lang/en|%' AND tags_text LIKE '%|src1|%'"),
        "filter_frontmatter_like": narrow("frontmatter_json LIKE '%\"rank\":1%'"),
        "filter_scalar": narrow("status = 'active' AND type = 'fr'"),
        "filter_where": narrow("position > 0 AND length(text) < 1000"),
        "allowed_paths_semi": narrow("path IN (SELECT path FROM notes WHERE status = 'active')"),
        "allowed_paths_empty": narrow("false"),
        "path_scan": _with(f"SELECT DISTINCT path FROM ({chunks_sql()})"),
        "decide_index": _with(decided_sql()),
        "index_stats": _with(f"""SELECT count(*) AS scanned, count(*) FILTER (decision IN ('missing', 'content-changed', 'config-changed')) AS embedded,
            count(*) FILTER (decision = 'metadata-only') AS metadata_only, count(*) FILTER (decision = 'unchanged') AS unchanged, 0::BIGINT AS removed FROM ({decided_sql()})"""),
        "metadata_update": _with(f"""SELECT k.id, k.path, CASE WHEN h.path IS NULL THEN k.status ELSE n.status END AS status,
            CASE WHEN h.path IS NULL THEN k.content_hash ELSE n.content_hash END AS content_hash, k.body_hash
            FROM ({KEPT_SQL()}) k LEFT JOIN (SELECT path FROM ({decided_sql()}) WHERE decision = 'metadata-only') h ON k.path = h.path
            LEFT JOIN ({parsed_sql()}) n ON h.path = n.path"""),
        "rename_paths": _with(f"""SELECT id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, basename
            FROM (SELECT * REPLACE (CASE WHEN starts_with(path, 'old/') THEN substr(path, 5) ELSE path END AS path) FROM ({KEPT_SQL()}))"""),
        "replace_paths": _with(f""", c AS ({changed}) SELECT id, path, sha256(text) AS text_hash FROM ({KEPT_SQL()}) WHERE path NOT IN (SELECT path FROM c)
            UNION ALL SELECT id, path, sha256(text) FROM ({chunks_sql()}) WHERE path IN (SELECT path FROM c)"""),
        "remove_missing": _with("SELECT DISTINCT path FROM earlier WHERE path NOT IN (SELECT path FROM notes)"),
        "queue_dedupe": "SELECT user_id::VARCHAR AS path, min(ts) AS enqueued_at, max(ts) AS updated_at, max(event_id) AS attempts FROM events GROUP BY user_id",
        "queue_stats": f"""SELECT count(*) FILTER (o IN ('embedded', 'metadata-only', 'unchanged', 'skipped')) AS processed, count(*) FILTER (o = 'embedded') AS embedded,
            count(*) FILTER (o = 'metadata-only') AS metadata_only, count(*) FILTER (o = 'unchanged') AS unchanged, count(*) FILTER (o = 'failed') AS failed,
            count(*) FILTER (o = 'queued') AS queued FROM (SELECT {OUTCOME} AS o FROM events)""",
        "status_counts": _with(f"SELECT count(*) AS chunks, count(DISTINCT path) AS paths FROM ({chunks_sql()})"),
        "render_scores": f"""SELECT id, CASE WHEN fused_score IS NULL THEN 'score ' || round(score::DECIMAL(18, 12), 3)::DECIMAL(18, 3)::VARCHAR
            ELSE 'rrf ' || round(fused_score::DECIMAL(18, 12), 4)::DECIMAL(18, 4)::VARCHAR || ' (' || concat_ws(' ', 'r' || round(rerank::DECIMAL(18, 12), 2)::DECIMAL(18, 2)::VARCHAR, 'v#' || vector_rank, 'bm25#' || lexical_rank) || ')' END AS label
            FROM ({LABELLED.replace("FROM fused", f"FROM (SELECT *, {RRF_SQL} AS fused_score FROM ({merged_sql()}))")})""",
        "excerpt": one("id, substr(text, 1, 700) AS excerpt", chunks_sql()),
        "path_query": """SELECT doc_id, regexp_matches(t, '^[\\s]*(LIST|TABLE|TASK|CALENDAR)([^A-Za-z0-9_]|$)', 'i') AS is_query FROM (
            SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' list ' WHEN 1 THEN 'TABLE' WHEN 2 THEN chr(10) || 'Calendar' || chr(10) WHEN 3 THEN 'task' ELSE '' END || coalesce(text, '') AS t FROM documents)""",
        "path_set_source": one("DISTINCT path", f"SELECT * FROM ({parsed_sql()}) WHERE (len(list_filter(tags, lambda t: lower(t) = 'lang/en' OR starts_with(lower(t), 'lang/en/'))) > 0 OR path IN ('src1', 'src1.md') OR starts_with(path, 'src1/')) AND NOT len(list_filter(tags, lambda t: lower(t) = 'src0' OR starts_with(lower(t), 'src0/'))) > 0"),
        "path_set_query": one("DISTINCT path", f"SELECT * FROM ({parsed_sql()}) WHERE len(list_filter(tags, lambda t: starts_with(lower(t), 'lang/'))) > 0 AND NOT starts_with(path, 'src2/') AND (doc_id % 20 >= 10 AND status = 'active' OR title = 'Note 3')"),
        "path_state": one(f"path, content_hash, body_hash, frontmatter_hash, '{config}' AS chunking_config_hash, 'hash' AS embedding_model, 64::BIGINT AS embedding_dim", f"SELECT * FROM ({parsed_sql()}) WHERE path IN (SELECT path FROM ({chunks_sql()}) WHERE position = 0)"),
        "filter_path": one("id, path", f"SELECT * FROM ({chunks_sql()}) WHERE path IN ('src1/en/1.md', 'src3/fr/3.md', 'src0/fr/0.md')"),
        "note_prepare": _with(prepared_sql()),
        "bm25_stored": found_sql(40),
        "service_search": _with(service_sql()),
    }
