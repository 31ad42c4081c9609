"""Sharp edges, property tests and scenarios of the engine."""

import json
import random
import time
import urllib.error
import urllib.request

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.analysis import Analyzer, porter
from lodestone.functions.values import described, stable, strings
from lodestone.operators import filters, fusion, lexical, pathset, rerank
from lodestone.operators.chunk import slices
from lodestone.plans.api import Api, body_of, options_of, serve
from lodestone.plans.indexer import Indexer
from lodestone.plans.search import SearchService
from lodestone.plans.settings import CHUNKS, NOTES, SearchOptions, Settings, load_settings, number, save_settings
from lodestone.sources.models import HashEmbedder, HttpEmbedder, HttpReranker, join_url, post_json
from lodestone.sources.store import Conflict, Store
from lodestone.sources.vault import scan
from lodestone.streaming import queue


def spans(text, size, overlap):
    """Where chunks begin and end, from their definition: each begins a step after the one before."""
    step = max(1, size - overlap)
    starts = [i * step for i in range(len(text)) if i == 0 or i * step < len(text) and (i - 1) * step + size < len(text)]
    for s in starts:
        breaks = [k for k in range(s, s + size + 1) if text[k : k + 2] == "\n\n" and 2 * (k - s) > size]
        yield s, min(breaks[-1:] or [s + size]) if s + size < len(text) else len(text)


def cut(text, size, overlap):
    return [t for a, b in spans(text, size, overlap) if (t := text[a:b].strip())]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=120), min_size=1, max_size=40), st.integers(2, 30), st.integers(0, 35))
def test_chunks_are_as_defined(spark, texts, size, overlap):
    rows = spark.createDataFrame([(i, t.strip()) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", slices(F.col("t"), size, overlap).alias("c")).collect()}
    assert all(got[i] == cut(t.strip(), size, overlap) for i, t in enumerate(texts))


@pytest.mark.parametrize("content, body, raw", [
    ("", "", ""), ("text", "text", ""), ("---\na: 1\n---\nb", "b", "---\na: 1\n---"), ("---\r\na: 1\r\n---\r\nb", "b", "---\na: 1\n---"),
    ("---\n---\nb", "---\n---\nb", ""), ("---\na: 1\n---", "", "---\na: 1\n---"), ("---\na: 1\nb", "---\na: 1\nb", ""), ("---\na\n---foo\nb", "b", "---\na\n---foo"),
])
def test_front_matter(spark, content, body, raw):
    r = spark.createDataFrame([(content,)], "c string").select(X.body(F.col("c")).alias("b"), X.raw_frontmatter(F.col("c")).alias("r")).first()
    assert (r.b, r.r) == (body, raw)


def test_tags(spark):
    r = spark.createDataFrame([("#b x #a/1  #c_d # no ##e #café a#f #b",)], "c string").select(X.inline_tags(F.col("c")).alias("t")).first().t
    assert r == ["a/1", "b", "c_d", "caf"]


def test_lists_sort_as_people_do(spark):
    r = spark.createDataFrame([(["b", " B", "á", "a", "Z", "é", "a", "", "ß", "s", "t"],)], "t array<string>").select(X.unique(F.col("t")).alias("t")).first().t
    assert r == ["a", "á", "b", "B", "é", "s", "ß", "t", "Z"]


def test_values():
    assert strings(["My Note", ["x,y"], 3, True]) == ["My", "Note", "x", "y"]
    assert stable({"b": 1.0, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    assert list(json.loads(stable({k: 0 for k in ("b", "B", "á", "a", "Z", "é", "_x", "x_", "x", "10", "9")}))) == ["_x", "10", "9", "a", "á", "b", "B", "é", "x", "x_", "Z"]
    d = described("---\ntags: [a, '#b']\nalias: One Two\ndone: yes\nn: 1.0\nwhen: 2024-01-01\n---")
    assert d[0] == '{"tags":["a","#b"],"alias":"One Two","done":"yes","n":1,"when":"2024-01-01"}' and d[6] == ["a", "b"] and d[7] == ["One", "Two"]
    assert described("---\n: [\n---")[0] == "{}"


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("electriciti", "electr"), ("adoption", "adopt"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_filters(spark):
    rows = spark.createDataFrame([("a", "|my-tag|x|", '{"n":12,"s":"a\\"b"}', "true"), ("b", "|my_tag|", '{"n":1}', "")], "path string, tags_text string, frontmatter_json string, status string")
    ids = lambda **k: sorted(r.path for r in filters.narrowed(rows, **k).collect())
    assert ids(tags=("#MY_tag",)) == ["a", "b"] and ids(tags=("my_tag", "x")) == ["a"] and ids(tags=(" # ",)) == ["a", "b"]
    assert ids(fm={"n": 1}) == ["a", "b"] and ids(fm={"s": 'a"b'}) == ["a"] and ids(fm={"status": True}) == ["a"]
    assert ids(paths=rows.limit(0)) == [] and ids(paths=None) == ["a", "b"]
    assert ids(where="lower(path) IN ('a') AND status <> 'x' OR path BETWEEN 'b' AND 'c'") == ["a", "b"]
    assert [r.path for r in rows.where(filters.at_path("a")).collect()] == ["a"]
    for bad in ("1=1) OR (1=1", "path IN (SELECT 1)", "EXISTS (SELECT 1)", "reflect('java.lang.System', 'getProperty', 'user.home') <> ''", "java_method('a', 'b') = ''", "`reflect`('a', 'b') = ''", "system.builtin.reflect('a', 'b') = ''", "transform(array(1), x -> x)[0] = 1"):
        with pytest.raises(Exception):
            filters.narrowed(rows, where=bad)


def test_path_sets(spark):
    rows = spark.createDataFrame([("P/a.md", ["x"], "active", '{"n":3}'), ("b.md", ["x/y"], "old", '{"n":10}'), ("c.md", [], "active", "{}")], "path string, tags array<string>, status string, frontmatter_json string")
    p = pathset.NotesProvider(rows)
    names = lambda d: sorted(r.path for r in d.collect())
    assert names(p.by_source('#x or "P"')) == ["P/a.md", "b.md"] and names(p.by_source('-#x')) == ["c.md"]
    assert names(p.by_query('LIST FROM #x WHERE n > 5')) == ["b.md"] and names(p.by_query('table x where status = "active"')) == ["P/a.md", "c.md"]
    assert pathset.resolve(None, "#x", None) is None and pathset.resolve(p, " ", "") is None
    with pytest.raises(ValueError):
        p.by_query("DROP x")


def test_ranks_and_rerank(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([3.0, 3.0, 2.0, None])], "id int, s double")
    assert {r.id: r.k for r in fusion.competition_rank(rows, "s", "k").collect()} == {0: 1, 1: 1, 2: 3, 3: None}
    assert rerank.scores({"results": [{"score": 1}, {"index": 0, "relevance_score": 2}]}, 2) == {0: 2.0}
    assert rerank.scores({"oops": 1}, 2) is None


def test_connectors_and_settings():
    assert join_url("http://x/", "v1") == "http://x/v1"
    for reply in ({"data": [{"embedding": [1]}]}, {"embeddings": [[1]]}, {"embedding": [1]}):
        assert HttpEmbedder("u", "m", lambda *_, r=reply: r)(["a"]) == [[1]]
    with pytest.raises(ValueError):
        HttpEmbedder("u", "m", lambda *_: {})(["a"])
    assert number("x", 5, 1) == 5 and number(float("inf"), 5, 1) == 5 and number(-3, 5, 1) == 1
    assert load_settings({"chunk_size": 10, "odd": 1}).clamped().chunk_size == 300
    changed = Settings(rrf_k=7, use_lexical=False)
    assert load_settings(save_settings(changed)) == changed
    asked = []
    reranker = HttpReranker(join_url("http://x/", "v1"), "m", lambda *a: asked.append(a) or {"results": [{"index": 1, "score": 2}]})
    assert rerank.scores(reranker("q", ["a", "b"]), 2) == {1: 2.0} and asked == [("http://x/v1", {"model": "m", "query": "q", "documents": ["a", "b"]})]
    q, o = options_of({"query": 3, "limit": "x", "tags": ["a", 1], "frontmatter": [1], "where": 2})
    assert q == "" and o == SearchOptions(tags=("a",)) and body_of({"body": "x", "json": {"a": 1}}) == {"a": 1}


def _notes(spark, **texts):
    return spark.createDataFrame([(f"{k}.md", 1, len(v), v) for k, v in texts.items()], NOTES)


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 3))
def test_a_very_long_text_is_cut_in_time(spark, seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("abcdé😀 \n") for _ in range(1_000)) * 2_000
    began = time.time()
    got = spark.createDataFrame([(text.strip(),)], "t string").select(slices(F.col("t"), 1200, 180).alias("c")).first().c
    assert time.time() - began < 20 and got == cut(text.strip(), 1200, 180)


def test_indexing_and_search(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), CHUNKS)
    ix = Indexer(store, Settings(embedding_model="hash"), HashEmbedder())
    counts = lambda n, **k: tuple(ix.index(n, **k).first())
    assert store.read().count() == 0
    first = _notes(spark, a="---\nstatus: x\n---\nalpha beta #t", b="gamma delta", c="", d="one\ntwo")
    assert counts(first) == (4, 4, 0, 0, 0)
    assert counts(first) == (4, 1, 0, 3, 0)  # a note without chunks is always missing
    second = _notes(spark, a="---\nstatus: y\n---\nalpha beta #t", b="gamma epsilon", d="one\r\ntwo")
    assert counts(second, live=second) == (3, 2, 1, 0, 0)
    assert {r.path: r.status for r in store.read().collect()}["a.md"] == "y"
    assert counts(_notes(spark, a="---\nstatus: y\n---\nalpha beta #t"), live=second.where("path <> 'b.md'")) == (1, 0, 0, 1, 1)
    ix.rename(spark.createDataFrame([("d.md", "x/e.md")], "old_path string, new_path string"))
    moved = {r.path: r for r in store.read().collect()}
    assert set(moved) == {"a.md", "x/e.md"} and moved["x/e.md"].folder == "x" and moved["x/e.md"].id.startswith("d.md#")
    service = SearchService(store.read(), Settings(rerank_model="m", use_rerank=True), HashEmbedder(), rerank.overlap)
    hits = service.search("alpha beta").collect()
    assert hits[0].path == "a.md" and hits[0].rerank_rank == 1 and service.search("  ").count() == 0
    assert service.search("alpha", SearchOptions(limit=0)).count() == 1
    plain = SearchService(store.read(), Settings(use_lexical=False), HashEmbedder()).search("alpha beta").collect()
    assert plain[0].path == "a.md" and all(r.fts_score is None and r.lexical_rank is None and r.rerank_rank is None for r in plain)


def _rows(spark, *rows):
    return spark.createDataFrame([*rows], "path string, n int")


def _held(store):
    return sorted((r.path, r.n) for r in store.read().collect())


def test_a_change_leaves_other_parts_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), _rows(spark).schema, parts=8)
    assert store.commit(_rows(spark, *[(f"p{i}", i) for i in range(40)]), batch="b") == 1 == store.commit(_rows(spark), batch="b")
    was = store.pointer()["dirs"]
    only = _rows(spark, ("p7", -1))
    assert store.rewrite(only, lambda old: old.join(only.select("path"), "path", "left_anti").unionByName(only)) == 2
    now = store.pointer()
    assert len(was) == 8 and sum(was[p] != now["dirs"][p] for p in was) == 1 and now["batch"] == "b"
    assert _held(store) == sorted([(f"p{i}", i) for i in range(40) if i != 7] + [("p7", -1)])
    part = store.read(only)
    assert part.where("path = 'p7'").count() == 1 and 1 <= part.count() < 40 and len(part.inputFiles()) < len(store.read().inputFiles())
    with pytest.raises(ValueError):
        store.rewrite(only, lambda old: _rows(spark, *[(f"x{i}", i) for i in range(20)]))
    for i in range(3):
        store.rewrite(only, lambda old: old)
    assert len(_held(store)) == 40 and len(store.versions.numbers()) == store.keep
    assert store.rewrite(_rows(spark), lambda old: old) == store.pointer()["version"]
    store.rewrite(_rows(spark, *[(f"p{i}", i) for i in range(40)]), lambda old: old.limit(0))
    assert _held(store) == [] and store.pointer()["dirs"] == {}


@pytest.mark.parametrize("step", ["write", "create", "torn", "_forget"])
def test_a_commit_that_stops_anywhere_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path), _rows(spark).schema, keep=1)
    store.commit(_rows(spark, ("a", 1)))

    class Stop(Exception):
        pass

    def stop(*a, **k):
        raise Stop

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", stop)
        elif step == "create":
            m.setattr(store.files, "create", stop)
        elif step == "torn":
            real = store.files.create
            m.setattr(store.files, "create", lambda name, text: real(name, text[:9]) and stop())
        else:
            m.setattr(store, "_forget", stop)
        with pytest.raises(Stop):
            store.commit(_rows(spark, ("b", 2)))
    again = Store(spark, str(tmp_path), _rows(spark).schema, keep=1)
    assert _held(again) == ([("b", 2)] if step == "_forget" else [("a", 1)])
    again.commit(_rows(spark, ("c", 3)))
    assert _held(store) == [("c", 3)]


def test_an_append_keeps_all_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), _rows(spark).schema, parts=2)
    for i in range(4):
        store.append(_rows(spark, *[(f"p{k}", i) for k in range(9)]), batch=i)
    assert store.append(_rows(spark, ("x", 0)), batch=3) == 4
    assert _held(store) == sorted((f"p{k}", i) for k in range(9) for i in range(4)) and all(len(own) == 4 for own in store.pointer()["dirs"].values())
    store.compact(1)
    assert len(_held(store)) == 36 and all(len(own) == 1 for own in store.pointer()["dirs"].values())


def test_two_writers_do_not_both_win(spark, tmp_path):
    store = Store(spark, str(tmp_path), _rows(spark).schema)
    was = store.pointer()
    store.commit(_rows(spark, ("a", 1)))
    with pytest.raises(Conflict):
        store._commit(was, _rows(spark, ("b", 2)), list(range(was["parts"])), None)
    assert _held(store) == [("a", 1)]


def test_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path), _rows(spark).schema, parts=2)
    store.commit(_rows(spark, *[(f"p{i}", i) for i in range(40)]))
    files = lambda: [len([n for d in own for n in store.files.names(d) if n.endswith(".parquet")]) for own in store.pointer()["dirs"].values()]
    many = max(files())
    v = store.compact(1)
    assert len(_held(store)) == 40 and max(files()) == 1 and (v == 2 or many == 1) and store.compact(1) == v


TEXTS = {"a": "the cats running home", "b": "a cat runs", "c": "Dogs école", "d": "", "e": "running, running!"}


def _found(ix, query, allowed=None):
    return [tuple(r) for r in lexical.search(ix, query, None, allowed).collect()]


def test_a_kept_text_index_answers_like_the_live_one(spark, tmp_path, monkeypatch):
    table = lambda **t: spark.createDataFrame([*t.items()], "id string, text string")
    kept = lexical.StoredIndex(spark, str(tmp_path), parts=4)
    assert kept.index() is None and kept.refresh(table()) == 1 and _found(kept.index(), "cat") == []
    rows = table(**TEXTS)
    assert kept.refresh(rows) == 2 == kept.refresh(rows)
    same = lambda rows: all(_found(kept.index(), q) == _found(lexical.live(rows, q), q) for q in ("cat run", "ecole", "the", "running dog zebra"))
    assert same(rows) and _found(kept.index(), "run")
    more = table(**{k: v for k, v in TEXTS.items() if k != "e"}, f="new cats run and run", g="zebra")
    kept.refresh(more)
    assert same(more) and len(kept.state()["segments"]) == 3 and kept.state()["n_gone"] == 1
    kept.refresh(table(**TEXTS, f="new cats run and run", g="zebra"))  # e comes back
    assert same(table(**TEXTS, f="new cats run and run", g="zebra"))
    kept.refresh(table(b="a cat runs"))  # most are gone
    assert same(table(b="a cat runs")) and len(kept.state()["segments"]) == 1
    other = lexical.StoredIndex(spark, str(tmp_path), Analyzer(stem=False), parts=4)
    assert other.index() is None and other.rebuild(rows) and _found(other.index(), "running") == _found(lexical.live(rows, "running", Analyzer(stem=False)), "running")


def test_a_search_reads_its_terms_folders_alone(spark, tmp_path):
    kept = lexical.StoredIndex(spark, str(tmp_path), parts=16)
    kept.rebuild(spark.createDataFrame([(i, " ".join(f"word{k}" for k in range(i, i + 30))) for i in range(200)], "id long, text string"))
    out = lexical.search(kept.index(), "word40", 5)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part#" in plan.split("PartitionFilters")[1][:200]
    files = sum(1 for _ in (tmp_path / "segments").rglob("part=*"))
    assert files > 8


class Moody:
    """A model that has no vectors for some texts."""

    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("no vector for that")
        return HashEmbedder()(texts)


def test_queue(spark, tmp_path):
    q = queue.Queue(spark, str(tmp_path / "q"))
    kept = lexical.StoredIndex(spark, str(tmp_path / "lex"), parts=4)
    ix = Indexer(Store(spark, str(tmp_path / "t"), CHUNKS), Settings(embedding_model="hash"), Moody(), kept)
    table = {"now": _notes(spark, a="alpha", b="a bad one", c="gamma")}
    run = lambda: q.start(lambda: table["now"], ix, {"availableNow": True}, retry_seconds=0).awaitTermination()
    paths = lambda: sorted(r.path for r in ix.store.read().collect())
    assert q.status() == {"processed": 0, "embedded": 0, "metadata_only": 0, "unchanged": 0, "failed": 0, "queued": 0, "last_error": ""}
    q.add(["a.md", "a.md", "b.md", "gone.md", "x.txt"], "2024-01-01")
    q.add(["c.md"], "2024-01-02")
    assert [r.path for r in q.pending().collect()] == ["a.md", "b.md", "gone.md", "c.md"]
    run()
    assert paths() == ["a.md", "c.md"] and kept.index() is None
    (left,) = q.pending().collect()
    assert (left.path, left.enqueued_at, left.attempts, left.last_error) == ("b.md", "2024-01-01", 1, "no vector for that")
    assert q.status() == {"processed": 3, "embedded": 2, "metadata_only": 0, "unchanged": 0, "failed": 1, "queued": 1, "last_error": "no vector for that"}
    run()
    assert q.pending().first().attempts == 2
    q.add(["b.md"])  # the note has been mended
    table["now"] = _notes(spark, a="alpha", b="beta", c="gamma")
    run()
    assert paths() == ["a.md", "b.md", "c.md"] and q.status()["queued"] == 0 and q.status()["last_error"] == ""
    assert kept.index().n_docs == 3  # drained
    table["now"] = _notes(spark, a="alpha", d="beta", e="late")
    q.renamed(ix, spark.createDataFrame([("b.md", "d.md")], "old_path string, new_path string"))
    assert paths() == ["a.md", "c.md", "d.md"] and [r.path for r in q.pending().collect()] == ["d.md"]
    q.add_all(ix, table["now"])
    assert paths() == ["a.md", "d.md"] and q.pending().count() == 3
    run()
    assert paths() == ["a.md", "d.md", "e.md"] and ix.status() == {"chunks": 3, "paths": 3}
    assert q.removed(ix, _notes(spark, a="")) == 2 and paths() == ["a.md"]
    with pytest.raises(RuntimeError, match="no vector"):
        ix.index(_notes(spark, x="bad", y="good"))
    assert paths() == ["a.md", "y.md"] and ix.rebuild_lexical() and kept.index().n_docs == 2


def test_requests(spark, tmp_path):
    q = queue.Queue(spark, str(tmp_path / "q"))
    kept = lexical.StoredIndex(spark, str(tmp_path / "lex"), parts=4)
    ix = Indexer(Store(spark, str(tmp_path / "t"), CHUNKS), Settings(embedding_model="hash"), HashEmbedder(), kept)
    notes = _notes(spark, a="---\nn: 1\n---\nalpha beta #t", b="gamma")
    service = lambda: SearchService(ix.store.read(), Settings(), HashEmbedder(), provider=pathset.NotesProvider(ix.store.read()), index=kept)
    api = Api(service, ix, q, lambda: notes)
    assert api.search({"body": {"query": "alpha"}}) == {"results": []}
    out = api.reindex()
    assert out["index"] == {"chunks": 0, "paths": 0} and out["queue"]["queued"] == 2
    q.start(lambda: notes, ix, {"availableNow": True}).awaitTermination()
    hits = api.search({"json": {"query": "alpha", "limit": 1e300, "frontmatter": {"n": 1}, "tags": ["t"], "where": "position = 0"}})["results"]
    assert [(h["path"], h["frontmatter"], h["lexical_rank"], h["vector_rank"]) for h in hits] == [("a.md", {"n": 1}, 1, 1)]
    assert api.search({"body": {"query": " "}}) == {"results": []}
    bad = api.search({"body": {"query": "x", "where": "reflect('a', 'b') = ''"}})
    assert bad["status"] == 500 and "reflect" in bad["error"]
    assert [h["path"] for h in api.search({"body": {"query": "alpha", "dataviewSource": '"nowhere"', "dataviewQuery": "LIST FROM -#t"}})["results"]] == ["b.md"]
    assert [h["path"] for h in service().search("alpha", SearchOptions(allowed_paths=notes.where("path = 'b.md'"), path_query="LIST FROM #t")).collect()] == ["b.md"]
    assert api.status()["index"] == {"chunks": 2, "paths": 2}
    server = serve(api)
    url = f"http://127.0.0.1:{server.server_port}/lookup"
    assert post_json(f"{url}/search/", {"query": "gamma", "limit": 1})["results"][0]["path"] == "b.md"
    assert json.load(urllib.request.urlopen(f"{url}/status/")) == api.status()
    for path, body, code in (("search", b"{", 400), ("search", b'{"query": "x", "where": "EXISTS (SELECT 1)"}', 500), ("nowhere", b"{}", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(f"{url}/{path}/", body))
        assert e.value.code == code and json.load(e.value)["ok"] is False
    server.shutdown()


def test_vault(spark, tmp_path):
    (tmp_path / "sp ace").mkdir()
    (tmp_path / "sp ace" / "a+b.md").write_bytes(b"x\r\ny")
    (tmp_path / "c.txt").write_text("no")
    assert [(r.path, r.content) for r in scan(spark, str(tmp_path)).collect()] == [("sp ace/a+b.md", "x\r\ny")]
