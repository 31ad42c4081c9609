"""Operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, line_dedup, media, mixing, quality, sharding, simhash, syncmers, token_files, toxicity, training
from lodestone.llm.common import ready, scratch
from lodestone.llm.components import components

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LONG = "lorem ipsum dolor " * 20_000
LINE = "a line that is long enough to count"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, id long"


def rows():
    rnd = random.Random(5)
    words = "the of and zu être ñandú 漢字 😀 don't 12 a\tb  x".split(" ")
    texts = [None, "", " ", "\n", "one", LONG, f"{LINE}\nshort", f"  {LINE.upper()}\t\nother", f"{LINE}\n{LINE}", "one"]
    texts += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) for _ in range(60)]
    base = [rnd.choice(words) + str(rnd.randrange(9)) for _ in range(200)]
    texts += [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(0, 200, 20)] + [" ".join(base)] * 3
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "k", i) for i, t in enumerate(texts)]
    return out + [out[5], out[6], (None, LINE, None, None, 0, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return ready(spark).createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_bpe_equals_the_library(docs, empty):
    import tiktoken

    v = bpe.vocabulary(RANKS)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, RANKS, P.PATTERN).collect())
    want = sorted((r[0] or -1, len(ids := lib.encode_ordinary(r[1] or "")), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())) for r in rows())
    assert got == want
    assert bpe.decode(bpe.encode(empty, RANKS, P.PATTERN), RANKS).count() == 0
    assert "lang" not in bpe.encode(docs, RANKS, P.PATTERN, out="LANG").columns


def test_bpe_on_odd_strings():
    import tiktoken

    v, rnd = bpe.vocabulary(RANKS), random.Random(1)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    parts = ["a", "aaaa", "'s", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "世", "😀", "19", "!?", "the", "Ⅷ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    assert bpe._store(RANKS, P.PATTERN).column(pa.array(texts)).to_pylist() == [lib.encode_ordinary(t) for t in texts]
    for word in ("ab" * 3000, "".join(rnd.choice("abcdefgh") for _ in range(5000)), "the" * 999 + "é"):
        assert v.word(word.encode()) == bpe.replay([word.encode()], v)[0].tolist() == lib.encode_ordinary(word)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(12))) for _ in range(500)]
    ids, counts = bpe.replay(words, v)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [v.word(w) for w in words]


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def kept_lines(table):
    """Each row's lines that stay. A row without an id is a document of its own, by its text, below all others."""
    seen, out = {}, []
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").encode().lower().decode() for x in (t or "").split("\n")]
    known = lambda r: (signed_hash(r[1] or "") & (1 << 62) - 1) - (1 << 63) if r[0] is None else r[0]
    for r in table:
        for k in keys(r[1]):
            if len(k) >= 20:
                seen.setdefault(k, set()).add(known(r))
    for r in table:
        lines = (r[1] or "").split("\n")
        out.append([x for x, k in zip(lines, keys(r[1])) if not (len(seen.get(k, ())) >= 3 and max(seen[k]) != known(r))])
    return out


def test_line_dedup(docs, empty):
    table, want = rows(), []
    for r, kept in zip(table, kept_lines(table)):
        n = len((r[1] or "").split("\n"))
        want.append((r[0] or -1, n, n - len(kept), sha("\n".join(kept).encode())))
    got = [(r.doc_id or -1, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.report(docs).collect()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
    assert line_dedup.dedup(docs).columns[:7] == docs.columns and line_dedup.report(empty).count() == 0


def test_toxicity_and_quality(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice("der die das und ein mit von zu auf für".split()) + rnd.choice("abcdefgh")
    texts, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        ws = [[word() for _ in range(9)] for _ in range(6)]
        if bad:
            ws[i % 6][3] = rnd.choice(["nasty", "awful"])
        texts.append((i, ". ".join(" ".join(w) for w in ws)))
        marks.append((i, 0 if i % 4 == 0 else 1, int(bad)))
    texts = [(i, t + (" &&& $$$ !!" * 20 if marks[i][1] == 0 else "")) for i, t in texts] + [(1000, None), (1001, ""), (1002, LONG)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    for mod, k in ((toxicity, 2), (quality, 1)):
        out = {r.doc_id: r for r in mod.report(docs, labels).collect()}
        held = [i for i in range(400) if out[i].held_out]
        assert len(out) == 403 and held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
        # 300 documents teach noisy-or which words are toxic sooner than which are not: none is missed.
        assert all(out[i].predicted for i in held if marks[i][k])
        assert sum(out[i].predicted == marks[i][k] for i in held) / len(held) > (0.8 if mod is toxicity else 0.95)
        assert all(0 <= r.score <= 1 for r in out.values()) and out[1000].score == out[1001].score
    found = toxicity.offending(docs, toxicity.fitted(docs, labels), 0.8).collect()
    assert found and sum("nasty" in r.text or "awful" in r.text for r in found) / len(found) > 0.8
    assert mod.report(docs, labels.limit(0)).count() == 403 and mod.report(docs.limit(0), labels).count() == 0


def test_syncmers(docs, empty):
    got = syncmers.fingerprints(docs).collect()
    order = sorted([(r[0] if r[0] is not None else -1, r[1] or "") for r in rows()], key=lambda x: (-x[0], x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        half = len(t) // 2
        want.append((d, len(t), sha((t[: len(t) - half] + order[(i + 1) % len(order)][1][:half]).encode())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[4] == by[9] and by[0] == by[1] == {""} and len(by[5]) == 1
    assert syncmers.fingerprints(empty).count() == 0 and syncmers.fingerprints(docs.where("doc_id = 5").limit(1)).count() == 1


def test_syncmers_are_context_free(spark):
    words = [f"w{i}" for i in range(60)]
    a = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    b = spark.createDataFrame([(2, "x y z " + " ".join(words[20:50]))], "doc_id long, text string")
    best = syncmers.positional_matches(a, b).orderBy(F.desc("matches")).first()
    assert best["shift"] == 3 - 20 and best.matches > 5


def fingerprint(text):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_simhash(docs, empty):
    fps = {(9999 if r[0] is None else r[0]): fingerprint(r[1]) for r in rows()}
    want = reach(fps, [(a, b) for a, b in combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    for r in simhash.report(docs).collect():
        d = 9999 if r.doc_id is None else r.doc_id
        assert r.fingerprint == f"{fps[d]:016x}" and (r.component_id if r.component_id is not None else 9999) == want[d]
    assert simhash.report(empty).count() == 0


def test_simhash_of_rows_without_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    table = [(3, a), (9, b), (None, a), (None, b), (None, "alone"), (None, "by itself"), (7, "x y"), (7, "z")]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.clusters(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    signed = lambda t: int.from_bytes(simhash.fingerprint_bytes(t), "big", signed=True)
    want = [3, 9, 3, 9, None, None, 7, 7]
    assert got == {(d, signed(t)): w for (d, t), w in zip(table, want)}


def test_trie_join_on_clusters(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(simhash, "LEAST_LEAF", 16)
    seeds = [rnd.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = sorted({s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (1 << 64) - 1 for s in seeds for _ in range(60)} | {rnd.getrandbits(64) for _ in range(200)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    links = [(i, j) for i, j in combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    want = {k: v for k, v in reach(range(len(fps)), links).items() if any(k in x for x in links)}
    assert {r.node: r.root for r in components(simhash.trie_links(d)).collect()} == want


def test_mixing(docs, empty):
    out = mixing.mixed(docs, {"s0": 3, "s1": 2}, block_rows=4).collect()
    assert len(out) == len(rows())
    slots = {(r.source, r.block): r.slot for r in out}
    assert sorted(slots.values()) == list(range(len(slots)))
    for w in ([1], [3, 2, 1, 1], [9, 1, 5, 7], [1] * 8):
        laid, done = mixing.period(w), [0] * len(w)
        assert sorted(laid) == sorted(i for i, n in enumerate(w) for _ in range(n))
        for t, i in enumerate(laid):
            done[i] += 1
            assert all(abs(n - x * (t + 1) / sum(w)) < 1 for n, x in zip(done, w))
    assert mixing.mixed(empty).count() == 0 and mixing.in_order(docs).columns == docs.columns
    assert mixing.in_order(docs).count() == len(rows())


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want, start = [], 0
    coded = sorted((-1 if r[0] is None else r[0], 42 if r[1] is None else signed_hash(r[1]), [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows())
    for d, _, ids in coded:
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = token_files.write(docs, path, scratch(spark, "t"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.offsets(spark, out).collect())
    assert got == want
    assert token_files.lookup(spark, out, [4]).first().ids == [*t.encode("one", add_special_tokens=False).ids, 2]
    assert token_files.report(empty, path).count() == 0


def test_media(docs, empty):
    for r in media.digests(docs).collect():
        raw = next((x[1] or "").encode() for x in rows() if x[0] == r.doc_id)
        padded = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-32:]))
    assert media.digests(empty).count() == 0
    with pytest.raises(ValueError):
        media.parse(b"no picture")


def test_jpeg_from_another_encoder():
    """A 16 x 16 grey picture of one scan without restarts, in the standard's example tables."""
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
    ac = bytes([1] + [0] * 15) + b"\0"  # only the end of a block
    bits = "100" + "101" + "0" + "00" + "0" + "00" + "0" + "00" + "0"  # category 3: 5
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    raw = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\x08" * 64) + media._segment(0xC0, b"\x08\0\x10\0\x10\1\1\x11\0") + media._segment(0xC4, b"\0" + dc + b"\x10" + ac) + media._segment(0xDA, b"\1\1\0\0\x3f\0") + data + b"\xff\xd9"
    (p,) = media.read_many([raw])
    assert media.thumbnail(p).tolist() == [[133, 133], [133, 133]]


def test_sharding(docs, empty):
    out = sharding.shards(docs).collect()
    assert len(out) == len(rows()) and all(r.grown_shard in (r.shard, 8) for r in out)
    for s in range(8):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    by = {r.doc_id: r for r in out}
    assert by[0].size == 1 and by[0].text_crc32 == 0 and by[4].text_crc32 == zlib.crc32(b"one")
    assert sharding.shards(empty).count() == 0
    many = docs.sparkSession.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sizes = [r["count"] for r in sharding.shards(many, layout=sharding.tree(8, weights={0: 2.0})).groupBy("shard").count().orderBy("shard").collect()]
    assert abs(sizes[0] / 8000 - 2 / 9) < 0.02 and max(abs(x / 8000 - 1 / 9) for x in sizes[1:]) < 0.02


def test_the_sample_holds_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, "a" * (i % 9 + 1)) for i in range(500)] + [(2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1), (8, 1)], "doc_id long, toxic int")
    texts, y = training.sample(docs, labels, "toxic", 10, 1000)
    allowed = [(t, v) for d, t, v in ((1, "a" * 9, 1.0), (3, "c", 0.0)) if zlib.crc32(str(d).encode()) % 4 != training.HELD_OUT]
    assert list(zip(texts, y.tolist())) == allowed


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, rows without ids, and columns whose names clash."""
    import corpus_pipeline as c
    import pyarrow.parquet as pq
    import tiktoken

    rnd = random.Random(8)
    clean = lambda n: " ".join(rnd.choice("der die das und ein mit von zu".split()) + rnd.choice("abcdefgh") for _ in range(n))
    shared = [clean(9) for _ in range(3)]
    table, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        table.append((i, (" &&& $$$ !!" * 20 if bad else clean(60) + "\n" + shared[i % 3] + "\n" + clean(5)), f"s{i % 3}"))
        marks.append((i, int(not bad)))
    texts = [t for i, t, _ in table if i % 4]
    table += [(400, None, None), (401, "", "s0"), (402, clean(60_000), "s0"), (403, texts[0], "s1"), (404, texts[1].replace(" ", "  "), None)]
    table += [table[5], (None, texts[2], "s2"), (None, clean(70), "s2"), (None, clean(70), "s2"), (None, None, None)]
    table.append(table[-2])
    more = ["score", "n_lines", "n_dropped", "block", "slot", "ids", "decoded", "fp", "a.b", "__score"]
    full = [(i, t, "de", s, len(t or ""), *range(len(more))) for i, t, s in table]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{m}` int" for m in more)
    spark.createDataFrame(full, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = lambda xs: sorted(xs, key=repr)
    seen = lambda d: [(r.doc_id, r.text, r.source) for r in d.collect()]

    def step(n, docs):
        c.STAGES[n][1](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        assert n == 4 or (out.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(more))) for r in out.collect()))
        return out

    m = quality.fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    score = lambda text: m.scores([text])[0]  # noqa: E731 - of whose parts test_definitions.py has the brute force
    docs = step(0, docs)
    assert order(seen(docs)) == order(r for r in table if score(r[1]) >= c.LEAST_QUALITY) and 200 < docs.count() < len(table)

    before = seen(docs)
    docs = step(1, docs)
    want = [(r[0], r[1] if r[1] is None else "\n".join(k), r[2]) for r, k in zip(before, kept_lines(before))]
    assert order(seen(docs)) == order(want) and order(want) != order(before)
    assert all(r.n_chars == len(r.text or "") for r in docs.collect())

    before = seen(docs)
    docs = step(2, docs)
    fps = [fingerprint(t) for _, t, _ in before]
    root = reach(range(len(before)), [(i, j) for i, j in combinations(range(len(before)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(before[i])
    got = seen(docs)
    assert len(got) == len(groups) < len(before)
    for own in groups.values():
        ids = [x[0] for x in own if x[0] is not None]
        assert sum(x in got for x in {(r[0], r[1], r[2]) for r in own if r[0] == (min(ids) if ids else None)}) == 1

    before = seen(docs)
    docs = step(3, docs)
    names = sorted({"" if s is None else f"={s}" for _, _, s in before})
    queue = {k: sorted((r for r in before if ("" if r[2] is None else f"={r[2]}") == k), key=lambda r: hashlib.md5(str("" if r[0] is None else r[0]).encode()).digest()) for k in names}
    laid, want, t = mixing.period([mixing.PRODUCTION_WEIGHTS.get(k[1:], 1) for k in names]), [], 0
    while any(queue.values()):
        k = names[laid[t % len(laid)]]
        want += [(r[0], r[2]) for r in queue[k][: mixing.PRODUCTION_BLOCK]]
        queue[k], t = queue[k][mixing.PRODUCTION_BLOCK :], t + 1
    files = [pq.read_table(f, columns=["doc_id", "source"]).to_pylist() for f in sorted((tmp_path / "3").glob("*.parquet"))]
    assert [(r["doc_id"], r["source"]) for f in files for r in f] == want and order(seen(docs)) == order(before)

    before = seen(docs)
    out = step(4, docs)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS).ranks, special_tokens={})
    want = order((d, s, lib.encode_ordinary(t or "")) for d, t, s in before)
    assert order((r.doc_id, r.source, list(r.ids)) for r in out.collect()) == want and all(r.intact and r.n_tokens == len(r.ids) for r in out.collect())
    assert order((r.doc_id, r.source, list(r.ids)) for r in c.run(spark, str(tmp_path)).collect()) == want


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = c.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns and 0 < first.count() <= 200
    out = c.run(spark, sf)
    assert out.where("not intact").count() == 0 and 0 < out.count() <= 200
    none = docs.limit(0)
    for _, stage in c.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0


def five_word_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set()) for w in words]


def near_pairs(texts):
    sets = five_word_sets(texts)
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    return [(i, j) for i, j in combinations(range(len(texts)), 2) if alike(sets[i], sets[j])]


@pytest.mark.parametrize("most", [64, 2])
def test_pipeline_drops_all_near_copies(spark, monkeypatch, most):
    """Copies with words changed, at and about five-word Jaccard 0.8, which SimHash links of two bits miss."""
    import corpus_pipeline as c
    from lodestone.llm import near

    monkeypatch.setattr(near, "MOST_MET", most)
    monkeypatch.setattr(near, "BUCKET", (4, 300))
    rnd, texts = random.Random(4), [None, "", "a b", "A  b", "a b c", "p q r s t u v w", "p q r s t u v w x"]
    for _ in range(40):
        ws = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(30, 200))]
        texts.append(" ".join(ws))
        for _ in range(3):
            other = list(ws)
            for k in rnd.sample(range(len(ws)), rnd.randrange(1, 4)):
                other[k] = f"x{rnd.randrange(9)}"
            texts.append(" ".join(other))
    texts += [texts[7] + " and then some more words", "one two three four five six " + texts[8]]
    links = near_pairs(texts)
    root = reach(range(len(texts)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in c.near_dedup(spark, docs, "").collect()) == sorted(set(root.values()))
    fps = [fingerprint(t) for t in texts]
    assert sum(bin(fps[i] ^ fps[j]).count("1") > 2 for i, j in links) > 20


def test_toxicity_of_forms_never_seen():
    """Each toxic word is a form of its own of a few stems, as in inflected languages."""
    rnd = random.Random(6)
    tail = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    clean = ["".join(rnd.choice("klmnopqrs") for _ in range(3)) + tail() for _ in range(300)]

    def text(bad):
        ws = [[rnd.choice(clean) for _ in range(9)] for _ in range(5)]
        if bad:
            ws[rnd.randrange(5)][4] = rnd.choice(["zuvorn", "Wyxal", "Ütqué"]) + tail()
        return ". ".join(" ".join(w) for w in ws)

    y = np.array([float(i % 5 == 0) for i in range(2000)])
    texts = [text(v) for v in y]
    model = toxicity.train(texts[:1600], y[:1600])
    found = model.scores(toxicity.Words(), texts[1600:]) >= toxicity.SPLIT
    assert found[y[1600:] > 0].mean() > 0.9 and found[y[1600:] == 0].mean() < 0.1
    words = toxicity.Words()
    one = [model.scores(words, [t])[0] for t in [None, *texts[1600:1640]]]
    assert np.allclose(one[1:], model.scores(toxicity.Words(), texts[1600:1640])) and one[0] == pytest.approx(toxicity.LEAK)


def test_pipeline_keeps_the_mixture_order_to_the_end(spark, tmp_path):
    """A hot source, and texts so unlike in length that files are not read in the order of their names."""
    import corpus_pipeline as c
    import pyarrow.parquet as pq

    rnd = random.Random(9)
    table = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([2, 20, 2000 if i % 7 == 0 else 9]))), "en", "src0" if i % 10 < 7 else f"src{i % 3 + 1}") for i in range(900)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    names = sorted({r[3] for r in table})
    queue = {k: sorted((r[0] for r in table if r[3] == k), key=lambda d: hashlib.md5(str(d).encode()).digest()) for k in names}
    laid, want, t = mixing.period([mixing.PRODUCTION_WEIGHTS.get(k, 1) for k in names]), [], 0
    while any(queue.values()):
        k = names[laid[t % len(laid)]]
        want += queue[k][: mixing.PRODUCTION_BLOCK]
        queue[k], t = queue[k][mixing.PRODUCTION_BLOCK :], t + 1
    out = c.run(spark, str(tmp_path))
    assert [(r.slot, r.doc_id) for r in out.collect()] == list(enumerate(want))
    files = [pq.read_table(f.removeprefix("file://"), columns=["doc_id"]).column(0).to_pylist() for f in sorted(out.inputFiles())]
    assert [d for f in files for d in f] == want and len(files) > 1


def test_distinct_texts_under_one_id_stay(spark):
    import corpus_pipeline as c

    rnd = random.Random(3)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    a, b, d = text(80), text(80), text(80)
    table = [(1, a), (2, a + " end"), (2, b), (2, d), (2, d), (5, b.upper()), (None, d), (None, "own"), (None, "words"), (None, "words")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in c.near_dedup(spark, docs, "").collect())
    assert got == sorted([(1, a), (2, b), (2, d), (-1, "own"), (-1, "words")])


def test_a_long_text_does_not_end_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * (200 if i % 3 == 0 else 10)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    texts, y = training.sample(docs, labels, "toxic", 80, 100)
    assert texts == ["x" * 10] * 10 and len(y) == 10
