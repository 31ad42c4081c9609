"""Operators against their definitions, written out plainly: one document, word, bit or block at a time."""

import hashlib
import math
import random
import struct
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, media, mixing, near, quality, sharding, simhash, syncmers, token_files, toxicity
from lodestone.llm.common import digits_for, numbered, ready, scratch, table_of
from tests.llm.test_operators import LONG, SCHEMA, reach, rows, sha


@pytest.fixture(scope="module")
def docs(spark):
    return ready(spark).createDataFrame(rows(), SCHEMA).repartition(3).cache()


def xx(data, seed=42):
    """XXH64 as a signed long."""
    h = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def chained(values):
    """The hash of several longs: each seeds the next."""
    h = 42
    for v in values:
        h = xx(struct.pack("<q", v), h)
    return h


def closed_syncmers(text, k=syncmers.K, s=syncmers.S):
    """(place, hash) of the runs of k words whose least run of s words is the first or the last."""
    words = [w for w in text.encode().split() if w]
    if not words:
        return []
    h = [0] * (k - 1) + [xx(w) for w in words] + [0] * (k - 1)
    out = []
    for i in range(len(h) - k + 1):
        inner = [chained(h[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i - (k - 1), chained([*inner[:: s], h[i + k - 1]])))
    return out


def dice(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints(docs):
    short = lambda t: [h & 0xFFFFFFFF for _, h in closed_syncmers(t)]
    text = lambda hs: "".join(f"{x:08x}" for x in hs)
    order = sorted([(r[0] if r[0] is not None else -1, r[1] or "") for r in rows()], key=lambda x: (-x[0], x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b = short(t), short(edited)
        want.append((d, len(t), sha(edited.encode()), text(a), text(b), round(dice(a, b), 12), round(dice(a, short(after)), 12)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in syncmers.fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)
    assert any(0 < w[5] < 1 for w in want) and any(w[6] == 1 and w[3] for w in want)
    words = [f"w{i}" for i in range(3000)]
    assert abs(len(closed_syncmers(" ".join(words))) / 3000 - 2 / (syncmers.K - syncmers.S + 1)) < 0.03


@pytest.mark.parametrize("parts", [1, 2, 40])
def test_neighbours_with_hot_and_missing_ids(spark, parts):
    """A third of the rows without an id, a third with one, and others; each has the next as its neighbour."""
    table = [(None, f"n{i}") for i in range(30)] + [(7, f"s{i}") for i in range(30)] + [((1 << 60) + i * 3, f"t{i}") for i in range(30)]
    out = syncmers.with_next(spark.createDataFrame(table, "doc_id long, text string"), {}, parts).collect()
    after = {(r.doc_id, r.text): (r.next_text) for r in out}
    assert len(out) == 90 and sorted(after.values()) == sorted(t for _, t in table)
    known = sorted([x for x in table if x[0] is not None], key=lambda x: (-x[0], x[1]))
    assert [after[x] for x in known[:-1]] == [t for _, t in known[1:]]
    assert after[known[-1]][0] == "n" and sum(v == known[0][1] and k[0] is None for k, v in after.items()) == 1 and None not in after.values()


def test_toxicity_scores(spark):
    """Documents' scores from the model's weights, a sentence and a word at a time."""
    rnd = random.Random(7)
    weight = np.array([rnd.gauss(0, 1) for _ in range(toxicity.BUCKETS // 64)] * 64)
    model = toxicity.Model(weight.astype(np.float32).astype(float), -2.0)

    def score(text):
        clean = 1 - toxicity.LEAK
        for sentence in (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
            words = {"".join(c for c in w if c.isalpha()).lower() for w in sentence.split()}
            if sentence.strip():
                z = model.bias
                for w in words - {""}:
                    z += sum(model.weight[zlib.crc32(x.encode()) % toxicity.BUCKETS] for x in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)])
                clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
        return 1 - clean

    texts = ["Some words. And s.o.m.e more, été!\n\n?", "a b\tc", None, "", "same", "same", "1 2 3", LONG[:2000]]
    table = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert got == {i: pytest.approx(score(t), abs=1e-6) for i, t in enumerate(texts)} and got[4] == got[5]
    assert toxicity.score(table.limit(0), model).columns == ["doc_id", "text", "score"]


def test_quality_features_and_scores(spark):
    """Buckets and scores, a word and an n-gram at a time."""
    spread = lambda code: (code * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - quality.BITS)

    def code(gram):
        out = 0
        for c in gram:
            out = out * 0x110000 + ord(c) + 1
        return out & (1 << 64) - 1

    def buckets(text):
        ws = text.split()
        h = [xxhash.xxh64_intdigest(w.encode()) for w in ws]
        out = []
        for w, x in zip(ws, h):
            out.append(spread(x))
            out += [spread(code(f"<{w}>"[i : i + g])) for g in (1, 2, 3) for i in range(len(w) + 3 - g)]
        return out + [spread(b - a & (1 << 64) - 1) for a, b in zip(h, h[1:])]

    rnd = np.random.default_rng(3)
    model = quality.Model(rnd.normal(size=quality.BUCKETS), 0.25)
    texts = ["été 漢字 😀", "one", "one one two", "", None, " \n", "to to to to to", LONG]
    for t, s in zip(texts, model.scores(texts)):
        own = buckets(t or "")
        assert s == pytest.approx(1 / (1 + math.exp(-(0.25 + (model.weight[own].mean() if own else 0)))))
    flat, many = quality.features(["été", "a"])
    assert flat.tolist() == [spread(xxhash.xxh64_intdigest("été".encode())), *[spread(code("<été>"[i : i + g])) for g in (1, 2, 3) for i in range(6 - g)], *buckets("a")] and many.tolist() == [13, 7]
    assert len(set(quality.bigrams(quality.hashes(["x", "x", "x"])).tolist()) | set(quality.bigrams(quality.hashes(["y", "y"])).tolist())) == 1
    table = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    assert [r.score for r in quality.score(table, model).orderBy("doc_id").collect()] == pytest.approx(list(model.scores(texts)))


def test_starts_of_documents_that_share_an_id(spark):
    """Each document's ids stand at its start in the files, end to end in their order."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a b c d e f g", "a", "a b c", "", "x y", "a b c", "some more words here", None]
    table = [(1, x) for x in texts] + [(None, x) for x in texts] + [(i, f"word {i} " * i) for i in range(2, 30)]
    out = token_files.write(spark.createDataFrame(table, "doc_id long, text string").repartition(4), path, scratch(spark, "ties"), parts=4)
    files = sorted(out_file for out_file in spark.read.orc(out).inputFiles())
    flat = [x for f in files for r in spark.read.schema(token_files.SCHEMA).orc(f).orderBy("row").collect() for x in r.ids]
    got = token_files.offsets(spark, out).collect()
    for r in got:
        own = flat[r.start : r.start + r.n_tokens]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and own[-1] == 2 and own.count(2) == 1
    coded = [(d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for d, x in table]
    assert sorted((str(r.doc_id), tuple(flat[r.start : r.start + r.n_tokens])) for r in got) == sorted((str(d), x) for d, x in coded)
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)
    assert token_files.lookup(spark, out, [5, 1]).count() == 1 + len(texts)
    plan = token_files.lookup(spark, out, [5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [5])]" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan


class Bits:
    """Entropy data a bit at a time; a restart drops the rest of a byte and the marker."""

    def __init__(self, data):
        self.data, self.at, self.have, self.n = data, 0, 0, 0

    def bit(self):
        if not self.n:
            self.have, self.n = self.data[self.at], 8
            self.at += 2 if self.have == 255 else 1
        self.n -= 1
        return self.have >> self.n & 1

    def number(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def signed(self, n):
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, codes):
        key = ""
        while key not in codes:
            key += str(self.bit())
        return codes[key]

    def restart(self):
        self.n = 0
        assert self.data[self.at] == 255 and 0xD0 <= self.data[self.at + 1] <= 0xD7
        self.at += 2


def huffman(counts, symbols):
    codes, code, left = {}, 0, iter(symbols)
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            codes[format(code, f"0{n}b")] = next(left)
            code += 1
        code <<= 1
    return codes


def decoded(raw):
    """(width, height, blocks) of a baseline JPEG of one component, by the book."""
    at, tables, quant, every, shape = 2, {}, {}, 0, None
    while True:
        kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            quant[body[0]] = list(body[1:65])
        elif kind == 0xC0:
            shape = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            every = int.from_bytes(body, "big")
        elif kind == 0xDA:
            break
    bits, dc, blocks = Bits(raw[at:]), 0, []
    for i in range(-(-shape[0] // 8) * -(-shape[1] // 8)):
        if every and i and i % every == 0:
            bits.restart()
            dc = 0
        block = [0] * 64
        dc += bits.signed(bits.symbol(tables[0]))
        block[0], k = dc, 1
        while k < 64:
            x = bits.symbol(tables[16])
            if not x:
                break
            k += x >> 4
            block[k] = bits.signed(x & 15)
            k += 1
        blocks.append(block)
    return *shape, blocks, quant[0]


def test_pictures_by_another_decoder(docs):
    texts = {r[0]: r[1] for r in rows()}
    got = [r for r in media.store(docs).collect() if len(r.media) < 20_000]
    digest = {r.doc_id: r for r in media.digests(docs).collect()}
    assert len(got) > 60
    for r in got:
        wide, high, blocks, quant = decoded(r.media)
        raw = bytes(c + 255 if c < 0 else c for b in blocks for c in b)
        payload = media.padded((texts[r.doc_id] or "").encode())
        assert raw[: len(payload)] == payload and set(raw[len(payload) :]) <= {255}
        grey = np.array([min(255, max(0, ((b[0] * quant[0] + 4) >> 3) + 128)) for b in blocks], np.uint8).reshape(high // 8, wide // 8)
        small = [[int(grey[y * grey.shape[0] // 8][x * grey.shape[1] // 8]) for x in range(8)] for y in range(8)]
        mean = sum(map(sum, small)) / 64
        mark = "".join(str(int(v > mean)) for line in small for v in line)
        want = f"{wide}x{high} {wide // 8}x{high // 8} {int(mark, 2):016x} {hashlib.blake2b(grey.tobytes(), digest_size=8).hexdigest()}"
        d = digest[r.doc_id]
        assert (d.feature, d.media_bytes, d.media_sha256) == (want, len(r.media), sha(r.media))


def test_lines_of_documents_without_ids(spark):
    line, other = "this line is long enough to count", "and this one is long enough as well"
    table = [(None, f"{line}\na"), (None, f"{line}\nb"), (None, f"{line}\nb"), (None, line), (5, f"{other}\nx"), (5, f"{other}\ny"), (6, other)]
    got = sorted(((r.doc_id or -1), r.text) for r in line_dedup.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect())
    # Three texts without an id hold the line (one of them twice): it stays in one of the three.
    assert sum(line in t for d, t in got if d == -1) in (1, 2) and sum(d == -1 and line not in t for d, t in got) >= 2
    assert [t for d, t in got if d > 0] == [f"{other}\nx", f"{other}\ny", other]


def test_scheduling_many_sources(spark):
    table = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 600).cast("string")).alias("source"), F.lit(1).alias("slot"))
    out = mixing.mixed(table, {f"s{i}": 1 + i % 70 for i in range(600)}, block_rows=4)
    assert out.columns == ["doc_id", "source", "block", "release", "deadline", "slot", "row_in_block", "weight_share"]
    blocks = out.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s")).agg(F.count(F.lit(1)), F.max("slot"), F.max("n"), F.max("s")).first()
    assert tuple(blocks) == (600 * 17, 600 * 17 - 1, 4, 1)
    late = out.where("slot > deadline").count()
    assert late == 0


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_partitions_follow_the_mixture(spark, parts):
    rnd = random.Random(parts)
    table = [(None if i % 9 == 0 else rnd.randrange(400), rnd.choice(["hot", "hot", "hot", "cold", None]), f"t{i % 50}", "x") for i in range(700)]
    docs = spark.createDataFrame(table, "doc_id long, source string, text string, part string").repartition(3)
    got = [(r.source, r.doc_id) for r in mixing.in_order(docs, {"hot": 3}, 4, parts).withColumn("m", F.monotonically_increasing_id()).orderBy("m").collect()]
    want = [(r.source, r.doc_id) for r in mixing.mixed(docs.select("doc_id", "source"), {"hot": 3}, block_rows=4).orderBy("slot", "row_in_block").collect()]
    assert got == want and mixing.in_order(docs).columns == docs.columns and mixing.in_order(docs.limit(0)).count() == 0


def test_numbers_in_parts(spark):
    table = spark.createDataFrame([("g" if i % 3 else "h", hashlib.md5(str(i // 2).encode()).hexdigest(), i) for i in range(500)], "g string, k string, i int")
    want = {}
    for d in (1, 2, 3):
        got = {(r.g, r.k, r.i): r.n for r in numbered(table, "g", "k", [F.col("i")], "n", d).collect()}
        want = want or {x: sorted(y for y in got if y[0] == x[0]).index(x) for x in got}
        assert got == want
    assert [digits_for(x, 100) for x in (0, 1600, 1601, 10**6)] == [1, 1, 2, 4]
    assert [tuple(r) for r in table_of(spark, [["a'\"", 1 << 40], ["\\é", 2]], "k string, n long").collect()] == [("a'\"", 1 << 40), ("\\é", 2)] and table_of(spark, [], "k string").count() == 0


def test_trie_leaves_of_unlike_depth(spark, monkeypatch):
    """A crowded prefix, so that some nodes are cut deep and meet shallow ones."""
    monkeypatch.setattr(simhash, "LEAST_LEAF", 8)
    monkeypatch.setattr(simhash, "MOST_LEAF", 8)
    rnd = random.Random(1)
    fps = sorted({rnd.getrandbits(64) for _ in range(60)} | {0xABCDEF << 40 | rnd.getrandbits(14) for _ in range(90)} | {rnd.getrandbits(4) for _ in range(30)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    cut = simhash.leaves(d, len(fps))
    assert cut.select("depth").distinct().count() > 1
    links = [(i, j) for i, j in combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    want = {k: v for k, v in reach(range(len(fps)), links).items() if any(k in x for x in links)}
    from lodestone.llm.components import components

    assert {r.node: r.root for r in components(simhash.trie_links(d)).collect()} == want


def test_simhash_of_128_bits_and_prefixes():
    h = near.shingles(" ".join(f"w{i}" for i in range(90)))
    mix = lambda x: (y := (x ^ x >> 31) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) ^ y >> 29
    for k, own in enumerate(([int(x) for x in h], [mix(int(x)) for x in h])):
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(own))
        assert int(near.simhash(h)[k]) & (1 << 64) - 1 == want
    hot = np.zeros(near.HOT_BITS // 8, np.uint8)
    late = h[:3]
    for x in late.tolist():
        hot[(x & near.HOT_BITS - 1) >> 3] |= 1 << (x & 7)
    got = near.prefix(h, hot).view(np.uint64)
    assert len(got) == len(h) - math.ceil(0.8 * len(h)) + 1 and got.tolist() == h[3:].tolist()[: len(got)]


def test_similar_texts_are_rarely_further_apart_than_the_budget():
    rnd, far = random.Random(5), 0
    for _ in range(400):
        n = rnd.choice([20, 60, 300])
        one = {rnd.getrandbits(64) for _ in range(n)}
        other = set(rnd.sample(sorted(one), n - n // 10)) | {rnd.getrandbits(64) for _ in range(n // 10)}
        a, b = (near.simhash(np.array(sorted(s), np.uint64)).view(np.uint64) for s in (one, other))
        bits = [int(x).bit_count() for x in a ^ b]
        far += bits[0] > near.BITS[0] or sum(bits) > near.BITS[1]
    assert far == 0


def test_hot_shingles_come_last_for_all(spark, monkeypatch):
    """A passage that all documents hold is marked, and near copies are still found."""
    rnd = random.Random(2)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = own(60)
    texts = [" ".join(own(60) + passage) for _ in range(40)]
    texts += [t + " and two more words" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    hot = near.hot_shingles(docs)
    marked = lambda h: sum(int(hot[(x & near.HOT_BITS - 1) >> 3] >> (x & 7) & 1) for x in h.tolist())
    assert marked(near.shingles(" ".join(passage))) > 10 and marked(near.shingles(" ".join(own(60)))) == 0
    assert near.blocks(near.sets(docs)).agg(F.max("g")).first()[0] <= near.MOST_MET
    group = {r.doc_id: r.g for r in simhash.similar(docs, "g").collect()}
    assert all(group[i] == group[40 + i] for i in range(5)) and len(set(group.values())) == 40


@pytest.mark.parametrize("most, bucket, few", [(2, (5, 400), 0), (2, (1024, 1 << 18), 1), (8, (7, 2000), 1000)])
def test_a_large_group_of_copies_far_and_near(spark, monkeypatch, most, bucket, few):
    """Copies of one text, with none to many words changed: some near the text, some near each other alone, some near none."""
    monkeypatch.setattr(near, "MOST_MET", most)
    monkeypatch.setattr(near, "BUCKET", bucket)
    near_few = near._few
    monkeypatch.setattr(near, "_few", lambda t: (setattr(near, "FEW", few), near_few(t))[1])
    rnd = random.Random(most + few)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        own = list(base)
        for k in rnd.sample(range(120), rnd.randrange(9)):
            own[k] = f"x{rnd.randrange(4)}"
        texts.append(" ".join(own))
    texts += [f"short text {i % 3} of a few words only {i % 5}" for i in range(20)]
    sets = [set(near.shingles(t).tolist()) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = reach(range(len(texts)), links)
    got = {r.doc_id: r.g for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "g").collect()}
    same = lambda of: {frozenset(i for i in of if of[i] == g) for g in of.values()}
    assert same(got) == same(want) and 5 < len(same(want)) < 95


def test_sharding_spreads_by_digits(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    out = sharding.shards(many).collect()
    for s in range(8):
        own = [(hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.slot) for r in out if r.shard == s]
        assert [n for _, n in sorted(own)] == list(range(len(own)))
