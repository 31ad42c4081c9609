"""Document fingerprints from closed syncmers, by built-in functions only.

Words are the letters: a text's words (runs without white space), each folded to a
64-bit hash, with k-1 marks before and after. A run of k words is an anchor if the
smallest of the hashes of its inner runs of s words is the first or the last of
them. Whether a run is chosen depends on its own words alone, so an edit moves no
anchor elsewhere in the text. A fingerprint is the text's anchors in order, eight
hex digits each; the likeness of two is the Dice share of their distinct anchors.

One run in four is chosen (2 of k - s + 1), so a fingerprint is about a third as long
as its text.

Null text is an empty one; a text without words has the empty fingerprint, and two
empty fingerprints are alike (1.0). Very long texts cost time in proportion; repeated
rows have rows of their own, next to each other; other columns are left out; an empty
table has no rows, and of a table of one row that row is its own next.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import NULL_ID_FIRST, let, text_or_empty

K, S = 9, 2
SPACE = "[\\x20\\x09-\\x0D]+"


def word_hashes(text: Column, k: int = K) -> Column:
    """Hashes of the words, between k-1 marks on either side; empty where there are no words."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    marks = F.array_repeat(F.lit(0).cast("long"), k - 1)
    return let(words, lambda w: F.when(F.size(w) > 0, F.concat(marks, F.transform(w, lambda x: F.xxhash64(x)), marks)).otherwise(F.array().cast("array<bigint>")))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<at int, hash bigint>>: the closed syncmers in order, ``at`` in words."""
    inner = k - s

    def chosen(m: Column, i: Column) -> Column:
        at = [m[i + j] for j in range(inner + 1)]
        return F.least(at[0], at[-1]) <= F.least(*at[1:-1]) if inner > 2 else (F.least(at[0], at[-1]) <= at[1] if inner == 2 else F.lit(True))

    def of(h: Column) -> Column:
        n = F.size(h)
        smers = F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[h[i + j] for j in range(s)])) if s > 1 else h
        pick = let(smers, lambda m: F.transform(
            F.filter(F.sequence(F.lit(0), n - k), lambda i: chosen(m, i)),
            lambda i: F.struct((i - (k - 1)).alias("at"), F.xxhash64(*[m[i + j] for j in range(0, inner + 1, s)], h[i + k - 1]).alias("hash")),
        ))
        return F.when(n > 0, pick).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))

    return let(word_hashes(text, k), of)


def _hashes(text: Column, k: int = K, s: int = S) -> Column:
    return F.transform(anchors(text, k, s), lambda a: a["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice share of the distinct anchors of two fingerprints' hash arrays."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def positional_matches(left: DataFrame, right: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Pairs of documents with a shared anchor: doc_id, other_id, shift in words, matches.

    ``left`` is a stated query set and ``right`` all rows; both hold doc_id and text.
    Anchors join on their hash, so a passage that two documents share shows as many
    matches at one shift. Each query's row for each partner is part of the result;
    frequent anchors are rows of a sort-merge join, which Spark splits by size.
    """
    side = lambda d, name: d.select(F.col("doc_id").alias(name), F.explode(anchors(text_or_empty(), k, s)).alias("a")).select(name, F.col("a.at").alias(f"{name}_at"), F.col("a.hash").alias("hash"))
    return (
        side(left, "doc_id").join(side(right, "other_id"), "hash")
        .groupBy("doc_id", "other_id", (F.col("other_id_at") - F.col("doc_id_at")).alias("shift"))
        .agg(F.count(F.lit(1)).alias("matches"))
    )


def _ranged(rows: DataFrame, ends: list[int]) -> DataFrame:
    """Adds own, how many of the sorted ``ends`` are below ``id``, and run, those about it.

    An id passes whole runs of ends by their last, then the ends of one run.
    """
    wide = math.isqrt(len(ends)) + 1
    runs = [ends[i : i + wide] for i in range(0, len(ends), wide)] or [[]]
    fixed = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    below = lambda x: F.size(F.filter(x, lambda e: e < F.col("id")))
    rows = rows.withColumn("passed", below(fixed([r[-1] for r in runs[:-1]], "array<bigint>")))
    rows = rows.withColumn("run", F.get(fixed(runs, "array<array<bigint>>"), F.col("passed")))
    return rows.withColumn("own", F.col("passed") * wide + below("run")).drop("passed")


def with_next(docs: DataFrame, derived: dict[str, Column], parts: int | None = None) -> DataFrame:
    """doc_id, text, the derived columns of text, and next_<name> for text and each of them.

    Next is the document with the next lower doc_id; the highest follows the lowest.
    Documents are dealt to id ranges whose upper ends are ids in the table; the
    document at each upper end is also sent, as a guest, to the range above, so
    each range finds its own neighbours and texts shuffle once. Equal ids go by
    text; null ids come last, by hashes of their texts, so they fall into ranges too.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * n
    own_number = F.xxhash64(text_or_empty()).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(NULL_ID_FIRST)
    ided = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), own_number).alias("id"), text_or_empty().alias("text"))
    shares = ", ".join(f"{(i + 1) / parts!r}D" for i in range(parts))
    found = ided.agg(F.expr(f"percentile_approx(id, array({shares}), {10 * parts})")).first()[0] or []
    # Quantiles are doubles: the ends are the greatest ids up to them, and the greatest of all.
    ends = sorted(r[1] for r in _ranged(ided, sorted({*found})).groupBy("own").agg(F.max("id")).collect()) or [0]
    rows = _ranged(ided, ends)
    above = F.when(F.array_contains("run", F.col("id")), (F.col("own") + 1) % len(ends))
    rows = rows.withColumn("part", F.explode(F.array_compact(F.array(F.col("own"), above))) if len(ends) > 1 else F.col("own")).drop("run")
    rows = rows.repartition(n, "part").withColumns({"guest": F.col("own") != F.col("part"), **derived})
    order = Window.partitionBy("part").orderBy("guest", F.col("id").desc(), "text")
    first = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.lead(c).over(order) if len(ends) > 1 else F.coalesce(F.lead(c).over(order), F.first(c).over(first))
    return rows.withColumns({f"next_{c}": after(c) for c in ("text", *derived)}).where(~F.col("guest")).drop("own", "part", "guest", "id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, {"a": _hashes(F.col("text"))}).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "a", "next_a", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "a", "next_a", F.sha2("edited", 256).alias("edited_sha256"), _hashes(F.col("edited")).alias("b"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_a")).alias("near_next"),
    )
