"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` documents. Block j (from 1) of a
source with integer weight w, the weights adding up to W, is released at
floor((j-1)W/w) and due at ceil(jW/w); at every slot the released block with the
earliest deadline goes next, so at any moment each source has had within one block
of its share. As these times repeat after W slots, one period of the schedule is
laid out once, W integers, and is a table that blocks join. The slots of sources that
have run out are closed up by numbering the blocks that there are, round by round, so
the others go on in their proportions and no row is dropped.

Native: the rows meet only DataFrame functions; the driver holds a row a source and a
number a slot of the period, however many there are. Null sources form a source of
their own, with the default weight; ties and repeated rows get places of their own
in the md5 order of doc_id; other columns, whatever their names, are carried along;
texts, however long, are not looked at; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import columns, digits_for, fresh, located, numbered, spread_key, table_of, written

PRODUCTION_WEIGHTS = {"src0": 4}
PRODUCTION_BLOCK = 64
#: Blocks that a row of numbers unfolds to at a time; rounds whose sizes one task adds up.
UNFOLDED, SUMMED = 4096, 4096


def period(weights: list[int]) -> list[int]:
    """Which source has each slot of one period: earliest deadline among released blocks."""
    import heapq

    if not weights or min(weights) < 1:
        raise ValueError("weights are positive integers")
    total = sum(weights)
    due = lambda i, j: -(-j * total // weights[i])
    waiting = [(0, i, 1) for i in range(len(weights))]
    released: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(released, (due(i, j), i, j))
        _, i, j = heapq.heappop(released)
        out.append(i)
        if j < weights[i]:
            heapq.heappush(waiting, (j * total // weights[i], i, j + 1))
    return out


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


class Plan:
    """What the rows' sources and their weights settle: shares, turns within a period, and each block's slot."""

    def __init__(self, keys: DataFrame, key: str, weights: dict[str, int], default: int, block_rows: int):
        spark = keys.sparkSession
        # A row a source.
        self.found = sorted((r[0], r[1]) for r in keys.groupBy(key).count().collect())
        w = [int(weights.get(k[1:], default)) if k else default for k, _ in self.found]
        self.total, laid = sum(w) or 1, period(w) if w else []
        self.largest, self.blocks = max((n for _, n in self.found), default=0), [-(-n // block_rows) for _, n in self.found]
        done, turns = [0] * len(w), []
        for at, i in enumerate(laid):
            turns.append([self.found[i][0], done[i], at])
            done[i] += 1
        self.turns = table_of(spark, turns, "k string, nth long, at long")
        self.shares = table_of(spark, [[k, x, b] for (k, _), x, b in zip(self.found, w, self.blocks)], "k string, w long, blocks long")

    def virtual(self, numbered: DataFrame) -> DataFrame:
        """Of (k, w, block, ...): adds round and at, the block's place in the full schedule."""
        return numbered.withColumn("nth", F.col("block") % F.col("w")).join(self.turns, ["k", "nth"]).withColumn("round", F.floor(F.col("block") / F.col("w"))).drop("nth")

    def slots(self) -> DataFrame:
        """(k, block, slot): the blocks that there are, numbered in the order of the schedule.

        A round, at most a period's blocks, is numbered in one task; rounds begin where the sizes of those before add up.
        """
        pieces = self.shares.select("k", "w", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / UNFOLDED))).alias("c"))
        first = F.col("c") * UNFOLDED
        numbers = pieces.repartition("k", "c").select("k", "w", F.explode(F.sequence(first, F.least(F.col("blocks"), first + UNFOLDED) - 1)).alias("block"))
        blocks = self.virtual(numbers)
        sizes = blocks.groupBy("round").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("round") / SUMMED))
        before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        # A row for SUMMED rounds.
        runs = sizes.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        within = Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("earlier", F.coalesce(F.sum("n").over(within), F.lit(0))).join(runs, "run").select("round", (F.col("first") + F.col("earlier")).alias("start"))
        place = F.row_number().over(Window.partitionBy("round").orderBy("at")) - 1
        return blocks.withColumn("place", place).join(starts, "round").select("k", "block", (F.col("start") + F.col("place")).alias("slot"))


def _ties(docs: DataFrame) -> Column:
    return F.xxhash64(*[c for c, (_, kind) in zip(columns(docs), docs.dtypes) if "map<" not in kind and "variant" not in kind])


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block_rows: int = PRODUCTION_BLOCK, source: str = "source") -> DataFrame:
    """Adds block, release, deadline (in slots of the full schedule), slot (closed up,
    from 0), row_in_block and weight_share, or replaces columns of these names.

    Rows in the order (slot, row_in_block) are the mixture.
    """
    key, spread, place, w, slot = fresh(docs, "key", "spread", "place", "w", "slot")
    made = ("block", "release", "deadline", "slot", "row_in_block", "weight_share")
    keyed = docs.withColumn(key, _source_key(source)).withColumn(spread, spread_key())
    plan = Plan(keyed, key, weights or {}, default, block_rows)
    rows = numbered(keyed, key, spread, [_ties(docs)], place, digits_for(plan.largest)).withColumn("block", F.floor(F.col(place) / block_rows))
    rows = rows.join(plan.shares.select(F.col("k").alias(key), F.col("w").alias(w)), key)
    rows = rows.join(plan.slots().withColumnsRenamed({"k": key, "slot": slot}), [key, "block"])
    rows = rows.withColumns({
        "release": F.floor(F.col("block") * plan.total / F.col(w)),
        "deadline": F.ceil((F.col("block") + 1) * plan.total / F.col(w)),
        "slot": F.col(slot).cast("long"),
        "row_in_block": F.col(place) % block_rows,
        "weight_share": F.col(w) / F.lit(float(plan.total)),
    })
    return rows.select(*[c for c, n in zip(columns(docs), docs.columns) if n.lower() not in made], *made)


def report(docs: DataFrame) -> DataFrame:
    out = mixed(docs.select("doc_id", "source"), PRODUCTION_WEIGHTS)
    return out.select("doc_id", "source", "block", "release", "deadline", "slot", "row_in_block")


def in_order(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = PRODUCTION_BLOCK, parts: int | None = None) -> DataFrame:
    """The documents themselves, partitioned and sorted by their place in the mixture.

    Written as files, part after part, they are the mixture. Places are settled over
    ids and hashes alone. Of each source, the first row of each partition is noted; with
    these notes a row finds its partition, and documents shuffle once.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    file, row = fresh(docs, "file", "row")
    docs = located(docs, file, row)
    own = docs.drop(file, row)
    # The order of a source's rows; the last two tell repeated rows apart.
    by = [spread_key().alias("spread"), _ties(own).alias("tie"), F.xxhash64(file).alias("file"), F.col(row).alias("row")]
    held = docs.select(F.struct(*columns(own)).alias("held"), _source_key("source").alias("k"), *by)
    slim, by = held.drop("held"), ["spread", "tie", "file", "row"]
    plan = Plan(slim, "k", weights or {}, 1, block_rows)
    if not plan.found:
        return own
    digits = digits_for(parts, 1)
    cell = F.substring("spread", 1, digits)
    part = F.floor(F.col("slot") * parts / F.lit(sum(plan.blocks))).cast("int")
    firsts = plan.slots().groupBy("k", part.alias("part")).agg((F.min("block") * block_rows).alias("place"))
    placed = numbered(slim, "k", "spread", [F.col(c) for c in by[1:]], "place", digits_for(plan.largest))
    notes = placed.where(F.col("place") % block_rows == 0).join(firsts, ["k", "place"])
    own = notes.groupBy("k", cell.alias("cell")).agg(F.collect_list(F.struct(*by, "part", "place")).alias("own"), F.max(F.struct("part", "place")).alias("last"))
    every = plan.shares.select("k", F.explode(F.sequence(F.lit(0), F.lit(16**digits - 1))).alias("c")).select("k", F.lower(F.lpad(F.hex("c"), digits, "0")).alias("cell"))
    before = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # A row for a source's sixteenth, 256th, ...: as many as partitions, or up to sixteen times that. Written, so that
    # the planner knows its size and broadcasts it where that is small; beyond, documents shuffle once more to meet it.
    cells = written(every.join(own, ["k", "cell"], "left").select("k", "cell", "own", F.max("last").over(before).alias("base")), "cells", 8)
    passed = F.filter("own", lambda x: F.struct(*[x[c].alias(c) for c in by]) <= F.struct(*[F.col(c).alias(c) for c in by]))
    found = F.array_max(F.array_compact(F.concat(F.array("base"), F.transform(F.coalesce(passed, F.array()), lambda x: F.struct(x["part"].alias("part"), x["place"].alias("place"))))))
    rows = held.withColumn("cell", cell).join(cells, ["k", "cell"]).select("held", "k", *by, found.alias("at"))
    rows = rows.select("held", "k", *by, F.col("at.part").alias("part"), F.col("at.place").alias("first")).repartitionById(parts, "part")
    place = F.col("first") + F.row_number().over(Window.partitionBy("part", "k").orderBy(*by)) - 1
    rows = rows.withColumn("place", place)
    # A number for each slot of the period, as laid out: a join that moves no row.
    turns = plan.turns.join(plan.shares.select("k", "w"), "k").groupBy("k", "w").agg(F.sort_array(F.collect_list(F.struct("nth", "at")))["at"].alias("ats"))
    rows = rows.join(F.broadcast(turns), "k").withColumn("block", F.floor(F.col("place") / block_rows))
    round_, at = F.floor(F.col("block") / F.col("w")), F.get("ats", (F.col("block") % F.col("w")).cast("int"))
    return rows.select("held", round_.alias("round"), at.alias("at"), (F.col("place") % block_rows).alias("nth")).sortWithinPartitions("round", "at", "nth").select("held.*")


def oracle_sql(block_rows: int = PRODUCTION_BLOCK) -> str:
    hot = ", ".join(f"('={k}', {v})" for k, v in PRODUCTION_WEIGHTS.items())
    return f"""
    WITH RECURSIVE t AS (
        SELECT doc_id, source, coalesce('=' || source, '') AS k, md5(coalesce(doc_id::VARCHAR, '')) AS spread FROM documents
    ), n AS (
        SELECT k, count(*) AS n, row_number() OVER (ORDER BY k) AS i FROM t GROUP BY k
    ), src AS (
        SELECT n.k, n.i, (n.n + {block_rows - 1}) // {block_rows} AS blocks, coalesce(h.w, 1)::BIGINT AS w
        FROM n LEFT JOIN (VALUES {hot}) AS h(k, w) ON n.k = h.k
    ), total AS (SELECT sum(w)::BIGINT AS tw, list(w ORDER BY i) AS ws FROM src),
    sched AS (
        SELECT -1::BIGINT AS slot, NULL::BIGINT AS pick, list_transform(ws, lambda x: 0::BIGINT) AS done FROM total
        UNION ALL
        SELECT slot + 1, p, list_transform(range(1, len(done) + 1), lambda q: done[q] + CASE WHEN q = p THEN 1 ELSE 0 END)
        FROM (
            SELECT slot, done, list_min(list_transform(
                list_filter(range(1, len(ws) + 1), lambda q: done[q] < ws[q] AND (done[q] * tw) // ws[q] <= slot + 1),
                lambda q: {{'d': ((done[q] + 1) * tw + ws[q] - 1) // ws[q], 'q': q}})).q AS p
            FROM sched, total WHERE slot + 1 < tw
        )
    ), laid AS (
        SELECT slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth FROM sched WHERE slot >= 0
    ), placed AS (
        SELECT t.doc_id, t.source, src.i, src.w, (row_number() OVER (PARTITION BY t.k ORDER BY spread) - 1) AS p
        FROM t JOIN src USING (k)
    ), b AS (
        SELECT *, p // {block_rows} AS block, p % {block_rows} AS row_in_block FROM placed
    ), every AS (
        SELECT src.i, g.block, (g.block // src.w) * tw + laid.slot AS v
        FROM src, total, range((SELECT max(blocks) FROM src)) AS g(block), laid
        WHERE g.block < src.blocks AND laid.i = src.i AND laid.nth = g.block % src.w
    ), closed AS (SELECT i, block, row_number() OVER (ORDER BY v) - 1 AS slot FROM every)
    SELECT doc_id, source, b.block, (b.block * tw) // w AS release, ((b.block + 1) * tw + w - 1) // w AS deadline,
        closed.slot, row_in_block
    FROM b JOIN closed ON b.i = closed.i AND b.block = closed.block, total"""
