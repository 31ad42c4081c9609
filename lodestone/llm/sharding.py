"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels. At each level every child
draws ``ln(u) / weight`` with u uniform from md5(doc_id, child), and the largest
draw wins, so a child is chosen in proportion to its weight and a change of one
child's weight moves documents only into or out of that child. Every expression is
built in; rows shuffle only to number the slots.

Null text has size 1 and crc32 0; a null doc_id is placed as the empty string;
repeated rows share a shard and get slots of their own; of very long texts only size
and checksum go on; other columns are left out; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import digits_for, numbered, spread_key, text_or_empty


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = ()

    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total() for c in self.children)


def tree(n_shards: int, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Regions of ``racks * per_rack`` shards, filled in order.

    An inner node weighs what its shards weigh. A shard that opens a new region
    takes documents only into itself; one that joins a region also lets that
    region's documents settle anew, but none outside it.
    """
    if n_shards < 1:
        raise ValueError("a tree needs a shard")
    weights = weights or {}
    leaves = [Node(f"shard{i}", float(weights.get(i, 1.0)), i) for i in range(n_shards)]
    if any(leaf.weight <= 0 for leaf in leaves):
        raise ValueError("weights are positive")
    racked = [leaves[i : i + per_rack] for i in range(0, n_shards, per_rack)]
    nodes = [Node(f"rack{i}", 0.0, None, tuple(r)) for i, r in enumerate(racked)]
    regions = [Node(f"region{i // racks}", 0.0, None, tuple(nodes[i : i + racks])) for i in range(0, len(nodes), racks)]
    return Node("root", 0.0, None, tuple(regions))


def draw(key: Column, node: Node) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node.name}"))), 1, 12), 16, 10).cast("double")
    return F.log((bits + 0.5) / float(1 << 48)) / node.total()


def place(key: Column, node: Node) -> Column:
    """The shard that ``key`` (a string) reaches from ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    best = F.array_max(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]
    chosen = None
    for i, c in enumerate(node.children):
        chosen = F.when(best == i, place(key, c)) if chosen is None else chosen.when(best == i, place(key, c))
    return chosen


def shards(docs: DataFrame, n_shards: int = 8, grown: int | None = 9, layout: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless within a shard) and grown_shard."""
    layout = layout or tree(n_shards)
    text, key = text_or_empty(), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, layout).cast("int").alias("shard"),
        (place(key, tree(grown)) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        spread_key().alias("spread"),
    )
    out = numbered(placed, "shard", "spread", [F.col("doc_id"), F.col("text_crc32")], "slot", digits_for(docs.count()))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def oracle_sql(n_shards: int = 8, grown: int = 9) -> str:
    """The same placement for DuckDB; crc32 is spelled out there as no built-in has it."""

    def choose(node: Node) -> str:
        if node.shard is not None:
            return str(node.shard)
        if len(node.children) == 1:
            return choose(node.children[0])
        draws = [f"ln((('0x' || substr(md5(k || '/{c.name}'), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}) / {c.total()!r}" for c in node.children]
        branches = " ".join(f"WHEN {d} >= greatest({', '.join(draws)}) THEN {choose(c)}" for d, c in list(zip(draws, node.children))[::-1])
        return f"(CASE {branches} END)"

    return f"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS txt, coalesce(doc_id::VARCHAR, '') AS k FROM documents
    ), placed AS (
        SELECT doc_id, strlen(txt)::BIGINT + 1 AS size,
            xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(
                list_transform(range(1, length(hx) // 2 + 1), lambda p: [('0x' || substr(hx, (2 * p - 1)::BIGINT, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS text_crc32,
            {choose(tree(n_shards))}::INTEGER AS shard, {choose(tree(grown))}::INTEGER AS grown_shard, md5(k) AS spread
        FROM (SELECT *, hex(encode(txt)) AS hx FROM t)
    )
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY spread, doc_id) - 1 AS slot, grown_shard
    FROM placed"""
