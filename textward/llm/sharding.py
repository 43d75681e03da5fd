"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws ``-ln(u) / weight`` with ``u`` from a
hash of (key, child); the least draw wins. A child's draw depends on nothing but the key and its own weight,
so a change of weight moves rows only into or out of the subtrees whose weights change.

A new shard is hung below the root as a region of its own: the other draws stay as they were, so it takes rows
from anywhere, but only into itself (law ``key``).

Defined cases: a null key draws as the text ``null``; a null text counts as no text (size 8, CRC 0); rows with
one key share a shard and get slots of their own; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.llm.common import fresh

#: Slots are numbered in this many parts of each shard, so that no task holds a shard.
SLOT_PARTS = 512


@dataclass(frozen=True)
class Node:
    """A subtree: its own label, its weight (None: the sum of its children's), its children; a leaf has a shard number."""

    label: str
    weight: float | None = None
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None

    @property
    def mass(self) -> float:
        return self.weight if self.weight is not None else sum(c.mass for c in self.children)


def even_tree(shards: int = 24, regions: int = 3, racks: int = 2) -> Node:
    """``shards`` leaves of weight 1, dealt in order to ``regions`` x ``racks``."""
    ends = [round(i * shards / (regions * racks)) for i in range(regions * racks + 1)]
    leaf = lambda s: Node(f"s{s}", 1.0, shard=s)
    rack = lambda r, k: Node(f"r{r}k{k}", children=tuple(map(leaf, range(ends[r * racks + k], ends[r * racks + k + 1]))))
    return Node("root", children=tuple(Node(f"r{r}", children=tuple(x for k in range(racks) if (x := rack(r, k)).children)) for r in range(regions)))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard, as a region of its own."""
    return Node(tree.label, tree.weight, (*tree.children, Node(f"x{shard}", weight, shard=shard)))


def draw(key: Column, node: Node) -> Column:
    """``-ln(u) / weight``; u is in (0, 1), from 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node.label}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(node.mass))


def descend(key: Column, node: Node) -> Column:
    """The shard number of ``key``; only the branch that wins is evaluated."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.mass > 0]
    if len(live) == 1:
        return descend(key, live[0])
    winner = F.least(*(F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)))["i"]
    out = F.when(winner == 0, descend(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(winner == i, descend(key, c))
    return out


def assign(rows: DataFrame, tree: Node, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``rows`` with the shard that the tree gives to ``key``. No shuffle, no state."""
    return rows.withColumn(shard, descend(F.coalesce(F.col(key).cast("string"), F.lit("null")), tree).cast("int"))


def number(rows: DataFrame, by: str = "shard", order: tuple[str, ...] = ("doc_id",), parts: int = SLOT_PARTS) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... within each ``by``.

    A shard is cut into ``parts`` by an MD5 of ``order``, and slots follow part and ``order``; the parts' sizes (at most shards x parts rows, a bound
    that doesn't grow with the data) give each part's first slot, and only a part is sorted in one task. Rows that are
    equal in all of ``order`` are numbered in one task.
    """
    part, first, at, n = (fresh(x, [*rows.columns, "slot"]) for x in ("part", "first", "at", "n"))
    digits = F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in order)).cast("binary")), 1, 4)
    dealt = rows.withColumn(part, F.pmod(F.conv(digits, 16, 10).cast("int"), F.lit(parts)))
    before = W.partitionBy(by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    firsts = dealt.groupBy(by, part).agg(F.count("*").alias(n)).select(by, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    placed = dealt.withColumn(at, F.row_number().over(W.partitionBy(by, part).orderBy(*order)).cast("long"))
    return placed.join(F.broadcast(firsts), [by, part]).withColumn("slot", F.col(first) + F.col(at) - 1).drop(part, first, at)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    tree = even_tree(shards)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    bigger = grown(tree, shards)
    new = bigger.children[-1]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    old = F.least(*(draw(key, c) for c in tree.children))
    rows = assign(rows, tree).withColumn("grown_shard", F.when(draw(key, new) < old, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
    rows = number(rows, order=("doc_id", "text_crc32", "size"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
