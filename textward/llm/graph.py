"""Connected components of an edge table, by alternating large and small stars. Nothing reaches the driver but counts.

A hub may have most edges: its neighbourhood is aggregated before it is shuffled, and the least of it comes back to
its edges by ``join_keys``, which broadcasts the hubs and shuffles the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import discard, join_keys, materialise


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, root (the least id of its component) for every id of ``edges`` (a, b)."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    a, b, rows = F.col("a"), F.col("b"), now.count()
    for _ in range(rounds):
        up = now.select(b.alias("a"), a.alias("b"))
        # the least of each node's neighbourhood, itself included; how many neighbours are larger (n) and smaller
        around = materialise(now.unionByName(up).groupBy("a").agg(F.least(F.min("b"), a).alias("m"), F.count_if(b > a).alias("n"), F.count_if(b < a).alias("smaller")), "around", rows)
        total, most, loose = around.agg(F.sum("n"), F.max("n"), F.count_if(F.expr("smaller > 1 OR (smaller > 0 AND n > 0)"))).first()
        # a forest of stars: every node below has one parent, and no parent hangs below another
        if not loose:
            discard(around)
            break
        # large star: every larger neighbour of a node is tied to the least of its neighbourhood
        wide = materialise(join_keys(up, around.drop("smaller"), ["a"], (total, most)).select(b.alias("a"), F.col("m").alias("b")), "edges", rows)
        # small star: a node and its smaller neighbours are tied to the least of them
        below = materialise(wide.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "below", rows)
        tied = join_keys(wide, below, ["a"]).select(b.alias("a"), F.col("m").alias("b")).where("a <> b")
        before, now = now, materialise(tied.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "edges", rows)
        discard(before, around, wide, below)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(a.alias("id"), b.alias("root")).unionByName(now.select(b.alias("id"), b.alias("root")).distinct())
