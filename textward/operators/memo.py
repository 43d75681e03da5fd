"""Memoised scans: equal texts are scanned once and joined back, and every row knows whether a cache would have served it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.dialect import free
from textward.functions.rules import VERSION


def cache_key(text: Column, max_length: int = 200_000) -> Column:
    """SHA-256 of the ruleset version, NUL and the truncated text; ``null`` for a null text, which is a key of its own."""
    return F.coalesce(F.sha2(F.concat(F.lit(f"{VERSION}\0"), F.substring(text, 1, max_length)).cast("binary"), 256), F.lit("null"))


def memoised(df: DataFrame, compute: Callable[[DataFrame], DataFrame], order: str, column: str = "text", max_length: int = 200_000) -> DataFrame:
    """``compute`` over one row of each key (``_key`` and the text), joined back to all rows, with cache_hit (false for
    the first of a key by ``order``, and for rows that share its order).

    The first of a key comes from a partial aggregate of the order alone, so a hot text is one row a task and no text
    goes through it. Texts are fetched once, by the join that also marks the first rows.
    """
    key, first = free("_memo", [*df.columns, "_key"]), free("_first", df.columns)
    keyed = df.withColumn(key, cache_key(F.col(column), max_length))
    firsts = keyed.groupBy(key).agg(F.min(order).alias(first))
    marked = keyed.join(firsts, key)
    results = compute(marked.where(F.col(order).eqNullSafe(F.col(first))).select(F.col(key).alias("_key"), column).dropDuplicates(["_key"]))
    made = [c for c in results.columns if c not in ("_key", column)]
    out = marked.join(results.select(F.col("_key").alias(key), *made), key)
    return out.withColumn("cache_hit", ~F.col(order).eqNullSafe(F.col(first))).select(*df.columns, *made, "cache_hit")


def lru_hits(df: DataFrame, order: str, column: str = "text", capacity: int = 512, max_length: int = 200_000, scanner: str | None = None) -> DataFrame:
    """``df`` with cache_hit under least-recently-used caches of ``capacity`` entries, one for each ``scanner`` (a
    column; one cache without).

    A cache's log is a sequence, so each scanner's rows go through one task in the order of ``order``, as a stream of
    Arrow batches; the task holds ``capacity`` keys, whatever the length of the log. Rows needn't fit in memory.
    """
    key, who = free("_lru", df.columns) + "key", free("_lru", df.columns) + "who"
    keyed = df.withColumns({key: cache_key(F.col(column), max_length), who: F.col(scanner).cast("string") if scanner else F.lit("")})
    columns, n = df.columns, len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, None] = OrderedDict()
        at: object = run
        for batch in batches:
            hits = []
            for scanner_, k in zip(batch.column(n + 1).to_pylist(), batch.column(n).to_pylist(), strict=True):
                if scanner_ != at:
                    at, held = scanner_, OrderedDict()
                hits.append(k in held)
                held[k] = None
                held.move_to_end(k)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(hits, pa.bool_())], names=[*columns, "cache_hit"])

    dealt = (keyed.repartition(who) if scanner else keyed.repartition(1)).sortWithinPartitions(who, order)
    return dealt.select(*columns, key, who).mapInArrow(run, type(df.schema)([*df.schema.fields]).add("cache_hit", "boolean"))


def stats(df: DataFrame, column: str = "text", max_length: int = 200_000) -> DataFrame:
    """size, hits, misses of an unbounded cache. Counts by key first, so a hot text is one row a task."""
    per_key = df.select(cache_key(F.col(column), max_length).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("size"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"), F.count("*").alias("misses"))
