"""Line deduplication with a suffix array over line ids, built by distributed prefix doubling.

Every line with a word gets a line id; a document is the sequence of its line ids. Round k of the doubling ranks
the stretches of 2**k lines: the rank of a stretch is the place of its pair (rank of the first half, rank of the
second half) in the sorted order of all pairs, so ranks order suffixes as a suffix array does, and an equal rank
is an interval of the array whose longest common prefix is at least 2**k lines. Only stretches that occur twice
stay in play: a suffix that is alone in its interval has no repeat that long and drops out.

A run counts as repeated from ``MIN_WORDS`` words on. For each line, the shortest such run that begins there and
the shortest that ends there are looked up in the intervals (two overlapping stretches of 2**k lines make a run of
any length between 2**k and 2**(k+1)); if the run's interval holds an earlier place, its lines are marked. Any
longer repeated run is the union of such shortest ones, so the marked lines are exactly the lines that lie in a
repeated run of ``MIN_WORDS`` words or more and aren't its first copy. They are deleted.

Order of places: doc_id, a hash of the text, line number. A hot line or run is one pre-aggregated row of each round,
and its rows meet a broadcast of the hot keys (``join_keys``), never a task of their own or a window. Lines are
compared by 128-bit hashes; a document is known by its doc_id and a 64-bit hash of its text.

Defined cases: lines are split at ``\\n`` and compared without ASCII white space at either end; lines without a word are
never marked and never break a run; null and empty texts have no lines; rows with equal doc_id and text are one
document; a document that loses all its lines with words has an empty text; an empty table gives an empty result;
further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.llm.common import bound_batches, discard, fresh, join_keys, materialise, trimmed

#: Marked documents and runs up to which the marks are broadcast (about 16 bytes a run); beyond, texts are shuffled to them.
BROADCAST_MARKS, BROADCAST_RUNS = 500_000, 1_000_000
#: Words from which on a run of lines counts as repeated.
MIN_WORDS = 30
#: Rows of lines that one batch may come to.
LINE_ROWS = 100_000

BLANK = " \t\n\x0b\x0c\r"
LINES = "doc_id long, uid long, at int, line binary, next int, back int"
#: What a document is known by.
DOC = ["doc_id", "uid"]


def _doc(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """doc_id (the greatest number stands for null) and a hash of the text."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1)), F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line with a word: its document (doc_id, uid), its place among them, its id, and the lengths of the
    shortest runs of ``min_words`` words that begin (next) and end (back) there; 0 if the document is too short."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())

    def made(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "uid", "at", "line", "next", "back"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, uid, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "text")), strict=True):
                own = [(s, n) for raw in text.split("\n") if (n := len((s := raw.strip(BLANK)).encode("utf-8", "surrogatepass").split()))]
                if not own:
                    continue
                total = np.concatenate(([0], np.cumsum([n for _, n in own])))
                end = np.searchsorted(total, total[:-1] + min_words, side="left")
                begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
                place = np.arange(len(own))
                cols[0] += [doc_id] * len(own)
                cols[1] += [uid] * len(own)
                cols[2] += place.tolist()
                cols[3] += [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s, _ in own]
                cols[4] += np.where(end <= len(own), end - place, 0).tolist()
                cols[5] += np.where(begin >= 0, place - begin + 1, 0).tolist()
                if len(cols[0]) >= LINE_ROWS:
                    yield made(cols)
                    cols = [[], [], [], [], [], []]
            yield made(cols)

    doc_id, uid = _doc(F.col("doc_id"), F.col("text"))
    return docs.select(doc_id.alias("doc_id"), uid.alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, LINES)


def _ranked(pairs: DataFrame) -> DataFrame:
    """(first, second, rank, n) of the pairs that occur n > 1 times; ranks follow the order of (first, second).

    Pairs are counted before they are shuffled, range-partitioned and sorted; a row's number in its partition after
    the partition's own number is a rank. Written once, so a retry can't number it anew.
    """
    twice = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).where("n > 1")
    ordered = twice.repartitionByRange("first", "second").sortWithinPartitions("first", "second")
    return materialise(ordered.withColumn("rank", F.monotonically_increasing_id() + 1), "ranks")


def suffix_intervals(rows: DataFrame, depth: int) -> Iterator[tuple[int, DataFrame]]:
    """For k = 0, 1, ... while any stretch of 2**k <= depth lines repeats: k and (doc_id, uid, at, rank) of the repeated stretches."""
    pairs = rows.select(*DOC, "at", F.col("line").alias("first"), F.lit(0).cast("long").alias("second"))
    k = 0
    while 1 << k <= depth:
        ranks = _ranked(pairs)
        if ranks.isEmpty():
            return
        here = materialise(join_keys(pairs, ranks, ["first", "second"]).select(*DOC, "at", "rank"), "intervals")
        discard(ranks)
        yield k, here
        after = here.select(*DOC, (F.col("at") - (1 << k)).alias("at"), F.col("rank").alias("second"))
        pairs = here.withColumnRenamed("rank", "first").join(after, [*DOC, "at"])
        k += 1


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, uid, at, length: the shortest repeated runs that have an earlier copy; every deleted line lies in one."""
    bound_batches(docs.sparkSession)
    rows = materialise(lines(docs, min_words).dropDuplicates([*DOC, "at"]), "lines")
    begins = rows.where("next > 0").select(*DOC, "at", F.col("next").alias("length"))
    ends = rows.where("back > 0").select(*DOC, (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("length"))
    runs = materialise(begins.unionByName(ends).distinct(), "runs")
    run = ["first", "second", "length"]
    found = rows.select(*DOC, "at", F.col("next").alias("length")).limit(0)
    for k, here in suffix_intervals(rows, min_words):
        size = 1 << k
        wanted = runs.where(F.col("length").between(size, 2 * size - 1))
        first = wanted.join(here, [*DOC, "at"]).withColumnRenamed("rank", "first")
        second = here.select(*DOC, F.col("at").alias("tail"), F.col("rank").alias("second"))
        placed = first.withColumn("tail", F.col("at") + F.col("length") - size).join(second, [*DOC, "tail"])
        placed = materialise(placed.select(*run, *DOC, "at"), "placed")
        earliest = placed.groupBy(*run).agg(F.min(F.struct(*DOC, "at")).alias("o"), F.count("*").alias("n")).where("n > 1")
        earliest = materialise(earliest, "earliest")
        later = join_keys(placed, earliest, run).where(F.struct(*DOC, "at") != F.col("o"))
        found = found.unionByName(later.select(*DOC, "at", "length"))
    return found


def runs_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, uid, begin, end, n_lines: the maximal marked runs of each document (neighbouring and overlapping ones joined)."""
    marked = later_copies(docs, min_words).select(*DOC, F.explode(F.expr("sequence(at, at + length - 1)")).alias("at")).distinct()
    w = W.partitionBy(*DOC).orderBy("at")
    return marked.withColumn("g", F.col("at") - F.row_number().over(w)).groupBy(*DOC, "g").agg(F.min("at").alias("begin"), F.max("at").alias("end"), F.count("*").alias("n_lines")).drop("g")


def delete(docs: DataFrame, min_words: int = MIN_WORDS, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` (all columns) without later copies of repeated runs, with how many lines with words each had and lost.

    Marks are joined by doc_id and the text's hash. A document without marks keeps its text byte for byte. A name of
    the two new columns, which are the last ones, that is taken gets underscores at its end.
    """
    bound_batches(docs.sparkSession)
    columns = docs.columns
    n_lines, n_removed = fresh(n_lines, columns), fresh(n_removed, columns)
    a, b, marks_ = (fresh(x, [*columns, n_lines, n_removed]) for x in ("doc", "uid", "runs"))
    found = later_copies(docs, min_words).groupBy(*DOC).agg(F.collect_set(F.struct("at", "length")).alias("runs"))
    marked = materialise(found.toDF(a, b, marks_), "marks")
    doc_id, uid = _doc(F.col("doc_id"), F.col("text"))
    n, runs_ = marked.agg(F.count("*"), F.coalesce(F.sum(F.size(marks_)), F.lit(0))).first()
    small = n <= BROADCAST_MARKS and runs_ <= BROADCAST_RUNS
    joined = docs.withColumns({a: doc_id, b: uid}).join(F.broadcast(marked) if small else marked.hint("merge"), [a, b], "left").select(*columns, marks_)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_at = columns.index("text")
        for batch in trimmed(batches):
            texts_, total, removed = [], [], []
            for text, runs in zip(batch.column(text_at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                has = [i for i, p in enumerate(parts) if p.strip(BLANK)]
                gone = {has[i] for r in runs or () for i in range(r["at"], r["at"] + r["length"])}
                total.append(len(has))
                removed.append(len(gone))
                texts_.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if len(gone) < len(has) and gone else "" if gone else text)
            kept = [pa.array(texts_, pa.string()) if k == text_at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*columns, n_lines, n_removed])

    out = type(docs.schema)([*docs.schema.fields]).add(n_lines, "long").add(n_removed, "long")
    return joined.mapInArrow(cut, out)
