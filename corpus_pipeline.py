"""The corpus pipeline: five stages, each over all that its predecessor kept.

All stages but the last return the columns of ``documents``, whatever further columns there are. Rows with a null or
empty text stay to the end (they have no lines, shingles, windows or tokens, and score as a text without hits). Rows
with a null doc_id are judged by their own text like any other; of equal or near texts they are never the copies that
go. Of rows that repeat a doc_id and a text one stays, from near_dedup on. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textward.llm import queries
from textward.llm.common import discard, materialise, read, scratch

STAGES = [
    ("toxicity", queries.without_toxic),
    ("line_dedup", queries.without_repeated_lines),
    ("near_dedup", queries.without_near_copies),
    ("decontamination", queries.without_benchmark),
    ("sentencepiece", queries.encoded),
]

#: Suffix ranks, signatures, a fitted model and merges of pieces have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again by the next, and what it
    wrote besides goes with it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            kept.append(after := materialise(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
