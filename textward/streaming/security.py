"""Extension: the scan and the redaction are stateless per row, so they run on a stream as they are; repeats drop within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.config import ScanOptions
from textward.operators.memo import cache_key
from textward.operators.redact import redact
from textward.operators.scan import scan


def scan_stream(rows: DataFrame, column: str = "text", options: ScanOptions | None = None) -> DataFrame:
    return scan(rows, column, options)


def redact_stream(rows: DataFrame, column: str = "text") -> DataFrame:
    return redact(rows, column)


def first_seen(rows: DataFrame, time: str, within: str, column: str = "text") -> DataFrame:
    """Rows whose text wasn't seen within the watermark: the cache of a scanner, bounded by time."""
    return rows.withColumn("_key", cache_key(F.col(column))).withWatermark(time, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def decisions(scanned: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Counts by window and decision."""
    return scanned.withWatermark(time, late).groupBy(F.window(time, window), "decision").agg(F.count("*").alias("n"))
