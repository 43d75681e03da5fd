"""Redaction of a text column of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions.dialect import free
from textward.functions.redaction import MAX_LENGTH, redact_column


def redact(df: DataFrame, column: str = "text", modes: Sequence[str] | None = None, mask_char: str = "*", max_length: int = MAX_LENGTH, strict: bool = False) -> DataFrame:
    """``df`` with redacted, truncated and findings. ``strict``: a null text is an error, else its results are null.

    One narrow stage, nothing is shuffled.
    """
    text = F.col(column).cast("string")
    if strict:
        text = F.when(text.isNull(), F.raise_error(F.lit("redact: text must be a string"))).otherwise(text)
    own = free("_redact", df.columns)
    out = df.withColumn(own, redact_column(text, modes, mask_char, max_length))
    return out.withColumns({c: F.col(f"{own}.{c}") for c in ("redacted", "truncated", "findings")}).drop(own)


def findings_by(df: DataFrame, *by: str, column: str = "text", modes: Sequence[str] | None = None) -> DataFrame:
    """``by``, type, n_rows, n_masked: how many rows and occurrences each kind has."""
    found = df.select(*by, F.explode(redact_column(F.col(column), modes)["findings"]).alias("f"))
    return found.groupBy(*by, F.col("f.type").alias("type")).agg(F.count("*").alias("n_rows"), F.sum("f.count").alias("n_masked"))
