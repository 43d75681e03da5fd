"""Log events and Markdown reports as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.redaction import redact_column

MASKED_FIELDS = ("text", "content", "evidence", "snippet", "value")
LONGEST = 4000
ICONS = {"pass": "✅", "warn": "⚠️", "fail": "❌", "error": "❓", "info": "ℹ️"}


def safe_field(name: str, value: Column, is_string: bool = True) -> Column:
    """Fields of certain names are masked; other long strings are cut and say so."""
    if not is_string:
        return value
    if name in MASKED_FIELDS:
        return redact_column(value)["redacted"]
    return F.when(F.length(value) > LONGEST, F.concat(F.substring(value, 1, LONGEST), F.lit("…(truncated)"))).otherwise(value)


def events(df: DataFrame, level: str, event: str, request_id: str, fields: list[str], ts: Column | None = None, masked: Mapping[str, str] | None = None) -> DataFrame:
    """One JSON line for each row. ``masked``: of fields that are masked, the columns that hold their masked form already."""
    kinds, masked = dict(df.dtypes), {f: c for f, c in (masked or {}).items() if f in MASKED_FIELDS}
    safe = [(F.col(masked[f]) if f in masked else safe_field(f, F.col(f), kinds[f] == "string")).alias(f) for f in fields]
    stamp = F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select(F.to_json(F.struct(stamp.alias("ts"), F.lit(level).alias("level"), F.lit(event).alias("event"), F.col(request_id).cast("string").alias("requestId"), *safe)).alias("value"))


def append(lines: DataFrame, path: str) -> None:
    """Append JSON lines to a folder of text files."""
    lines.write.mode("append").text(path)


def scan_event(scanned: DataFrame) -> DataFrame:
    return scanned.withColumn("rules_hit", F.size("reasons").cast("long"))


def redact_event(redacted: DataFrame) -> DataFrame:
    return redacted.withColumns({"types_hit": F.col("findings.type"), "total": masked_total(F.col("findings"))})


def masked_total(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0).cast("long"), lambda a, f: a + f["count"])


def _lines(*parts: Column) -> Column:
    """Non-null parts, one a line."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n")


def render_scan() -> Column:
    """Decision, up to eight hits, warnings. Columns of a scan are read."""
    shown = F.transform(F.slice("reasons", 1, 8), lambda r: F.format_string("- `%s` (%s, ×%d): %s — `%s`", r["rule_id"], r["severity"], r["matches"], r["description"], r["snippet"]))
    return _lines(
        F.format_string("**Security scan** — decision `%s` (confidence %.2f)", "decision", "confidence"),
        F.when(F.size("reasons") > 0, F.concat(F.lit("Hits:\n"), F.array_join(shown, "\n"))),
        F.when(F.size("warnings") > 0, F.concat(F.lit("⚠ "), F.array_join("warnings", "; "))),
        F.when(F.col("classifier_used"), F.lit("Model classifier contributed to this decision.")),
    )


def render_redact() -> Column:
    each = F.transform("findings", lambda f: F.format_string("- %s: ×%d (e.g. `%s`)", f["label"], f["count"], f["sample"]))
    return _lines(
        F.format_string("**PII redaction** — %d occurrence(s) masked across %d type(s).", masked_total(F.col("findings")), F.size("findings")),
        F.when(F.size("findings") > 0, F.array_join(each, "\n")),
        F.when(F.col("truncated"), F.lit("⚠ input was truncated before redaction.")),
    )


def render_audit(checks: DataFrame, limitations: list[str]) -> DataFrame:
    """One row, one report. The checks are the nine of an audit at most."""
    icon = F.create_map(*(F.lit(x) for kv in ICONS.items() for x in kv))
    line = F.concat(
        F.format_string("- %s `%s` (%s): %s", F.coalesce(icon[F.col("status")], F.lit("•")), "id", "severity", "message"), F.when(F.col("evidence") != "", F.concat(F.lit("\n  evidence: `"), "evidence", F.lit("`"))).otherwise("")
    )
    body = checks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("check_ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail", "error", "info")))
    head = F.format_string("**Security audit** — pass %d / warn %d / fail %d / error %d / info %d", "pass", "warn", "fail", "error", "info")
    tail = "\n".join(["Limitations:", *(f"- {x}" for x in limitations)]) if limitations else None
    return body.select(_lines(head, F.when(F.col("b") != "", F.col("b")), F.lit(tail)).alias("report"))
