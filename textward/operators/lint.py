"""Secrets that were committed by mistake: the first match of each family in each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Token families and their labels.
FAMILIES = (
    ("GitHub token (ghp_/gho_/ghs_/ghu_/ghr_)", r"gh[pousr]_[A-Za-z0-9]{10,}"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("Google API key", r"AIza[0-9A-Za-z_-]{35}"),
    ("Slack token", r"xox[baprs]-[A-Za-z0-9-]{8,}"),
    ("JWT", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("PEM private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("OpenAI-style API key", r"sk-[A-Za-z0-9]{20,}"),
)
EXTENSIONS = (".js", ".mjs", ".cjs")
SKIPPED = ("node_modules", ".git", ".npm-cache", "coverage", "dist", "build", "out")


def lint(files: DataFrame, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """rel, label, preview (24 characters, unprintable ones as ``?``) of files by extension, but for those under a skipped folder."""
    folders = F.slice(F.split("rel", r"[/\\\\]"), 1, F.size(F.split("rel", r"[/\\\\]")) - 1)
    files = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))))
    if extensions:
        files = files.where(F.col("ext").isin(*extensions))
    found = F.array(*(F.when(F.col("content").rlike(p), F.struct(F.lit(label).alias("label"), F.regexp_extract("content", p, 0).alias("m"))) for label, p in FAMILIES))
    rows = files.select("rel", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return rows.select("rel", F.col("f.label").alias("label"), F.regexp_replace(F.substring("f.m", 1, 24), "[^ -~]", "?").alias("preview"))
