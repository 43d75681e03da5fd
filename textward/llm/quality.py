"""Quality rules as a short-circuit cascade of column expressions; no Python on the executors.

``plan`` runs every rule over a bounded sample, measures its seconds and the share of rows it rejects, and orders
the rules by rejection per cost. ``cascade`` is one nested CASE in that order: a row leaves at its first failing
rule, and later rules aren't evaluated for it. The order changes the cost and the named rule, never the verdict.

Defined cases: a null text counts as empty; a text without words fails ``few_words``; an empty table gives an empty
result (and the rules keep their written order); repeated rows are judged row by row; other columns may be there.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm.common import materialise

#: Rows of the sample that costs and selectivities are measured on.
SAMPLE_ROWS = 1_000
#: Seconds below which a rule's cost can't be told.
LEAST_COST = 0.005

BLANK = r"[\x20\x09-\x0D]+"
#: Fixed values of the base rules and of the further ones.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOL_PERCENT, MAX_BANG_PERCENT, MAX_DUP_LINE_PERCENT, MEAN_WORD = 10, 50, 60, (2, 14)
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def occurrences(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: word_chars(x) > 0)


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, for an array that is at hand (a lambda's variable).

    The windows' hashes are sorted with their places; a window repeats if a neighbour has its hash. The places
    of those, sorted again, cover the sum of min(3, distance to the next one) words.
    """
    n = F.size(ws)
    hashed = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
        return bound(F.array_sort(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(bound(F.array_sort(hashed), covered))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def counts(text: Column) -> Column:
    """n_words and n_repeat_words as a struct; the words are made once."""
    return bound(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """A row fails where ``fails`` holds; ``base`` rules are those that the contract fixes."""

    name: str
    fails: Column
    base: bool = False


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text: Column) -> dict[str, Column]:
    return {"n_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "word_chars": word_chars(text), "n_symbols": occurrences(text, SYMBOLS), "n_dup_lines": dup_lines(word_lines(text)), "n_repeat_words": counts(text)["n_repeat_words"]}


def rules(text: Column, given: dict[str, Column] | None = None) -> list[Rule]:
    """The rules over a text; ``given`` holds measures that are columns already."""
    m = measures(text) | (given or {})
    n = m["n_words"]
    return [
        Rule("few_words", n < MIN_WORDS, True),
        Rule("repeated_windows", 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n, True),
        Rule("symbols", 100 * m["n_symbols"] > MAX_SYMBOL_PERCENT * n),
        Rule("exclamation", 100 * occurrences(text, "!") > MAX_BANG_PERCENT * n),
        Rule("repeated_lines", 100 * m["n_dup_lines"] > MAX_DUP_LINE_PERCENT * F.size(word_lines(text))),
        Rule("word_length", (m["word_chars"] < MEAN_WORD[0] * n) | (m["word_chars"] > MEAN_WORD[1] * n)),
    ]


def plan(docs: DataFrame, every: Sequence[Rule], rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """The rules in the order of their rejection per cost on a sample."""
    total = docs.count()
    if not total:
        return list(every)
    share = min(1.0, 2 * rows / total)
    sample = materialise(docs.select(F.coalesce(F.col(text), F.lit("")).alias(text)).sample(share, seed=1).limit(rows).coalesce(1), "sample")

    def run(*cols: Column) -> tuple[float, int]:
        began = time.perf_counter()
        got = sample.agg(F.count("*"), *(F.count_if(c) for c in cols)).first()
        return time.perf_counter() - began, (got[1] if cols else got[0]) or 0

    run()
    idle, n = run(F.length(text) >= 0)
    ranked = []
    for k, rule in enumerate(every):
        run(rule.fails)
        seconds, rejected = run(rule.fails)
        ranked.append((-(rejected / max(n, 1)) / max(LEAST_COST, seconds - idle), k, rule))
    return [r for _, _, r in sorted(ranked, key=lambda x: x[:2])]


def cascade(ordered: Sequence[Rule]) -> Column:
    """The first rule that a row fails, in this order; null if it passes all."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in ordered:
        out = out.when(rule.fails, F.lit(rule.name))
    return out


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``failed_rule`` (null: the row is kept)."""
    body = F.coalesce(F.col(text), F.lit(""))
    ordered = plan(docs, rules(F.col(text)), text=text)
    named = {r.name: r for r in rules(body)}
    return docs.withColumn("failed_rule", cascade([named[r.name] for r in ordered]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and failed_rule of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [r.name for r in plan(rows, rules(F.col("text")))]
    text = F.col("text")
    made = measures(text) | {k: F.col(f"_c.{k}") for k in ("n_words", "n_repeat_words")}
    measured = rows.withColumn("_c", counts(text)).select("doc_id", "text", *(c.alias(k) for k, c in made.items()))
    found = {r.name: r for r in rules(text, {k: F.col(k) for k in MEASURES})}
    base = found["few_words"].fails | found["repeated_windows"].fails
    failed = cascade([found[k] for k in order])
    return measured.select("doc_id", *MEASURES, base.alias("base_failed"), failed.isNull().alias("kept"), failed.alias("failed_rule"))
