"""Prompt-injection scan of a text column: one narrow stage of searches, sums and a late array of reasons."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.config import ScanOptions
from textward.functions.dialect import bound, cut, free, java, one_line
from textward.functions.redaction import redact_column
from textward.functions.rules import MAX_MATCHES, RULE_IDS, RULES, VERSION, WEIGHTS, Rule

HIT = "array<struct<rule_id:string,category:string,severity:string,action:string,description:string,matches:bigint,snippet:string>>"
AROUND, SNIPPET = 30, 100


def insensitive(rule: Rule) -> str:
    return "(?i)" + java(rule.pattern)


#: For each rule words of which every match holds one, in lower case: texts without them aren't searched. Letters of
#: rules match without regard to ASCII case only, so the lower case of a match always holds the word.
NEEDED = {
    "instr-ignore-previous": ("ignore",),
    "instr-disregard": ("disregard",),
    "instr-forget": ("forget",),
    "instr-start-fresh": ("conversation", "session", "chat"),
    "role-you-are-now": ("now",),
    "role-act-as": ("act", "behave"),
    "role-ignore-guardrails": ("safety", "guardrail", "restriction", "constraint", "polic", "filter"),
    "role-dan-mode": ("mode", "anything", "jail"),
    "leak-system-prompt": ("prompt", "instruction"),
    "leak-repeat-instructions": ("instruction",),
    "exfil-send-external": ("exfiltrate", "steal", "send", "upload", "post", "transmit"),
    "exfil-url": ("://",),
    "tool-shell-commands": ("command",),
    "tool-destructive": ("-rf", "delete", "wipe"),
    "harm-explosive": ("bomb", "explosive", "incendiary"),
    "harm-weapon": ("instruction",),
    "harm-malware": ("malware", "ransomware", "virus", "keylogger", "trojan"),
    "cn-ignore-previous": ("忽略",),
    "cn-ignore-everything": ("无视",),
    "cn-you-are-now": ("你现在",),
    "cn-leak-prompt": ("提示词", "系统提示", "指令"),
    "cn-jailbreak": ("越狱", "解除限制", "破解限制"),
    "cn-guardrail-bypass": ("绕过", "无视", "关闭"),
    "cn-tool-abuse": ("命令",),
}


#: The letters that a match of a rule with alternatives may begin with, in lower case.
FIRST = {
    "instr-start-fresh": "bs",
    "role-act-as": "ab",
    "role-ignore-guardrails": "bdfior",
    "role-dan-mode": "dj",
    "leak-system-prompt": "doprs",
    "leak-repeat-instructions": "cqr",
    "exfil-send-external": "epstu",
    "exfil-url": "epsu",
    "tool-shell-commands": "er",
    "tool-destructive": "drw",
    "harm-explosive": "bchm",
    "harm-malware": "cdw",
}


def searched(rule: Rule) -> str:
    """The pattern, tried only where a match may begin."""
    first = FIRST.get(rule.id)
    return f"(?=[{first}{first.upper()}])(?:{insensitive(rule)})" if first else insensitive(rule)


def matches(text: Column, low: Column, rule: Rule) -> Column:
    """How often a rule matches, 20 at most. ``low``: the text in lower case."""
    some = F.lit(False)
    for word in NEEDED[rule.id]:
        some = some | F.contains(low, F.lit(word))
    count = F.least(F.regexp_count(text, F.lit(searched(rule))), F.lit(MAX_MATCHES)).cast("long")
    return F.when(some, count).when(text.isNotNull(), F.lit(0).cast("long"))


def surroundings(text: Column, rule: Rule) -> Column:
    """The first match with up to 30 characters on either side. One search: what lies before and after the match is its place and length."""

    def near(parts: Column) -> Column:
        before, after = F.length(F.get(parts, F.lit(0))), F.length(F.get(parts, F.lit(1)))
        start = F.greatest(before - AROUND, F.lit(0))
        return F.substring(text, start + 1, F.length(text) - after - start + AROUND)

    return bound(F.split(text, searched(rule), 2), near)


def snippet(near: Column, mask_char: str = "*") -> Column:
    """Surroundings on one line, masked, cut to 100."""
    return bound(redact_column(one_line(near), mask_char=mask_char)["redacted"], lambda x: cut(x, SNIPPET))


def _hit(text: Column, i: int, own: str, snippets: bool) -> Column:
    r = RULES[i]
    names = {"rule_id": r.id, "category": r.category, "severity": r.severity, "action": r.action, "description": r.description}
    return F.struct(*(F.lit(v).alias(k) for k, v in names.items()), F.col(f"{own}m{i}").alias("matches"), (surroundings(text, r) if snippets else F.lit("")).alias("snippet"))


def _listed(text: Column, which: Iterable[int], last: Column, mask_char: str, own: str, snippets: bool) -> Column:
    """The hits among ``which`` up to rule ``last``; the array is made only for rows that hit."""
    rules = list(which)
    if not rules:
        return F.array().cast(HIT)
    some = F.lit(False)
    for i in rules:
        some = some | (F.col(f"{own}m{i}") > 0)
    each = F.filter(F.array(*(F.when((F.col(f"{own}m{i}") > 0) & (F.lit(i) <= last), _hit(text, i, own, snippets)) for i in rules)), lambda h: h.isNotNull())
    masked = F.transform(each, lambda h: h.withField("snippet", snippet(h["snippet"], mask_char))) if snippets else each
    return F.when(some, masked.cast(HIT)).otherwise(F.array().cast(HIT))


def scan(df: DataFrame, column: str = "text", options: ScanOptions | None = None, mask_text: bool = True, budget_exceeded: str | None = None, strict: bool = False, snippets: bool = True) -> DataFrame:
    """``df`` with decision, confidence, reasons, allowlisted_hits, masked_text, truncated, warnings, scanned_length, ruleset.

    ``budget_exceeded`` names a boolean column that stands for a spent time budget: such rows fail open. A null text
    gives nulls, or an error if ``strict``. Without ``snippets`` those are empty, and only the counting searches run.
    Other columns stay, whatever their names; of those above the result's own stand.
    """
    o = (options or ScanOptions()).normalised()
    text = F.col(column).cast("string")
    if strict:
        text = F.when(text.isNull(), F.raise_error(F.lit("scan: text must be a string"))).otherwise(text)
    own = free("_scan_", df.columns)
    taken = df.withColumn(f"{own}full", text).withColumn(f"{own}t", F.substring(f"{own}full", 1, o.max_length))
    taken = taken.withColumn(f"{own}low", F.lower(f"{own}t"))
    taken = taken.withColumns({f"{own}m{i}": matches(F.col(f"{own}t"), F.col(f"{own}low"), r) for i, r in enumerate(RULES)})
    allowed = [i for i, r in enumerate(RULES) if r.id in o.allowlist]
    scored = [i for i in range(len(RULES)) if i not in allowed]
    # the rule loop stops at the first critical hit that isn't on the allowlist: later rules neither score nor show
    last = F.lit(len(RULES))
    for i in reversed([i for i in scored if RULES[i].severity == "critical"]):
        last = F.when(F.col(f"{own}m{i}") > 0, F.lit(i)).otherwise(last)
    taken = taken.withColumn(f"{own}last", last)
    score = F.lit(0.0)
    for i in scored:
        score = score + F.when((F.col(f"{own}m{i}") > 0) & (F.lit(i) <= F.col(f"{own}last")), F.lit(WEIGHTS[RULES[i].severity])).otherwise(F.lit(0.0))
    spent = F.coalesce(F.col(budget_exceeded), F.lit(False)) if budget_exceeded else F.lit(False)
    critical = F.col(f"{own}last") < len(RULES)
    confidence = F.when(critical, F.least(F.lit(1.0), F.greatest(score, F.lit(0.9)))).otherwise(F.least(F.lit(1.0), score))
    taken = taken.withColumn(f"{own}c", confidence).withColumn("truncated", F.length(f"{own}full") > o.max_length).withColumn(f"{own}spent", spent)
    present = F.col(f"{own}full").isNotNull()
    c, t = F.col(f"{own}c"), F.col(f"{own}t")
    warn = [
        F.when(F.col("truncated"), F.lit(f"input truncated to {o.max_length} characters")),
        F.when(F.col(f"{own}spent"), F.lit(f'scan budget exceeded ({o.timeout_ms}ms); remaining rules were skipped and the decision was downgraded to "allow"')),
    ]
    result = {
        "decision": F.when(F.col(f"{own}spent"), "allow").when(c >= o.block_threshold, "block").when(c >= o.review_threshold, "review").otherwise("allow"),
        "confidence": F.when(F.col(f"{own}spent"), F.lit(0.0)).otherwise(F.round(c, 3)),
        "reasons": F.when(F.col(f"{own}spent"), F.array().cast(HIT)).otherwise(_listed(t, scored, F.col(f"{own}last"), o.mask_char, own, snippets)),
        "allowlisted_hits": _listed(t, allowed, F.col(f"{own}last"), o.mask_char, own, snippets),
        "masked_text": redact_column(F.col(f"{own}full"))["redacted"] if mask_text else F.lit(""),
        "warnings": F.filter(F.array(*warn), lambda w: w.isNotNull()),
        "scanned_length": F.length(f"{own}full").cast("long"),
    }
    out = taken.withColumns({k: F.when(present, v) for k, v in result.items()}).withColumn("ruleset", F.lit(VERSION)).withColumn("classifier_used", F.lit(False))
    return out.drop(f"{own}full", f"{own}t", f"{own}low", f"{own}c", f"{own}last", f"{own}spent", *(f"{own}m{i}" for i in range(len(RULES))))


def ruleset(spark) -> DataFrame:
    """The rule table: ord, id, category, severity, action, version."""
    return spark.createDataFrame([(i, r.id, r.category, r.severity, r.action, VERSION) for i, r in enumerate(RULES)], "ord int, id string, category string, severity string, action string, version int")


def each_reason(scanned: DataFrame, *keep: str) -> DataFrame:
    """A row for each reason: ``keep``, rule_id, matches, snippet.

    The exploded array is no bare column: from one Spark infers a filter on its size, which it pushes down to the input,
    where every search of the scan would run a second time, for each of its uses.
    """
    reasons = F.coalesce(F.col("reasons"), F.array().cast(HIT))
    own = free("_reason", keep)
    return scanned.select(*keep, F.explode(reasons).alias(own)).select(*keep, f"{own}.rule_id", f"{own}.matches", f"{own}.snippet")


def hits_by_rule(df: DataFrame, column: str = "text") -> DataFrame:
    """rule_id, n_rows, n_matches over all rows, without early exit: one pass, partial aggregation, 24 rows out."""
    rows = df.select(F.col(column).alias("t"), F.lower(column).alias("low"))
    wide = rows.select(*(matches(F.col("t"), F.col("low"), r).alias(f"m{i}") for i, r in enumerate(RULES))).agg(*(F.count_if(F.col(f"m{i}") > 0).alias(f"r{i}") for i in range(len(RULES))), *(F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"s{i}") for i in range(len(RULES))))
    rows = F.array(*(F.struct(F.lit(RULE_IDS[i]).alias("rule_id"), F.col(f"r{i}").alias("n_rows"), F.col(f"s{i}").alias("n_matches")) for i in range(len(RULES))))
    return wide.select(F.inline(rows))


