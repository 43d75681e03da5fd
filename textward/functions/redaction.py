"""Masking of personal data as column expressions: an ordered chain, each kind over the text that the last one left."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions.dialect import bound, java
from textward.functions.rules import KINDS, Kind

MAX_LENGTH = 1_000_000
#: Put round every candidate to split the text there; three private-use characters that no text holds in this order.
FENCE = "\uE000\uE001\uE000"

#: Kinds of digits, and what occurs wherever one of them matches; of the others words that every match holds, one of
#: each group. Texts without aren't searched for the kind.
OF_DIGITS, DIGITS = ("cn_mobile", "cn_id", "cn_bank", "ipv4"), r"[0-9](?:[0-9]{10}|[0-9]{0,2}\.[0-9])"
HELD = {"email": (("@",),), "api_key": (("sk-", "AKIA", "ghp_", "xox", "AIza"),), "url_credentials": (("://",), ("@",))}

FINDING = "array<struct<type:string,label:string,count:bigint,sample:string>>"


def _last(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n))


def mask(kind: str, x: Column, char: str = "*") -> Column:
    """A match of ``kind``, masked."""
    stars = lambda n: F.lit(char * n)
    if kind == "cn_mobile":
        return F.concat(F.left(x, F.length(x) - 8), stars(4), _last(x, 4))
    if kind == "cn_id":
        return F.concat(F.left(x, F.lit(4)), F.repeat(F.lit(char), F.length(x) - 8), _last(x, 4))
    if kind == "cn_bank":
        return F.concat(stars(4), _last(x, 4))
    if kind == "email":
        return F.concat(F.left(F.substring_index(x, "@", 1), F.lit(2)), stars(3), F.lit("@"), F.substring_index(x, "@", -1))
    if kind == "ipv4":
        return F.lit(".".join([char * 3] * 4))
    if kind == "api_key":
        return F.concat(F.left(x, F.lit(6)), stars(8))
    return F.concat(F.substring_index(x, "://", 1), F.lit(f"://{char * 3}:{char * 3}@"))


def accepted(kind: str, x: Column) -> Column:
    """What a candidate must pass besides its pattern; one that fails is consumed all the same."""
    if kind == "cn_bank":
        return F.call_function("luhn_check", x)
    if kind == "ipv4":
        return F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)
    return F.lit(True)


def chosen(modes: Sequence[str] | None) -> list[Kind]:
    """All kinds without modes; unknown modes are ignored."""
    return [k for k in KINDS if not modes or k.type in modes]


def _may_hold(state: Column, kind: Kind) -> Column:
    """Whether the text holds what every match of ``kind`` holds."""
    if kind.type in OF_DIGITS:
        return state["digits"]
    held = F.lit(True)
    for words in HELD[kind.type]:
        held = held & reduce(lambda a, b: a | b, (F.contains(state["text"], F.lit(w)) for w in words))
    return held


def _stage(state: Column, kind: Kind, char: str) -> Column:
    """Mask one kind in ``state`` (text, digits, findings). Texts without a candidate pay for one search at most."""
    pattern = java(kind.pattern)
    text = state["text"]
    parts = F.split(F.regexp_replace(text, pattern, FENCE + "$0" + FENCE), FENCE, -1)

    def masked(tokens: Column) -> Column:
        hit = lambda x, i: (i % 2 == 1) & accepted(kind.type, x)
        taken = F.filter(tokens, hit)
        finding = F.struct(F.lit(kind.type).alias("type"), F.lit(kind.label).alias("label"), F.size(taken).cast("long").alias("count"), mask(kind.type, F.get(taken, F.lit(0)), char).alias("sample"))
        return F.struct(
            F.array_join(F.transform(tokens, lambda x, i: F.when(hit(x, i), mask(kind.type, x, char)).otherwise(x)), "").alias("text"),
            state["digits"].alias("digits"),
            F.when(F.size(taken) > 0, F.concat(state["findings"], F.array(finding).cast(FINDING))).otherwise(state["findings"]).alias("findings"),
        )

    return F.when(_may_hold(state, kind) & text.rlike(pattern), bound(parts, masked)).otherwise(state)


def _masking(kind: Kind, char: str):
    return lambda state: _stage(state, kind, char)


def redact_column(text: Column, modes: Sequence[str] | None = None, mask_char: str = "*", max_length: int = MAX_LENGTH) -> Column:
    """struct<redacted, truncated, findings>; null for a null text."""
    def done(t: Column) -> Column:
        # masking makes no digits where the mask holds none, so they are looked for once
        digits = F.lit(True) if re.search("[0-9]", mask_char) else t.rlike(DIGITS)
        state = F.struct(F.substring(t, 1, max_length).alias("text"), digits.alias("digits"), F.array().cast(FINDING).alias("findings"))
        for kind in chosen(modes):
            state = bound(state, _masking(kind, mask_char))
        return F.when(t.isNotNull(), bound(state, lambda s: F.struct(s["text"].alias("redacted"), (F.length(t) > max_length).alias("truncated"), s["findings"].alias("findings"))))

    return bound(text, done)


def contains_pii(text: Column, modes: Sequence[str] | None = None) -> Column:
    return F.size(redact_column(text, modes)["findings"]) > 0


def mask_secret(value: Column, char: str = "*") -> Column:
    return F.when(F.length(value) <= 8, F.repeat(F.lit(char), F.least(F.length(value), F.lit(4)))).otherwise(F.concat(F.left(value, F.lit(3)), F.lit(char * 6), _last(value, 3)))
