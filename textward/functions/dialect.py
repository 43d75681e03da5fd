"""Patterns written with ECMAScript's meaning, made to mean the same in Java's engine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ECMAScript, inside a class.
SPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: A boundary of ASCII words.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    r"""``\s`` and ``\S`` with all of ECMAScript's white space, ``\b`` between ASCII words. ``\s`` inside a class stays a class member."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
        elif two == r"\b" and not inside:
            out.append(EDGE)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def one_line(text: Column) -> Column:
    """Control characters and runs of white space become one space; no space at the ends."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), f"[{SPACE}]+", " "))


def cut(text: Column, length: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))).otherwise(text)


def free(prefix: str, taken: Iterable[str]) -> str:
    """A beginning like ``prefix`` that no name in ``taken`` has."""
    while any(c.lower().startswith(prefix.lower()) for c in taken):
        prefix += "_"
    return prefix
