"""Regular expressions in RE2's dialect, run by Spark's Java engine."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\t\n\f\r "
_MARK = "\u0001"


@functools.cache
def re2(pattern: str) -> str:
    """The Java twin: ``$`` is the very end, ``.`` stops at \\n alone, ``\\s`` has no vertical tab."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            if n == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif n == "S":
                if in_class:
                    raise ValueError(f"\\S in a class: {pattern}")
                out.append(f"[^{_SPACE}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class and c in "[&":
            out.append("\\" + c)
        elif c == "$" and not in_class:
            out.append(r"\z")
        else:
            out.append(c)
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        i += 1
    return "(?d)" + "".join(out)


@functools.cache
def groups(pattern: str) -> int:
    """Number of capturing groups."""
    n, i, in_class = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "(" and not in_class and pattern[i + 1] != "?":
            n += 1
        i += 1
    return n


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(re2(pattern))


def captures(text: Column, pattern: str) -> Column:
    """All groups of a pattern anchored at both ends, in one pass; group i at place i, no such place if it doesn't match.

    Groups stand behind a control character, which is left out of a text that holds it.
    """
    marks = "".join(f"{_MARK}${i}" for i in range(1, groups(pattern) + 1))
    clean = F.when(text.contains(_MARK), F.translate(text, _MARK, "")).otherwise(text)
    return F.split(F.regexp_replace(clean, re2(pattern), marks), _MARK)


def group(caps: Column, i: int) -> Column:
    """Group i of captures(); null if it is empty or absent."""
    return F.nullif(F.get(caps, F.lit(i)), F.lit(""))


def first(text: Column, pattern: str, i: int = 1) -> Column:
    """Group i of the first match, null if empty or absent."""
    return F.nullif(F.regexp_extract(text, re2(pattern), i), F.lit(""))


def glob(pattern: str, star_crosses_slash: bool = True) -> str:
    """An anchored pattern for a shell glob with ``*`` and ``?``."""
    any_one = "." if star_crosses_slash else "[^/]"
    parts = [f"{any_one}*" if c == "*" else any_one if c == "?" else "\\" + c if c in r".^$+{}[]()|\/" else c for c in pattern]
    return "^" + "".join(parts) + "$"
