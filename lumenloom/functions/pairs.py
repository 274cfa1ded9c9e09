"""``key=value`` runs inside a line."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.bodies import quoted
from lumenloom.functions.patterns import re2

_KEY = r"[\w]+"
#: Pairs of a line: values in double quotes or bare; in single quotes; in double quotes with escapes or bare, perhaps empty.
PAIR = _KEY + r'=(?:"[^"]*"|\S+)'
SINGLE_QUOTED = _KEY + r"='[^']*'"
ESCAPED = r'[\w.-]+=(?:"(?:[^"\\]|\\.)*+"|\S*)'
#: What pairs are held as: keys and values in order, and both from the last to the first.
KIND = "struct<k:array<string>,v:array<string>,kr:array<string>,vr:array<string>>"
_ESCAPES = (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\"))


def found(line: Column, pattern: str = PAIR) -> Column:
    """All pairs in order, as a KIND; the line is searched once, and values lose their quotes.

    With the pattern ESCAPED backslash escapes in quoted values are undone.
    """

    def plain(pair: Column) -> Column:
        value = F.substr(pair, F.length(F.substring_index(pair, "=", 1)) + 2)
        inner = F.substr(value, F.lit(2), F.length(value) - 2)
        if pattern == ESCAPED:
            undone = inner
            for a, b in _ESCAPES:
                undone = F.replace(undone, F.lit(a), F.lit(b))
            inner = F.when(inner.contains("\\"), undone).otherwise(inner)
        return F.when(F.left(value, F.lit(1)).isin('"', "'") & (F.length(value) > 1) & (F.left(value, F.lit(1)) == F.right(value, F.lit(1))), inner).otherwise(value)

    all_of = F.regexp_extract_all(line, F.lit(re2(pattern)), 0)
    keys, values = F.transform(all_of, lambda p: F.substring_index(p, "=", 1)), F.transform(all_of, plain)
    return F.struct(keys.alias("k"), values.alias("v"), F.reverse(keys).alias("kr"), F.reverse(values).alias("vr"))


def _nth(values: Column, at: Column) -> Column:
    return F.get(values, (at - 1).cast("int"))


def value(pairs: Column, *keys: str) -> Column:
    """The first non-empty value of the first key that has one."""

    def of(key: str) -> Column:
        at = F.array_position(pairs.k, key)
        later = F.get(F.filter(F.arrays_zip(pairs.k.alias("k"), pairs.v.alias("v")), lambda p: (p.k == key) & (p.v != "")), F.lit(0)).v
        one = _nth(pairs.v, at)
        return F.when((at > 0) & (one != ""), one).when(at > 0, later)

    return F.coalesce(*map(of, keys))


def last_value(pairs: Column, key: str) -> Column:
    at = F.array_position(pairs.kr, key)
    return F.when(at > 0, F.nullif(_nth(pairs.vr, at), F.lit("")))


def line(pairs: Column, but: Iterable[str]) -> Column:
    """``k=v k=v`` of the other keys with a value, in order."""
    left_out = list(but)
    text = F.zip_with(pairs.k, pairs.v, lambda k, v: F.when((v != "") & ~k.isin(left_out), F.concat(k, F.lit("="), quoted(v))))
    return F.array_join(text, " ")


def as_map(pairs: Column, prefix: str, but: Iterable[str]) -> Column:
    """The other keys behind a prefix; of a repeated key the last value that is not empty."""
    left_out = list(but)
    cells = F.filter(F.zip_with(pairs.kr, pairs.vr, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda p: (p.v != "") & ~p.k.isin(left_out))
    names = F.array_distinct(F.transform(cells, lambda p: p.k))
    kept = F.transform(cells, lambda p: p.k)
    values = F.transform(names, lambda k: F.get(cells, (F.array_position(kept, k) - 1).cast("int")).v)
    return F.map_from_arrays(F.transform(names, lambda k: F.concat(F.lit(prefix), k)), values)
