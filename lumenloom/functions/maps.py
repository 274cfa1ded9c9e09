"""Attribute maps: put, fill, drop and rename keys without ever holding a key twice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.network import let


def once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` with these columns, each computed once for a row however often it is read.

    A plain projection may be merged into what reads it, which repeats costly
    expressions, or puts them under a lambda, where they are not compiled. One
    below a generator of one row is not merged.
    """
    keep = [c for c in df.columns if c not in values]
    named = {k: f"_once_{i}" for i, k in enumerate(values)}
    made = df.select(*keep, *[values[k].alias(n) for k, n in named.items()])
    return made.select(*keep, F.inline(F.array(F.struct(*[F.col(n).alias(k) for k, n in named.items()]))))


def named(keys: Column, values: Column) -> Column:
    """A map of an array of keys and one of values, without the null values."""
    return F.map_filter(F.map_from_arrays(keys, values), lambda _, v: v.isNotNull())


def lookup(key: Column, table: dict[str, object]) -> Column:
    """What a constant table has for the key, null where it has none."""
    cells = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*cells), key)


def empty() -> Column:
    return F.create_map().cast("map<string,string>")


def of(values: dict[str, Column]) -> Column:
    """A map of the values that are not null."""
    if not values:
        return empty()
    cells: list[Column] = []
    for k, v in values.items():
        cells += [F.lit(k), v.cast("string")]
    return F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull())


def overwrite(base: Column, values: dict[str, Column]) -> Column:
    """``base`` with ``values``; a null value leaves what is there."""
    if not values:
        return base

    def stays(key: Column, _: Column) -> Column:
        out = F.lit(True)
        for k, v in values.items():
            out = F.when(key == k, v.isNull()).otherwise(out)
        return out

    return F.map_concat(F.map_filter(base, stays), of(values))


def fill(base: Column, values: dict[str, Column]) -> Column:
    """``base`` and those ``values`` whose keys it lacks."""
    if not values:
        return base
    return F.map_concat(base, of({k: F.when(~F.map_contains_key(base, k), v) for k, v in values.items()}))


def merge(base: Column, other: Column) -> Column:
    """Two maps; the other wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(other, k)), other)


def without(base: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(base, lambda k, _: ~k.isin(keys)) if keys else base


def only(base: Column, keys: Iterable[str]) -> Column:
    return F.map_filter(base, lambda k, _: k.isin(list(keys)))


def prefixed(base: Column, prefix: str, but: Iterable[str] = ()) -> Column:
    """The entries with other keys than ``but`` and values that are not null, each key behind ``prefix``."""
    but = list(but)
    kept = F.map_filter(base, lambda k, v: v.isNotNull() & ~k.isin(but)) if but else F.map_filter(base, lambda _, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, _: F.concat(F.lit(prefix), k))


def rename(base: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Old keys become new ones; of several for one new key the new key itself, then the first pair wins."""
    pairs = list(pairs)
    old = [a for a, _ in pairs]

    def renamed(base: Column) -> Column:
        takes: dict[str, list[Column]] = {}
        for a, b in pairs:
            takes.setdefault(b, []).append(base[a])
        found = {b: F.when(~F.map_contains_key(base, b), F.coalesce(*v)) for b, v in takes.items()}
        return F.map_concat(without(base, [k for k in old if k not in takes]), of(found))

    return let(base, renamed)


def first_of(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
