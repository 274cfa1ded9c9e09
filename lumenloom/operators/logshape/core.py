"""Ordered first-match shaping of log records, as one projection.

A branch claims records by their shape and turns them into one form: a one-line
body, standard attribute names, a severity and the time of the line. The first
branch that claims a record shapes it; others pass unchanged. No step shuffles:
a record's resource is a column of its own row.

Input columns are ``body``, and where they exist ``attributes``, ``resource``
(string maps), ``severity_number``, ``ts_us`` (microseconds) and ``scope_name``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import levels, maps, pairs
from lumenloom.functions.cuts import Cut
from lumenloom.functions.patterns import group

ORIGINAL = "log.record.original"


#: Columns of a record that shapes read, computed once each: the claimed line, groups, fields and pairs.
SLOTS = {
    "line": "string",
    "caps": "array<string>",
    "json": "map<string,string>",
    "caps2": "array<string>",
    "json2": "map<string,string>",
    "kv": pairs.KIND,
    "caps3": "array<string>",
}
#: Slots of one level may read those of the levels before.
LEVELS = (("line",), ("caps",), ("json", "caps2"), ("json2", "kv", "caps3"))


@dataclass
class Rec:
    """A record's columns, as claims and shapes read them."""

    text: Column
    attributes: Column
    resource: Column
    severity: Column
    ts_us: Column
    options: dict = field(default_factory=dict)

    line = property(lambda self: F.col("_line"))
    caps = property(lambda self: F.col("_caps"))
    caps2 = property(lambda self: F.col("_caps2"))
    caps3 = property(lambda self: F.col("_caps3"))
    json = property(lambda self: F.col("_json"))
    json2 = property(lambda self: F.col("_json2"))
    kv = property(lambda self: F.col("_kv"))

    def a(self, key: str) -> Column:
        return F.nullif(self.attributes[key], F.lit(""))

    def r(self, key: str) -> Column:
        return F.nullif(self.resource[key], F.lit(""))

    def has(self, *keys: str) -> Column:
        out = F.lit(False)
        for k in keys:
            out = out | F.map_contains_key(self.attributes, k)
        return out

    def any(self, *keys: str) -> Column:
        """The first non-empty value, each key in the record and then in its resource."""
        return F.coalesce(*[x for k in keys for x in (self.a(k), self.r(k))])

    def source(self) -> Column:
        return F.coalesce(self.a("log.source"), self.r("log.source"))

    def g(self, i: int) -> Column:
        return group(self.caps, i)

    def g2(self, i: int) -> Column:
        return group(self.caps2, i)

    def g3(self, i: int) -> Column:
        return group(self.caps3, i)

    def j(self, key: str) -> Column:
        return self.json[key]

    def number(self, *keys: str) -> Column:
        return F.coalesce(*[F.trim(self.attributes[k]).try_cast("double") for k in keys])

    def ext(self, name: str) -> str:
        """A name without an official one, under the caller's own prefix."""
        return f"{self.options.get('prefix', 'ext')}.{name}"


@dataclass
class Shape:
    """What a branch makes of a record; null values leave what is there."""

    body: Column | None = None
    level: Column | None = None
    ts_us: Column | None = None
    put: dict[str, Column] = field(default_factory=dict)
    fill: dict[str, Column] = field(default_factory=dict)
    more: Column | None = None
    drop: Sequence[str] = ()
    resource: dict[str, Column] = field(default_factory=dict)
    resource_fill: dict[str, Column] = field(default_factory=dict)
    scope: Column | None = None
    original: bool = True
    clear_level: bool = False


@dataclass(frozen=True)
class Branch:
    """gate: cheap tests that every claimed record passes; cuts: the fields of the line, as rec.g(i); slots: the other columns that shape reads."""

    name: str
    shape: Callable[[Rec], Shape]
    gate: Callable[[Rec], Column]
    claim: Callable[[Rec], Column] | None = None
    cuts: Callable[[Column], Cut] | None = None
    text_of: Callable[[Rec], Column] | None = None
    slots: dict[str, Callable[[Rec], Column]] = field(default_factory=dict)

    def text(self, rec: Rec) -> Column:
        return self.text_of(rec) if self.text_of else rec.text

    def claims(self, rec: Rec) -> Column:
        out = self.gate(rec)
        if self.cuts:
            out = out & self.cuts(self.text(rec)).ok
        if self.claim:
            out = out & self.claim(rec)
        return F.coalesce(out, F.lit(False))

    def slot(self, name: str, rec: Rec) -> Column | None:
        if name in self.slots:
            return self.slots[name](rec)
        return self.cuts(self.text(rec)).array if name == "caps" and self.cuts else None


RESULT = "struct<branch:string,body:string,severity_number:int,severity_text:string,ts_us:bigint,attributes:map<string,string>,resource:map<string,string>,scope_name:string>"
#: The parts of a shape that are maps: their values are computed as arrays, in compiled code, and named by the branch's keys after.
_PARTS = ("put", "fill", "res", "res_fill")
_RAW = "struct<body:string,level:int,ts_us:bigint,more:map<string,string>,scope:string,put:array<string>,fill:array<string>,res:array<string>,res_fill:array<string>>"


def begins(text: Column, chars: str) -> Column:
    """Its first character is one of these."""
    return F.substring(text, 1, 1).isin(list(chars))


def needs(text: Column, *parts: str) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & text.contains(p)
    return out


def object_text(text: Column) -> Column:
    return F.trim(text).startswith("{")


def as_object(text: Column) -> Column:
    """The fields of a JSON object as text, inner objects as JSON; null for other texts."""
    return F.from_json(F.trim(text), "map<string,string>")


def claimed_by(rec: Rec, branches: Iterable[Branch]) -> Column:
    pairs = [(b.claims(rec), F.lit(b.name)) for b in branches]
    return _case(pairs, "string")


def _case(pairs: list[tuple[Column, Column]], kind: str) -> Column:
    """One flat CASE; null where no condition holds."""
    if not pairs:
        return F.lit(None).cast(kind)
    out = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out


def record(df: DataFrame, options: dict | None = None, body: str = "body") -> Rec:
    has = set(df.columns)
    return Rec(
        text=F.coalesce(F.col(body), F.lit("")),
        attributes=F.coalesce(F.col("attributes"), maps.empty()) if "attributes" in has else maps.empty(),
        resource=F.coalesce(F.col("resource"), maps.empty()) if "resource" in has else maps.empty(),
        severity=F.col("severity_number").cast("int") if "severity_number" in has else F.lit(None).cast("int"),
        ts_us=F.col("ts_us").cast("long") if "ts_us" in has else F.lit(None).cast("long"),
        options=options or {},
    )


def _parts(rec: Rec, s: Shape) -> dict[str, dict[str, Column]]:
    fill = dict(s.fill)
    if s.original and rec.options.get("keep_original", True):
        fill.setdefault(ORIGINAL, F.nullif(rec.text, F.lit("")))
    return {"put": s.put, "fill": fill, "res": s.resource, "res_fill": s.resource_fill}


def _raw(rec: Rec, s: Shape) -> Column:
    null = lambda kind: F.lit(None).cast(kind)
    values = [F.array(*[v.cast("string") for v in p.values()]).cast("array<string>").alias(k) for k, p in _parts(rec, s).items()]
    return F.struct(
        (s.body if s.body is not None else null("string")).cast("string").alias("body"),
        (s.level if s.level is not None else null("int")).cast("int").alias("level"),
        (s.ts_us if s.ts_us is not None else null("long")).cast("long").alias("ts_us"),
        (s.more if s.more is not None else null("map<string,string>")).alias("more"),
        (s.scope if s.scope is not None else null("string")).cast("string").alias("scope"),
        *values,
    ).cast(_RAW)


def _layered(base: Column, dropped: Column | None, *layers: tuple[Column | None, bool]) -> Column:
    """base without the dropped keys, then layer on layer: (map or None, wins over what is below)."""
    out = base if dropped is None else F.map_filter(base, lambda k, _: ~F.array_contains(dropped, k))
    for layer, wins in layers:
        if layer is not None:
            out = maps.merge(out, layer) if wins else maps.merge(layer, out)
    return out


def shaped(df: DataFrame, branches: Sequence[Branch], options: dict | None = None, body: str = "body", only: Column | None = None) -> DataFrame:
    """Adds _shaped, a RESULT, null where no branch claims the record, or where ``only`` does not hold.

    Each level of slots is a projection of its own, so that a pattern runs once
    for a record and the expressions stay small.
    """
    rec = record(df, options, body)
    claimed = claimed_by(rec, branches)
    df = df.withColumn("_branch", claimed if only is None else F.when(only, claimed))
    at = F.col("_branch")
    for level in LEVELS:
        cols = {}
        for slot in level:
            found = [(at == b.name, c.cast(SLOTS[slot])) for b in branches if (c := b.slot(slot, rec)) is not None]
            cols[f"_{slot}"] = _case(found, SLOTS[slot])
        df = df.withColumns(cols)
    shapes = {b.name: b.shape(rec) for b in branches}
    df = maps.once(df, {"_raw": _case([(at == n, _raw(rec, s)) for n, s in shapes.items()], _RAW)})
    s = lambda k: F.col(f"_raw.{k}")
    none = maps.empty()
    texts = lambda keys: F.array(*map(F.lit, keys)).cast("array<string>")

    def part(k: str) -> Column | None:
        """A map of one kind over all branches, null where the branch has none of it."""
        found = [(at == n, texts(p)) for n, shape in shapes.items() if (p := _parts(rec, shape)[k])]
        return maps.named(_case(found, "array<string>"), s(k)) if found else None

    dropped = [(at == n, texts([k for k in shape.drop if k not in shape.put])) for n, shape in shapes.items() if shape.drop]
    clear = [n for n, shape in shapes.items() if shape.clear_level]
    level = F.when(~at.isin(clear), F.coalesce(s("level"), rec.severity)) if clear else F.coalesce(s("level"), rec.severity)
    scope = F.col("scope_name") if "scope_name" in df.columns else F.lit(None).cast("string")
    put, fill, res, res_fill = (None if m is None else F.coalesce(m, none) for m in map(part, _PARTS))
    more = F.coalesce(s("more"), none) if any(shape.more is not None for shape in shapes.values()) else None
    df = df.withColumns({
        "_level": level,
        "_attributes": _layered(rec.attributes, F.coalesce(_case(dropped, "array<string>"), texts([])) if dropped else None, (put, True), (fill, False), (more, True)),
        "_resource": _layered(rec.resource, None, (res, True), (res_fill, False)),
    })
    out = F.struct(
        at.alias("branch"),
        F.coalesce(F.nullif(s("body"), F.lit("")), rec.text).alias("body"),
        F.col("_level").alias("severity_number"),
        levels.text(F.col("_level")).alias("severity_text"),
        F.coalesce(s("ts_us"), rec.ts_us).alias("ts_us"),
        F.col("_attributes").alias("attributes"),
        F.col("_resource").alias("resource"),
        F.coalesce(F.nullif(s("scope"), F.lit("")), scope).alias("scope_name"),
    ).cast(RESULT)
    return df.withColumn("_shaped", F.when(at.isNotNull(), out))


OUT = ("branch", "body", "severity_number", "severity_text", "ts_us", "attributes", "resource", "scope_name")


def flatten(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The fields of _shaped in place of the record's own, which stay where it is null; of the other columns with an underscore only ``keep`` stay."""
    rec = record(df)
    own = {
        "body": F.col("body"),
        "severity_number": rec.severity,
        "severity_text": F.col("severity_text") if "severity_text" in df.columns else levels.text(rec.severity),
        "ts_us": rec.ts_us,
        "attributes": rec.attributes,
        "resource": rec.resource,
        "scope_name": F.col("scope_name") if "scope_name" in df.columns else F.lit(None).cast("string"),
    }
    took = F.col("_shaped").isNotNull()
    rest = [c for c in df.columns if c not in OUT and (not c.startswith("_") or c in keep)]
    return df.select(
        *rest,
        F.col("_shaped.branch").alias("branch"),
        *[F.when(took, F.col(f"_shaped.{k}")).otherwise(v).alias(k) for k, v in own.items()],
    )
