"""Hardware metrics: rules that rename, scale and label points, one point per state, worst states."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import maps

#: States from best to worst.
RANKS = ("ok", "predicted_failure", "degraded", "failed")


def state_rank(state: Column, ranks: Sequence[str] = RANKS) -> Column:
    """Higher is worse; an unknown state is lowest."""
    out = F.lit(-1)
    for i, s in enumerate(ranks):
        out = F.when(state == s, i).otherwise(out)
    return out


def worst_state(df: DataFrame, group: list[str], state: str, ranks: Sequence[str] = RANKS) -> DataFrame:
    """The worst state per group."""
    return df.groupBy(*group).agg(F.max_by(state, F.struct(state_rank(F.col(state), ranks), F.col(state))).alias(state))


def one_hot(df: DataFrame, state: str, states: Sequence[str], name: str = "hw.state", value: str = "value") -> DataFrame:
    """A row per known state for each row: 1 for its own, 0 for others."""
    rows = df.withColumn(name, F.explode(F.array(*map(F.lit, states))))
    return rows.withColumn(value, F.coalesce(F.col(state) == F.col(f"`{name}`"), F.lit(False)).cast("long"))


def rendered(template: str, attributes: Column) -> Column:
    """``{key}`` replaced by attributes; null where one of them is missing."""
    parts = [attributes[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{[^}]*\})", template) if p]
    return F.concat(*parts) if parts else F.lit("")


@dataclass(frozen=True)
class Rule:
    """What one kind of point becomes; match: attribute -> value, an empty one for any."""

    metric: str
    target: str
    match: dict[str, str] = field(default_factory=dict)
    unit: str | None = None
    scale: float | None = None
    drop_value: float | None = None
    labels: dict[str, str] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    index_attr: str | None = None
    index_names: dict[str, str] = field(default_factory=dict)
    states: tuple[str, ...] = ()
    state_map: dict[str, str] = field(default_factory=dict)
    state_attr: str | None = None
    default_state: str | None = None

    def condition(self) -> Column:
        out = F.col("metric") == self.metric
        for k, v in self.match.items():
            out = out & (F.col("attributes")[k] == v if v else F.map_contains_key("attributes", F.lit(k)))
        return F.coalesce(out, F.lit(False))


def number_text(v: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def _points(r: Rule) -> Column:
    """What the rule makes of a point: an array of metric, unit, value and attributes; empty where it is dropped."""
    a, value = F.col("attributes"), F.col("value").cast("double")
    made: dict[str, Column] = {}
    if r.index_attr:
        made |= {"hw.id": a[r.index_attr], "hw.name": F.coalesce(maps.lookup(a[r.index_attr], r.index_names), a[r.index_attr]) if r.index_names else a[r.index_attr]}
    made |= {k: rendered(t, a) for k, t in r.labels.items()}
    made |= {k: F.lit(v) for k, v in r.constants.items()}

    def point(metric: Column, unit: Column, v: Column, attributes: Column) -> Column:
        return F.struct(metric.alias("metric"), unit.alias("unit"), v.alias("value"), attributes.alias("attributes")).cast(POINT)

    dropped = F.coalesce(F.col("value") == r.drop_value, F.lit(False)) if r.drop_value is not None else F.lit(False)
    if r.states:
        raw = a[r.state_attr] if r.state_attr else number_text(F.col("value"))
        known = maps.lookup(raw, r.state_map) if r.state_map else F.lit(None).cast("string")
        state = F.coalesce(known, F.lit(r.default_state).cast("string"))
        kept = {"hw.state.raw": F.when(known.isNull(), raw)}
        each = [point(F.lit(r.target), F.lit(r.unit or "1"), (state == s).cast("double"), maps.of({**made, "hw.state": F.lit(s), **kept})) for s in r.states]
        gone = dropped | F.coalesce(known == "drop", F.lit(False))
        return F.when(gone, F.array().cast(f"array<{POINT}>")).when(state.isNull(), F.array(unchanged())).otherwise(F.array(*each))
    one = point(F.lit(r.target), F.lit(r.unit) if r.unit else F.col("unit"), value * r.scale if r.scale is not None else value, maps.of(made))
    return F.when(dropped, F.array().cast(f"array<{POINT}>")).otherwise(F.array(one))


POINT = "struct<metric:string,unit:string,value:double,attributes:map<string,string>>"


def unchanged() -> Column:
    return F.struct("metric", "unit", F.col("value").cast("double").alias("value"), "attributes").cast(POINT)


def map_points(points: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Points (metric, unit, value double, attributes, ...) by their first rule; others pass unchanged.

    A status rule gives a point per state, 1 for the current one; a raw state
    that is mapped to ``drop`` is dropped, one that is not listed takes the
    default and keeps its raw value in hw.state.raw, and passes unchanged if
    there is no default. Rules of one call are one CASE over arrays of points,
    which are then exploded: one pass over the input, and nothing shuffles.
    """
    out = F.array(unchanged())
    for r in reversed(rules):
        out = F.when(r.condition(), _points(r)).otherwise(out)
    rest = [c for c in points.columns if c not in ("metric", "unit", "value", "attributes")]
    rows = points.select(*rest, out.alias("_points"))
    return rows.select(*rest, F.inline("_points")).select(*points.columns)


# -- NVMe health log page (512 bytes, little-endian), by fixed offsets


def _bytes_reversed(page: Column, at: int, size: int) -> Column:
    parts = [F.hex(F.substring(page, at + 1 + i, 1)) for i in reversed(range(size))]
    return F.concat(*parts)


def nvme_health(df: DataFrame, page: str = "page") -> DataFrame:
    """critical_warning, temperature_k, spare, spare_threshold, used and counters (128 bits saturate at 2^64 - 1) of each page; null for pages of other lengths."""
    p = F.col(page)
    n = lambda at, size: F.conv(_bytes_reversed(p, at, size), 16, 10).cast("decimal(20,0)")
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    wide = lambda at: F.when(n(at + 8, 8) > 0, top).otherwise(n(at, 8))
    ok = F.octet_length(p) == 512
    fields = {
        "critical_warning": n(0, 1), "temperature_k": n(1, 2), "spare": n(3, 1), "spare_threshold": n(4, 1), "used": n(5, 1),
        "units_read": wide(32), "units_written": wide(48), "reads": wide(64), "writes": wide(80), "busy_minutes": wide(96), "power_cycles": wide(112),
        "power_on_hours": wide(128), "unsafe_shutdowns": wide(144), "media_errors": wide(160), "log_entries": wide(176),
    }
    return df.withColumns({k: F.when(ok, v) for k, v in fields.items()})


# -- ATA data and threshold pages (512 bytes): a table of 30 entries of 12 bytes from byte 2 on


def _number(page: Column, at: Column | int, size: int) -> Column:
    """An unsigned little-endian number; ``at`` counts bytes from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.hex(F.substr(page, at + 1 + i, F.lit(1))) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).try_cast("long")


def smart_attributes(df: DataFrame, keep: list[str], data: str = "data", thresholds: str = "thresholds") -> DataFrame:
    """keep, id, flags, value, worst, threshold (null: none) and raw of each used entry; pages of another length give none."""
    entry = lambda i: F.lit(2) + i * 12
    d, t = F.col(data), F.col(thresholds)
    limits = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.struct(_number(t, entry(i), 1).alias("id"), _number(t, entry(i) + 1, 1).alias("limit")))
    limits = F.when(F.octet_length(t) >= 512, F.filter(limits, lambda x: x.id > 0))
    fields = F.transform(
        F.sequence(F.lit(0), F.lit(29)),
        lambda i: F.struct(
            _number(d, entry(i), 1).alias("id"), _number(d, entry(i) + 1, 2).alias("flags"), _number(d, entry(i) + 3, 1).alias("value"), _number(d, entry(i) + 4, 1).alias("worst"), _number(d, entry(i) + 5, 6).alias("raw"),
        ),
    )
    rows = df.where(F.octet_length(d) >= 512).select(*keep, limits.alias("_limits"), F.inline(fields)).where("id > 0")
    limit = F.get(F.filter("_limits", lambda x: x.id == F.col("id")), F.lit(0)).limit
    return rows.select(*keep, "id", "flags", "value", "worst", limit.alias("threshold"), "raw")


def ata_identity(df: DataFrame, page: str = "page") -> DataFrame:
    """Adds model, serial, firmware, rotation_rate, size_bytes and wwn of IDENTIFY pages; null for shorter ones. Words are 16 bits, texts have their bytes swapped in pairs."""
    p = F.col(page)
    word = lambda n: _number(p, 2 * n, 2)
    bit = lambda n, b: word(n).bitwiseAND(F.lit(1 << b).cast("long")) != 0

    def text(first: int, last: int) -> Column:
        pairs = [F.substring(p, 2 * n + 1 + k, 1) for n in range(first, last + 1) for k in (1, 0)]
        return F.trim(F.decode(F.concat(*pairs), "ISO-8859-1"), F.lit(" \x00"))

    sectors = F.when(bit(83, 10), _number(p, 200, 8)).otherwise(_number(p, 120, 4))
    own = bit(106, 14) & ~bit(106, 15) & bit(106, 12) & (_number(p, 234, 4) > 0)
    wwn = F.lower(F.concat(*[F.lpad(F.hex(word(n)), 4, "0") for n in range(108, 112)]))
    fields = {
        "model": text(27, 46), "serial": text(10, 19), "firmware": text(23, 26), "rotation_rate": word(217), "size_bytes": sectors * F.when(own, _number(p, 234, 4) * 2).otherwise(512),
        "wwn": F.when(bit(87, 14) & bit(87, 8) & (wwn != "0" * 16), wwn),
    }
    return df.withColumns({k: F.when(F.octet_length(p) >= 512, v) for k, v in fields.items()})


# -- SCSI log pages: a header of 4 bytes, then parameters of stated length, numbers big-endian

#: Codes of the pages, and of the parameters that are read from them.
ERROR_PAGES = {2: "write", 3: "read", 5: "verify"}
TEMPERATURE, START_STOP, EXCEPTIONS = 13, 14, 47
CORRECTED, UNCORRECTED, CYCLES = 3, 6, 4
NO_TEMPERATURE, FAILURE_PREDICTED = 255, 93


def _big_endian(raw: Column) -> Column:
    """An unsigned number of 1 to 8 bytes; null for other lengths."""
    return F.when(F.octet_length(raw).between(1, 8), F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)"))


def log_parameters(df: DataFrame, page: str = "page") -> DataFrame:
    """Adds page_code and parameters (code, data) of log pages, in their order; both null where a page is refused.

    Refused are pages without a whole header or with a subpage, and those in which
    a parameter reaches over the page's stated length. If the stated length reaches
    over what was read, the page was cut, and its whole parameters count.
    """
    p, size = F.col(page), F.octet_length(page)
    at = lambda i: _number(p, i, 1).cast("int")
    stated = at(2) * 256 + at(3) + 4
    end = F.least(stated, size)
    start = F.struct(F.lit(4).alias("pos"), F.array().cast("array<struct<code:int,data:binary>>").alias("found"))

    def step(s: Column, _: Column) -> Column:
        """Take the parameter at s.pos if it is whole."""
        n = at(s.pos + 3)
        whole = F.coalesce((s.pos + 4 <= end) & (s.pos + 4 + n <= end), F.lit(False))
        one = F.struct((at(s.pos) * 256 + at(s.pos + 1)).alias("code"), F.substr(p, s.pos + 5, n).alias("data"))
        return F.struct(F.when(whole, s.pos + 4 + n).otherwise(s.pos).alias("pos"), F.when(whole, F.array_append(s.found, one)).otherwise(s.found).alias("found"))

    headed = F.coalesce((size >= 4) & (F.floor(at(0) / 64) % 2 == 0) & (at(1) == 0), F.lit(False))
    read = F.when(headed, F.aggregate(F.sequence(F.lit(0), F.floor(size / 4).cast("int")), start, step))
    rows = maps.once(df.drop("page_code", "parameters"), {"_read": read})
    taken = (F.col("_read.pos") == end) | (stated > size)
    return rows.withColumns({"page_code": F.when(taken, at(0) % 64), "parameters": F.when(taken, F.col("_read.found"))}).drop("_read")


def log_pages(df: DataFrame, page: str = "page") -> DataFrame:
    """Adds page_code, operation, corrected, uncorrected, celsius, cycles, sense, qualifier and predicted_failure of log pages.

    Null where the page is another, is refused (log_parameters) or doesn't say;
    corrected counts are 0 if an error page lists none. A page of exceptions
    without a whole first parameter is refused. Of equal codes the last counts.
    """
    rows = log_parameters(df, page)
    code = F.col("page_code")

    def last(wanted: int, ok) -> Column:
        return F.try_element_at(F.filter("parameters", lambda x: (x.code == wanted) & ok(x.data)), F.lit(-1)).data

    number = lambda wanted: _big_endian(last(wanted, lambda d: F.octet_length(d).between(1, 8)))
    byte = lambda d, i: _number(d, i, 1)
    errors, newest = code.isin(*ERROR_PAGES), last(0, lambda d: F.octet_length(d) >= 2)
    heat = F.when(code == TEMPERATURE, byte(last(0, lambda d: (F.octet_length(d) >= 2) & (byte(d, 1) != NO_TEMPERATURE)), 1))
    heat = heat.when(code == EXCEPTIONS, byte(last(0, lambda d: (F.octet_length(d) >= 3) & (byte(d, 2) != NO_TEMPERATURE)), 2))
    refused = (code == EXCEPTIONS) & newest.isNull()
    sense = F.when(code == EXCEPTIONS, byte(newest, 0))
    fields = {
        "operation": maps.lookup(code.cast("string"), {str(k): v for k, v in ERROR_PAGES.items()}),
        "corrected": F.when(errors, F.coalesce(number(CORRECTED), F.lit(0).cast("decimal(20,0)"))),
        "uncorrected": F.when(errors, number(UNCORRECTED)),
        "celsius": heat,
        "cycles": F.when(code == START_STOP, number(CYCLES)),
        "sense": sense,
        "qualifier": F.when(code == EXCEPTIONS, byte(newest, 1)),
        "predicted_failure": sense == FAILURE_PREDICTED,
    }
    return rows.withColumns({**fields, "page_code": F.when(~refused, code)}).drop("parameters")


# -- power supplies and replaceable units


def power_supply_state(offsets: Column) -> Column:
    """The state by a sensor's asserted offsets: 0 present, 1 failed, 2 failing soon, 3 and 4 no input, 5 input out of range, 6 misconfigured; null if not present."""
    any_of = lambda *n: F.arrays_overlap(offsets, F.array(*map(F.lit, n)))
    return F.when(F.array_contains(offsets, 0), F.when(any_of(1, 3, 4), "failed").when(any_of(2), "predicted_failure").when(any_of(5, 6), "degraded").otherwise("ok"))


#: The fields of each area of a unit's record in order, and where they begin.
FRU_AREAS = {
    "chassis": (2, 3, ("part_number", "serial_number")),
    "board": (3, 6, ("vendor", "model", "serial_number", "part_number")),
    "product": (4, 3, ("vendor", "model", "part_number", "version", "serial_number", "asset_tag")),
}
_BCD = "0123456789 -.???"


def _fru_text(kind: Column, raw: Column) -> Column:
    """By the field's type: 3 text, 2 six-bit characters, 1 decimal digits, 0 bytes as hex."""
    h = F.hex(raw)
    whole = F.array_join(F.transform(F.sequence(F.octet_length(raw) - 1, F.lit(0)), lambda i: F.lpad(F.bin(F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")), 8, "0")), "")
    n = F.floor(F.octet_length(raw) * 8 / 6).cast("int")
    six = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.chr(F.conv(F.substr(whole, F.length(whole) - i * 6 + 1, F.lit(6)), 2, 10).cast("long") + 32)), "")
    digits = F.translate(h, "ABCDEF", _BCD[10:])
    return F.rtrim(F.when(F.octet_length(raw) == 0, "").when(kind == 3, F.decode(raw, "ISO-8859-1")).when(kind == 2, F.when(n > 0, six).otherwise("")).when(kind == 1, digits).otherwise(F.lower(h)), F.lit(" \x00"))


def unit_records(df: DataFrame, keep: list[str], image: str = "image") -> DataFrame:
    """keep, area, key and value of the named fields of units' records (images with a common header).

    An area counts if its format is 1, it lies inside the image and its bytes sum
    up to 0 modulo 256. Fields follow each other: a byte with type and length,
    then the text; they end at 0xC1, at 0 or at the area's checksum.
    """
    img = F.col(image)
    at = lambda p: _number(img, p, 1)
    areas = F.array(*[F.struct(F.lit(name).alias("area"), (at(slot) * 8).cast("int").alias("off"), F.lit(first).alias("first"), F.array(*map(F.lit, names)).alias("names")) for name, (slot, first, names) in FRU_AREAS.items()])
    rows = df.where((F.octet_length(img) >= 8) & (at(0).bitwiseAND(F.lit(15).cast("long")) == 1)).select(*keep, F.col(image).alias("_image"), F.inline(areas)).where("off >= 8")
    size = (_number(F.col("_image"), F.col("off") + 1, 1) * 8).cast("int")
    rows = rows.withColumn("_area", F.substr("_image", F.col("off") + 1, size)).where((F.octet_length("_area") >= 8) & (F.octet_length("_area") == size))
    total = lambda a: F.aggregate(F.transform(F.sequence(F.lit(0), F.octet_length(a) - 1), lambda i: _number(a, i, 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.where((_number(F.col("_area"), 0, 1).bitwiseAND(F.lit(15).cast("long")) == 1) & (F.pmod(total(F.col("_area")), F.lit(256)) == 0))
    a, end = F.col("_area"), F.octet_length("_area") - 1
    start = F.struct(F.col("first").alias("pos"), F.lit(False).alias("done"), F.array().cast("array<struct<kind:bigint,raw:binary>>").alias("found"))

    def step(s: Column, _: Column) -> Column:
        """Read the field at s.pos, or be done."""
        head = F.when(s.pos < end, _number(a, s.pos, 1))
        n = head.bitwiseAND(F.lit(63).cast("long")).cast("int")
        over = s.done | head.isNull() | head.isin(0, 193) | (s.pos + 1 + n > end)
        one = F.struct(F.shiftright(head, 6).alias("kind"), F.substr(a, s.pos + 2, n).alias("raw"))
        return F.struct(F.when(over, s.pos).otherwise(s.pos + 1 + n).alias("pos"), over.alias("done"), F.when(over, s.found).otherwise(F.array_append(s.found, one)).alias("found"))

    fields = F.aggregate(F.sequence(F.lit(1), F.size("names")), start, step)["found"]
    cells = F.transform(F.arrays_zip(F.slice("names", F.lit(1), F.size(fields)).alias("key"), fields.alias("f")), lambda z: F.struct(z.key.alias("key"), _fru_text(z.f.kind, z.f.raw).alias("value")))
    return rows.select(*keep, "area", F.inline(cells)).where("key IS NOT NULL AND value <> ''")


# -- firmware texts

#: What firmware writes where it has no value.
PLACEHOLDERS = (
    "to be filled by o.e.m.", "to be filled by oem", "default string", "not specified", "not applicable", "not available", "n/a", "na", "none", "unknown", "undefined", "unspecified", "o.e.m.", "oem", "empty", "default",
    "system product name", "system manufacturer", "system version", "system serial number", "base board serial number", "base board product name", "base board manufacturer", "base board version", "chassis serial number",
    "chassis manufacturer", "chassis version", "serial number", "no dimm", "no module installed", "not installed", "type1productconfigid", "123456789", "0123456789", "0123456789abcdef",
)
FILL, MOST_TEXT = "0fFxX-._*?#", 128


def firmware_text(value: Column) -> Column:
    """Without control characters and blanks at the ends; null where it says nothing: a placeholder, or one fill character over and over."""
    clean = F.left(F.trim(F.regexp_replace(value, r"[\x00-\x1f\x7f]", "")), F.lit(MOST_TEXT))
    low, first = F.lower(clean), F.left(clean, F.lit(1))
    fill = F.lit(FILL).contains(first) & (F.replace(clean, first, F.lit("")) == "")
    return F.when((clean != "") & ~low.isin(*PLACEHOLDERS) & ~low.startswith("to be filled") & ~fill, clean)


def inventory_points(facts: DataFrame, keep: list[str], attributes: str = "attributes") -> DataFrame:
    """keep, attributes and value 1 of each fact whose cleaned attributes say more than its id."""
    cleaned = F.map_filter(F.transform_values(attributes, lambda _, v: firmware_text(v)), lambda _, v: v.isNotNull())
    rows = maps.once(facts, {attributes: cleaned})
    return rows.where(F.exists(F.map_keys(attributes), lambda k: k != "hw.id")).select(*keep, attributes, F.lit(1).cast("long").alias("value"))
