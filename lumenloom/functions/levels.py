"""Severity: raw levels to numbers of 1 to 24, and numbers to their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACE, DEBUG, INFO, WARN, ERROR, FATAL = 1, 5, 9, 13, 17, 21

#: The words of each level, and each source's own marks.
WORDS = {
    TRACE: ["trace"],
    DEBUG: ["debug"],
    INFO: ["info", "notice"],
    WARN: ["warn", "warning"],
    ERROR: ["error", "eror", "err"],
    FATAL: ["fatal", "critical", "crit", "alert", "emergency", "panic", "dpanic"],
}
TABLES = {
    "klog": {INFO: ["I"], WARN: ["W"], ERROR: ["E"], FATAL: ["F"]},
    "mongod": {DEBUG: ["D1", "D2", "D3", "D4", "D5"], INFO: ["I"], WARN: ["W"], ERROR: ["E"], FATAL: ["F"]},
    "clickhouse": {TRACE: ["Trace"], DEBUG: ["Debug"], INFO: ["Information", "Notice"], WARN: ["Warning"], ERROR: ["Error"], FATAL: ["Critical", "Fatal"]},
    "postgres": {DEBUG: ["DEBUG", "DEBUG1", "DEBUG2", "DEBUG3", "DEBUG4", "DEBUG5"], INFO: ["LOG", "INFO", "NOTICE"], WARN: ["WARNING"], ERROR: ["ERROR"], FATAL: ["FATAL", "PANIC"]},
    "pino": {TRACE: ["10"], DEBUG: ["20"], INFO: ["30"], WARN: ["40"], ERROR: ["50"], FATAL: ["60"]},
    "redis": {DEBUG: ["."], INFO: ["-", "*"], WARN: ["#"]},
}


def _pick(raw: Column, table: dict[int, list[str]]) -> Column:
    out = F.lit(None).cast("int")
    for number, marks in reversed(table.items()):
        out = F.when(raw.isin(marks), F.lit(number)).otherwise(out)
    return out


def from_word(raw: Column) -> Column:
    return _pick(F.lower(F.trim(raw)), WORDS)


def from_source(source: str, raw: Column) -> Column:
    return _pick(F.trim(raw), TABLES[source])


def from_http(status: Column) -> Column:
    return F.when(status.between(500, 599), ERROR).when(status.between(400, 499), WARN).when(status.between(100, 399), INFO)


def from_dns(code: Column) -> Column:
    c = F.upper(code)
    return F.when(c.isin("SERVFAIL", "REFUSED"), WARN).when(c.isin("NOERROR", "NXDOMAIN"), INFO)


def from_priority(priority: Column) -> Column:
    """The level of a syslog priority: its last three bits."""
    low = priority.cast("string").try_cast("int").bitwiseAND(7)
    return F.when(low == 0, 24).when(low == 1, FATAL).when(low <= 3, ERROR).when(low == 4, WARN).when(low <= 6, INFO).when(low == 7, DEBUG)


def text(number: Column) -> Column:
    out = F.when(number.between(1, 4), "TRACE")
    for low, word in ((5, "DEBUG"), (9, "INFO"), (13, "WARN"), (17, "ERROR"), (21, "FATAL")):
        out = out.when(number.between(low, low + 3), word)
    return out
