"""Addresses: IPv4 and IPv6 tests and their canonical text, host and port, MAC forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_V4_ONLY = rf"^{IPV4}$"
_H = "[0-9A-Fa-f]{1,4}"
#: Any text form of an IPv6 address without a zone: the number of parts on either side of "::" is at most seven in all.
IPV6 = "|".join(
    [f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{6}}{IPV4}", "(?:" + _H + ":){1,7}:"]
    + [f"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)]
    + [f":(?::{_H}){{1,7}}", f"(?:{_H}:){{1,4}}(?::{_H}){{0,1}}:{IPV4}", f"::(?:{_H}:){{0,5}}{IPV4}", "::"]
)


def is_ipv4(text: Column) -> Column:
    return text.rlike(_V4_ONLY)


def is_ipv6(text: Column) -> Column:
    return text.rlike(f"^(?:{IPV6})$")


def is_address(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^(?:{IPV4}|{IPV6})$"), F.lit(False))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with ``value`` computed once however often it is read."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(text: Column) -> Column:
    """The eight numbers of an IPv6 address."""
    last4 = F.regexp_extract(text, f"({IPV4})$", 1)
    octet = lambda i: F.lpad(F.hex(F.get(F.split(last4, r"\."), F.lit(i)).try_cast("long")), 2, "0")
    plain = F.when(last4 != "", F.concat(F.left(text, F.length(text) - F.length(last4)), octet(0), octet(1), F.lit(":"), octet(2), octet(3))).otherwise(text)
    part = lambda s: F.filter(F.split(F.coalesce(s, F.lit("")), ":"), lambda x: x != "")

    def numbers(halves: Column) -> Column:
        return let(
            F.struct(part(F.get(halves, F.lit(0))).alias("h"), part(F.get(halves, F.lit(1))).alias("t")),
            lambda p: F.transform(F.concat(p.h, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(p.h) - F.size(p.t), F.lit(0))), p.t), lambda x: F.conv(x, 16, 10).try_cast("long")),
        )

    return let(F.split(plain, "::"), numbers)


def canonical(text: Column) -> Column:
    """The shortest text of an address: IPv6 in lower case with its longest run of zeros as ``::``, mapped IPv4 plain; null for other texts."""

    def short(padded: Column) -> Column:
        """Of ":a:b:...:h:"."""
        longest = F.coalesce(*[F.when(padded.contains(":" + "0:" * n), F.lit(n)) for n in range(8, 1, -1)])

        def cut(n: Column) -> Column:
            zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), n))
            at = F.call_function("instr", padded, zeros)
            left, right = F.substr(padded, F.lit(1), at - 1), F.substr(padded, at + F.length(zeros))
            return F.concat(F.regexp_replace(left, "^:", ""), F.lit("::"), F.regexp_replace(right, ":$", ""))

        return F.when(longest.isNull(), F.regexp_replace(padded, "^:|:$", "")).otherwise(let(longest, cut))

    def six(w: Column) -> Column:
        mapped = (F.get(w, F.lit(5)) == 0xFFFF) & (F.array_max(F.slice(w, 1, 5)) == 0)
        bytes4 = [x.cast("string") for i in (6, 7) for x in (F.shiftright(F.get(w, F.lit(i)), 8), F.get(w, F.lit(i)).bitwiseAND(F.lit(255).cast("long")))]
        padded = F.concat(F.lit(":"), F.array_join(F.transform(w, lambda x: F.lower(F.hex(x))), ":"), F.lit(":"))
        return F.when(mapped, F.concat_ws(".", *bytes4)).otherwise(let(padded, short))

    return F.when(is_ipv4(text), text).when(is_ipv6(text), let(_words(text), six))


def host(text: Column) -> Column:
    """The host of ``host:port`` or ``[host]:port``; the text itself where there is no port."""
    return F.when(text.rlike(r"^\[.*\]:\d*$"), F.regexp_extract(text, r"^\[(.*)\]:", 1)).when(text.rlike(r"^[^:]*:\d*$"), F.substring_index(text, ":", 1)).otherwise(text)


def port(text: Column) -> Column:
    return F.when(text.rlike(r"^(?:\[.*\]|[^:]*):\d+$"), F.substring_index(text, ":", -1).try_cast("long"))


def mac(text: Column) -> Column:
    """Twelve hex digits in any usual grouping as lower-case ``aa:bb:cc:dd:ee:ff``; null otherwise."""
    digits = F.lower(F.regexp_replace(text, r"[:.\-]", ""))
    return F.when(digits.rlike(r"^[0-9a-f]{12}$"), F.concat_ws(":", *[F.substring(digits, i, 2) for i in range(1, 12, 2)]))


def short_host(name: Column) -> Column:
    """The first label; addresses, names without a dot or with a leading one stay."""
    return F.when(is_address(name) | ~name.contains(".") | name.startswith("."), name).otherwise(F.substring_index(name, ".", 1))
