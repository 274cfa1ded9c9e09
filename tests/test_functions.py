"""Helpers: pattern dialect, addresses, bodies, levels, maps, times."""

import re

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import bodies, cleaning, levels, maps, network, times
from lumenloom.functions.patterns import captures, glob, groups, matches, re2


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_dialect(spark):
    r = one(
        spark, a=matches(F.lit("ab\n"), "^(ab)$"), b=matches(F.lit("x\ry"), "^x.y$"), c=matches(F.lit("a\x0bb"), r"a\sb"), d=matches(F.lit("a]b"), r"[^\]]\]b"), n=F.size(captures(F.lit("k=v"), r"^(\w)=(\w)(z)?$")), m=F.size(captures(F.lit("nope"), r"^(\w)=(\w)$")),
    )
    assert (r.a, r.b, r.c, r.d, r.n, r.m) == (False, True, False, True, 4, 1)
    assert groups(r"(a)(?:b)[(](\()") == 2
    assert re.fullmatch(glob("a*.[x]", False), "ab.[x]") and not re.fullmatch(glob("a*b", False), "a/b")
    with pytest.raises(ValueError):
        re2(r"[\S]")


ADDRESSES = {
    "10.0.0.1": "10.0.0.1", "256.1.1.1": None, "01.1.1.1": None, "::": "::", "::1": "::1", "1::": "1::", "2001:DB8::0:1": "2001:db8::1", "1:0:0:2:0:0:0:3": "1:0:0:2::3", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8",
    "::ffff:1.2.3.4": "1.2.3.4", "1:2:3:4:5:6:7": None, "1::2::3": None, "12345::": None, "fe80::1%eth0": None, "": None, "0:0:1::": "0:0:1::", "1:0:2:0:3:0:4:0": "1:0:2:0:3:0:4:0",
}


def test_addresses(spark):
    import ipaddress

    df = spark.createDataFrame(list(ADDRESSES.items()), "t string, w string").select("t", "w", network.canonical(F.col("t")).alias("g"), network.is_address(F.col("t")).alias("ok"))
    for r in df.collect():
        if r.w is not None and "." not in r.w:
            assert str(ipaddress.ip_address(r.t)) == r.w
        assert r.g == r.w and r.ok == (r.w is not None), r.t


def test_hosts_and_macs(spark):
    r = one(spark, a=network.host(F.lit("[::1]:80")), b=network.port(F.lit("h:8080")), c=network.host(F.lit("plain")), d=network.mac(F.lit("0011.2233.4455")), e=network.short_host(F.lit("a.b.c")), f=network.short_host(F.lit("10.0.0.1")), g=network.short_host(F.lit(".x.y")))
    assert tuple(r) == ("::1", 8080, "plain", "00:11:22:33:44:55", "a", "10.0.0.1", ".x.y")


def test_bodies(spark):
    r = one(
        spark, a=bodies.size_text(F.lit(1280)), b=bodies.size_text(F.lit(52428)), c=bodies.duration_text(F.lit(61_000_000)), d=bodies.duration_text(F.lit(20511)), e=bodies.duration_text(F.lit(0)), f=bodies.compose(F.lit("c"), F.lit("t"), {"k": F.lit('a "b"'), "z": F.lit("")}),
        g=bodies.http_line(F.lit("get"), F.lit("/x"), F.lit(404), host=F.lit("h"), micros=F.lit(None).cast("long")),
    )
    assert tuple(r) == ("1.2KiB", "51.2KiB", "1m1s", "20.5ms", "0ms", '[c] t k="a \\"b\\""', "GET h/x 404")


def test_levels_text_and_priorities(spark):
    r = one(spark, a=levels.from_word(F.lit(" Warning ")), b=levels.from_word(F.lit("odd")), c=levels.from_priority(F.lit("8")), d=levels.from_priority(F.lit("x")), e=levels.text(F.lit(24)), f=levels.from_http(F.lit(600)))
    assert tuple(r) == (13, None, 24, None, "FATAL", None)


def test_maps(spark):
    base = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    r = one(
        spark, over=maps.overwrite(base, {"a": F.lit("9"), "b": F.lit(None), "c": F.lit("3")}), fill=maps.fill(base, {"a": F.lit("9"), "c": F.lit("3")}), ren=maps.rename(base, [("a", "b"), ("b", "d")]), pre=maps.prefixed(base, "p.", ["a"]), merged=maps.merge(base, F.create_map(F.lit("b"), F.lit("7"))),
    )
    assert r.over == {"a": "9", "b": "2", "c": "3"} and r.fill == {"a": "1", "b": "2", "c": "3"} and r.pre == {"p.b": "2"} and r.merged == {"a": "1", "b": "7"}
    assert r.ren["d"] == "2"


def test_times_in_any_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = one(spark, a=times.utc_micros(F.lit("2026-01-01 00:00:00"), "yyyy-MM-dd HH:mm:ss"), b=times.rfc3339_micros(F.lit("2026-01-01T01:00:00+01:00")), c=times.epoch_micros(F.lit(1767225600.0)), d=times.epoch_micros(F.lit(5.0)), e=times.rfc3339_micros(F.lit("never")))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(r) == (1767225600000000, 1767225600000000, 1767225600000000, None, None)


def test_cleaning(spark):
    r = one(spark, a=cleaning.unescape(F.lit(r"a\x41\n\\z\q")), b=cleaning.is_blank(F.lit("\x1b[31m \\n")), c=cleaning.is_blank(F.lit("")), d=cleaning.one_line(F.lit("a\n  b\tc"), 3), e=cleaning.serial_console(F.lit(r"[\x1b[0mOK]\r\n")))
    assert tuple(r) == ("aA\n\\z\\q", True, False, "a b", "[OK]")
