"""Records through the whole branch table: bodies, levels, attributes, failures, wrapped lines."""

import pytest
from pyspark.sql import functions as F

from lumenloom.operators.logshape import BRANCHES, claims, logshape
from lumenloom.operators.parsers import parse, snooze_branch, windows_events

SCHEMA = "id int, body string, attributes map<string,string>, resource map<string,string>, severity_number int, ts_us long"
#: line -> (branch, body, level)
LINES = {
    'W1119 23:05:40.001000       1 reflector.go:561] "Watch failed" err="context deadline exceeded"': ("klog", 'Watch failed err="context deadline exceeded"', "WARN"),
    'WARNING:  192.0.2.11:8080 - "POST /api/submit HTTP/1.1" 400 Bad Request': ("uvicorn", "POST /api/submit 400", "WARN"),
    "1:S 19 Nov 2026 23:22:38.000 # replica lost": ("redis", "replica lost", "WARN"),
    "Dec 31 10:05:00 alpha sshd[42]: Accepted publickey for deploy": ("syslog", "Accepted publickey for deploy", None),
    "Device: /dev/ada3, FAILED SMART self-check. BACKUP DATA NOW!": ("smartd", "Device: /dev/ada3, FAILED SMART self-check. BACKUP DATA NOW!", "ERROR"),
    "[*11/20/2026 06:11:26.3538] hostapd:FT: Skip PMKR0 lookup": ("cisco", "hostapd:FT: Skip PMKR0 lookup", None),
    "Nov 19 23:05:40 node-1 redis[77]: 1:S 19 Nov 2026 23:22:38.000 # replica lost": ("redis", "replica lost", "WARN"),
    "nothing to see here": (None, "nothing to see here", None),
    '{"t":1,"severity":"x"}': (None, '{"t":1,"severity":"x"}', None),
    "": (None, "", None),
}


def rows(spark, items):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(items)], SCHEMA)


def test_whole_table(spark):
    items = [(line, None, None, None, None) for line in LINES] + [(None, None, None, None, None), ("x" * 200_000, {}, {}, None, None)]
    got = {r.id: r for r in logshape(rows(spark, items), options={"keep_original": False}).collect()}
    for i, (line, want) in enumerate(LINES.items()):
        assert (got[i].branch, got[i].body, got[i].severity_text) == want, line
    assert got[len(LINES)].branch is None and got[len(LINES)].body is None
    assert len(got[len(LINES) + 1].body) == 200_000
    wrapped = got[6]
    assert wrapped.attributes["process.pid"] == "1" and wrapped.resource == {"host.name": "node-1", "service.name": "redis"}


def test_gates_never_refuse_what_a_branch_claims(spark):
    """The claim with its gate is the claim alone, on the lines of every format."""
    from lumenloom.operators.logshape.core import record

    df = rows(spark, [(line, None, None, None, None) for line in LINES])
    rec = record(df)
    bad = []
    for b in BRANCHES:
        alone = F.lit(True)
        if b.cuts:
            alone = alone & b.cuts(b.text(rec)).ok
        if b.claim:
            alone = alone & b.claim(rec)
        if b.cuts:
            bad.append((F.coalesce(alone, F.lit(False)) & ~b.claims(rec)).alias(b.name))
    for r in df.select(*bad).collect():
        assert not any(r), r


def test_hints_aliases_and_unknown_branches(spark):
    df = rows(spark, [("1:S 19 Nov 2026 23:22:38.000 # lost", {}, {"service.name": "cache"}, None, None)])
    assert logshape(df, ["redis"], {"hints": {"redis": {"service": "other"}}}).first().branch is None
    out = logshape(df, ["redis"], {"hints": {"redis": {"service": "cache"}}, "service_name_overrides": {"cache": "store"}}).first()
    assert out.branch == "redis" and out.resource["service.name"] == "store" and out.attributes["log.record.original"].startswith("1:S")
    with pytest.raises(ValueError):
        logshape(df, ["no-such"])


def test_claims_and_extra_columns(spark):
    df = rows(spark, [("cron: (root) CMD (x)", {}, {}, None, None)]).withColumn("branch_note", F.lit("kept"))
    assert claims(df).first().branch == "cron"
    assert logshape(df).first().branch_note == "kept"


def test_empty_table(spark):
    assert logshape(rows(spark, []), ["klog", "nginx"]).count() == 0


def test_snooze_and_windows(spark):
    df = rows(spark, [("2026-01-01 10:00 ERROR boom\nmore", {}, {"k8s.namespace.name": "a", "k8s.container.name": "b"}, None, None), ("2026-01-01 10:00 ERROR boom", {}, {}, None, None)])
    got = sorted(parse(df, more=[snooze_branch([("a", "b")])]).collect(), key=lambda r: r.id)
    assert (got[0].body, got[0].severity_text) == ("boom\nmore", "ERROR") and got[1].branch is None
    ev = spark.createDataFrame([("Security", "Prov", 4625, 0, ["Audit Failure"], "pc", None, {"User": "bob"}), ("System", "Prov", 7, 2, None, "pc", "One line\r\nmore", None)], "channel string, provider string, event_id long, level int, keywords array<string>, computer string, message string, event_data map<string,string>")
    a, b = windows_events(ev, {("Prov", 4625): "{User} failed from {Ip}"}).collect()
    assert (a.body, a.severity_text) == ("bob failed from ", "WARN") and (b.body.strip(), b.severity_text) == ("One line", "ERROR")
