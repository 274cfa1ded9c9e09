"""Mixed lines through the whole ordered dispatch, wrapped lines, and the further forms of single formats.

A query deals events over a list of cases; each row must come out as its own case
says: branch, body, level, time, scope, and the case's first attributes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators.logshape import BRANCHES, logshape, shape_counters
from lumenloom.operators.parsers import parse
from lumenloom.plans.common import EVENTS
from lumenloom.plans.common import lines as read_lines
from lumenloom.plans.lines import CASES, OPTIONS, Case

#: Attributes and resource values of a case that are compared.
N_AT, N_RES = 4, 2
Cases = list[tuple[str, Case]]


def _by_case(values: list[str], other: str = "NULL") -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE event_id % {len(values)} {whens} ELSE {other} END"


def _rows(cases: Cases, spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line an event, of the case that its id picks."""
    of = lambda pick: F.expr(_by_case([pick(c) for _, c in cases]))
    text_map = lambda m: f"cast({m} as map<string,string>)"
    return read_lines(spark, sf_dir).select(
        "event_id", of(lambda c: c.line).alias("body"), of(lambda c: text_map(c.attributes)).alias("attributes"), of(lambda c: text_map(c.resource)).alias("resource"),
        of(lambda c: c.severity).cast("int").alias("severity_number"), of(lambda c: c.record_us).cast("long").alias("ts_us"),
    )


def _nth(cases: Cases, pick: Callable, i: int) -> list[str | None]:
    return [list(pick(c))[i] if len(pick(c)) > i else None for _, c in cases]


def mixed(cases: Cases, parsers: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(cases, spark, sf_dir)
    out = parse(rows, *parsers, options=OPTIONS) if parsers else logshape(rows, options=OPTIONS)

    def value(column: str, keys: list[str | None]) -> F.Column:
        key = F.expr(_by_case([f"'{k}'" if k else "NULL" for k in keys]))
        return F.col(column)[key]

    at = [value("attributes", _nth(cases, lambda c: c.at, i)).alias(f"a{i}") for i in range(N_AT)]
    res = [value("resource", _nth(cases, lambda c: c.res, i)).alias(f"r{i}") for i in range(N_RES)]
    scoped = F.expr(_by_case(["true" if c.scope else "false" for _, c in cases]))
    return out.select("event_id", "branch", "body", "severity_number", "ts_us", F.when(scoped, F.col("scope_name")).alias("scope_name"), *at, *res)


def mixed_sql(cases: Cases) -> str:
    text = lambda values: _by_case([f"({v})::VARCHAR" for v in values])
    at = [text([c.at[k] if k else "NULL" for (_, c), k in zip(cases, _nth(cases, lambda c: c.at, i))]) + f" AS a{i}" for i in range(N_AT)]
    res = [text([c.res[k] if k else "NULL" for (_, c), k in zip(cases, _nth(cases, lambda c: c.res, i))]) + f" AS r{i}" for i in range(N_RES)]
    cols = [
        "event_id", _by_case([f"'{b}'" if b else "NULL" for b, _ in cases]) + " AS branch", text([c.body for _, c in cases]) + " AS body",
        f"CAST({_by_case([c.level for _, c in cases])} AS INTEGER) AS severity_number", f"CAST({_by_case([c.ts_us if c.ts_us != 'NULL' else c.record_us for _, c in cases])} AS BIGINT) AS ts_us",
        text([c.scope or "NULL" for _, c in cases]) + " AS scope_name",
    ]
    return f"SELECT {', '.join([*cols, *at, *res])} FROM {EVENTS}"


def _wrapped(name: str) -> Case:
    """The case's line behind a syslog head: the inner branch shapes it, the head's host and process stay, and its level where the line has none."""
    c = CASES[name]
    line = f"concat('Dec 31 10:05:00 host', user_id, ' app[', event_id, ']: ', {c.line})"
    at = {k: v for k, v in c.at.items() if k not in ("log.source", "process.pid")}
    return Case(
        "''", c.body, f"coalesce({c.level}, 9)", c.ts_us, {"process.pid": "event_id::VARCHAR", "log.source": "'syslog'", **at}, {"host.name": "'host' || user_id", "service.name": c.res.get("service.name", "'app'")}, c.scope,
        attributes=f"map('priority', '14', 'message', {line})",
    )


WRAPPED = ("cron", "smartd", "logfmt", "gcpjson", "calico", "clickhouse", "mongod")
UNCLAIMED = Case("concat('nothing known about ', event_type)", "'nothing known about ' || event_type")
ALL: Cases = [(b.name, CASES[b.name]) for b in BRANCHES] + [(n, _wrapped(n)) for n in WRAPPED] + [(None, UNCLAIMED)]

_IP, _D_IP = "concat('10.', event_id % 200, '.', user_id % 200, '.7')", "'10.' || event_id % 200 || '.' || user_id % 200 || '.7'"
CISCO: Cases = [
    ("cisco", Case(
        "concat(' Dec 15 22:56:14 switch-', user_id, ' TRAPMGR[dot1s_', event_type, ']: traps.c(', event_id, ') ', event_id + 1, ' %% Topology ', event_type)", "'Topology ' || event_type", "NULL", "NULL",
        {"thread.name": "'dot1s_' || event_type", "code.file.path": "'traps.c'", "code.line.number": "event_id", "x.cisco.sequence": "event_id + 1"}, {"host.name": "'switch-' || user_id", "service.name": "'TRAPMGR'"},
    )),
    ("cisco", Case("concat(' Dec 15 22:56:14 switch-', user_id, ' General[t]: Event %% got ', event_type)", "'got ' || event_type", "NULL", "NULL", {"thread.name": "'t'"}, {"host.name": "'switch-' || user_id", "service.name": "'General'"})),
    ("cisco", Case(
        "concat('AP-', user_id, ': *task_0: Dec 16 00:00:44.695: %APF-5-CLIENT_ASSOCIATE: apf.c:', event_id, ' Client Association: Client MAC: 02:00:5e:00:00:01, AP Name: Down-', user_id, ', Radio: 2.4GHz , WLAN Id: ', event_id, '.')",
        "'Client Association'", "9", "NULL", {"x.wifi.ap.name": "'AP-' || user_id", "x.wifi.client.ap": "'Down-' || user_id", "x.wifi.radio": "'2.4GHz'", "x.wifi.wlan.id": "event_id"}, {"service.name": "'APF'"},
    )),
    ("cisco", Case("concat('AP-', user_id, ': *t: Dec 16 00:00:44.695: %SYS-3-ODD: no file here, code ', event_id)", "'no file here, code ' || event_id", "17", "NULL", {"thread.name": "'t'", "x.wifi.ap.name": "'AP-' || user_id", "x.cisco.mnemonic": "'ODD'"}, {"service.name": "'SYS'"})),
    ("cisco", Case("concat('[*12/15/2025 22:33:20.4060] pmkr0 lookup of ', event_id)", "'pmkr0 lookup of ' || event_id", "9", severity="13")),
    ("cisco", Case("concat('[12/15/2025 22:33:20] reset of ', event_id)", "'reset of ' || event_id", "13", severity="13")),
    ("cisco", Case("concat('<189>', event_id, ': *Dec 16 00:36:36.024: %LINK-3-UPDOWN: Interface GigabitEthernet1/0/', user_id, ', changed state')", "event_id || ': *Dec 16 00:36:36.024: %LINK-3-UPDOWN: Interface GigabitEthernet1/0/' || user_id || ', changed state'", "13", "NULL", {"network.interface.name": "'GigabitEthernet1/0/' || user_id"}, {"service.name": "'LINK'"})),
    ("cisco", Case("concat('%LINEPROTO-5-UPDOWN: Line protocol on Interface Vlan', user_id)", "'%LINEPROTO-5-UPDOWN: Line protocol on Interface Vlan' || user_id", "13", "NULL", {"network.interface.name": "'Vlan' || user_id"}, {"service.name": "'LINEPROTO'"})),
]
CRON: Cases = [
    ("cronlog", Case("concat('(u', user_id, ') CMDEND (run ', event_id, ' >/dev/null 2>&1)')", "'run ' || event_id || ' finished'", "9", "NULL", {"user.name": "'u' || user_id", "x.cron.command": "'run ' || event_id", "x.cron.event": "'end'"})),
    ("cronlog", Case("concat('(u', user_id, ') CMD (/usr/bin/flock -n /run/a.lock job ', event_id, ' > /dev/null)')", "'job ' || event_id", "9", "NULL", {"user.name": "'u' || user_id", "x.cron.command": "'job ' || event_id", "x.cron.event": "'start'"})),
    ("cronlog", Case("concat('pam_unix(cron:session): session opened for user u', user_id, ' by (uid=0)')", "'session opened for u' || user_id", "9", "NULL", {"user.name": "'u' || user_id", "x.cron.event": "'session_opened'"})),
    ("cronlog", Case("concat('pam_unix(cron:session): session closed for user u', user_id)", "'session closed for u' || user_id", "9", "NULL", {"user.name": "'u' || user_id", "x.cron.event": "'session_closed'"})),
    ("cronlog", Case("concat('(/etc/cron.daily) starting ', event_type)", "event_type || ' starting'", "9", "NULL", {"x.cron.directory": "'/etc/cron.daily'", "x.cron.command": "event_type", "x.cron.event": "'start'"})),
    ("cronlog", Case("concat('(/etc/cron.hourly) finished ', event_type)", "event_type || ' finished'", "9", "NULL", {"x.cron.directory": "'/etc/cron.hourly'", "x.cron.event": "'end'"})),
    (None, Case("concat('(u', user_id, ') RELOAD (x)')", "'(u' || user_id || ') RELOAD (x)'")),
]


def _charon(said: str, body: str, level: str, at: dict[str, str]) -> tuple[str, Case]:
    return "charon", Case(f"concat('09[IKE] <conn|', user_id, '> ', {said})", body, level, "NULL", at)


CHARON: Cases = [
    _charon("concat('CHILD_SA c', event_id % 10, '-1{', event_id, '} established with SPIs c', event_id, '_i d', user_id, '_o and TS 10.0.0.0/8 === 10.1.0.0/16')".replace("event_id % 10", "(event_id % 10)"), "'CHILD_SA c' || event_id % 10 || '-1{' || event_id || '} established with SPIs c' || event_id || '_i d' || user_id || '_o and TS 10.0.0.0/8 === 10.1.0.0/16'", "9", {"x.ipsec.child_sa": "'c' || event_id % 10 || '-1'", "x.ipsec.child_sa.state": "'established'", "x.ipsec.spi.in": "'c' || event_id", "x.ipsec.spi.out": "'d' || user_id"}),
    _charon("concat('TS 10.0.', user_id, '.0/24 === 10.1.0.0/16')", "'TS 10.0.' || user_id || '.0/24 === 10.1.0.0/16'", "9", {"x.ipsec.traffic_selector": "'10.0.' || user_id || '.0/24 === 10.1.0.0/16'"}),
    _charon("concat('authentication of ''u', user_id, '@x.org'' with EAP failed')", "'authentication of ''u' || user_id || '@x.org'' with EAP failed'", "17", {"x.ipsec.auth.identity": "'u' || user_id || '@x.org'", "x.ipsec.auth.result": "'failed'"}),
    _charon("concat('authentication of ''u', user_id, ''' with RSA successful')", "'authentication of ''u' || user_id || ''' with RSA successful'", "9", {"x.ipsec.auth.result": "'successful'"}),
    _charon("concat('received DELETE for ESP CHILD_SA with SPI c', event_id)", "'received DELETE for ESP CHILD_SA with SPI c' || event_id", "9", {"x.ipsec.delete.spi": "'c' || event_id"}),
    _charon("'selected proposal: ESP:AES_GCM_16_128/NO_EXT_SEQ'", "'selected proposal: ESP:AES_GCM_16_128/NO_EXT_SEQ'", "9", {"x.ipsec.proposal": "'ESP:AES_GCM_16_128/NO_EXT_SEQ'"}),
    _charon("concat('retransmit ', event_id, ' of request')", "'retransmit ' || event_id || ' of request'", "13", {"x.ipsec.subsystem": "'IKE'"}),
    _charon(f"concat('sending packet: from 10.0.0.9[4500] to ', {_IP}, '[500] (', event_id, ' bytes)')", f"'sending packet: from 10.0.0.9[4500] to ' || {_D_IP} || '[500] (' || event_id || ' bytes)'", "9", {"network.io.direction": "'transmit'", "source.port": "'4500'", "destination.address": _D_IP, "x.ipsec.packet.bytes": "event_id"}),
]
KERNEL: Cases = [
    ("kernel", Case("concat('[ 12.', event_id, '] sd 0:0:', user_id, ':0: [sda] Sense Key : Medium Error [current]')", "'Sense Key : Medium Error [current]'", "17", "NULL", {"x.kernel.subsystem": "'scsi'", "x.kernel.uptime": "'12.' || event_id", "x.scsi.address": "'0:0:' || user_id || ':0'", "x.scsi.sense_key": "'Medium Error'"})),
    ("kernel", Case("concat('sd 0:0:0:0: [sd', event_type, '] Add. Sense: Unrecovered read error')", "'Add. Sense: Unrecovered read error'", "9", "NULL", {"x.scsi.sense": "'Unrecovered read error'", "x.kernel.device": "'sd' || event_type"})),
    ("kernel", Case(f"concat('IPVS: rr: TCP ', {_IP}, ':80 - no destination available')", f"'IPVS: rr: TCP ' || {_D_IP} || ':80 - no destination available'", "13", "NULL", {"x.kernel.subsystem": "'ipvs'", "x.ipvs.scheduler": "'rr'", "network.transport": "'tcp'", "destination.address": f"{_D_IP} || ':80'"})),
    ("kernel", Case("concat('net_ratelimit: ', event_id, ' callbacks suppressed')", "'net_ratelimit: ' || event_id || ' callbacks suppressed'", "13", "NULL", {"x.kernel.suppressed": "event_id", "x.kernel.subsystem": "'network'"})),
    ("kernel", Case("concat('eth', user_id, ': link is down')", "'link is down'", "13", "NULL", {"network.interface.name": "'eth' || user_id"})),
    ("kernel", Case("'clocksource: Switched to clocksource tsc'", "'clocksource: Switched to clocksource tsc'", "9", "NULL", {"x.kernel.subsystem": "'clocksource'"})),
    (None, Case("concat('usb ', event_id, ': new device')", "'usb ' || event_id || ': new device'")),
]


def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per branch and source of the mixed lines."""
    return shape_counters(logshape(_rows(ALL, spark, sf_dir), options=OPTIONS))


BRANCH_COUNTS = f"""
SELECT branch, source, count(*) AS records FROM (SELECT {_by_case([f"'{b}'" if b else 'NULL' for b, _ in ALL])} AS branch, {_by_case([c.at.get('log.source', c.attributes.split("'log.source', ")[1].split("'")[1].join("''") if "'log.source', " in c.attributes else "'none'") for _, c in ALL])} AS source FROM {EVENTS}) GROUP BY 1, 2
"""

FORMS = {"shape_all": (ALL, ()), "forms_cisco": (CISCO, ("cisco",)), "forms_cron": (CRON, ("cronlog",)), "forms_charon": (CHARON, ("charon",)), "forms_kernel": (KERNEL, ("kernel",))}
QUERIES: dict[str, Callable] = {n: partial(mixed, *how) for n, how in FORMS.items()} | {"branch_counts": branch_counts}
ORACLES = {n: mixed_sql(cases) for n, (cases, _) in FORMS.items()} | {"branch_counts": BRANCH_COUNTS}
