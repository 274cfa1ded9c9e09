"""Round trips of log formats: a line is built from table columns, shaped, and compared with the columns.

Each case: the branch or parser, the line in Spark SQL over ``events``, the
expected body, level and time in DuckDB SQL, and attributes as name -> SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.operators.logshape import BY_NAME, logshape
from lumenloom.operators.parsers import parse
from lumenloom.plans.common import EVENTS, lines as read_lines

OPTIONS = {"prefix": "x", "keep_original": False, "account_aliases": {"7": "seven"}}


@dataclass(frozen=True)
class Case:
    line: str = "''"
    body: str = "''"
    level: str = "NULL"
    ts_us: str = "NULL"
    at: dict[str, str] = field(default_factory=dict)
    res: dict[str, str] = field(default_factory=dict)
    scope: str | None = None
    #: Input attributes, resource and severity in Spark SQL.
    attributes: str = "map()"
    resource: str = "map()"
    severity: str = "NULL"
    record_us: str = "NULL"


_IP = "concat('10.', event_id % 200, '.', user_id % 200, '.7')"
_D_IP = "'10.' || event_id % 200 || '.' || user_id % 200 || '.7'"
_STATUS = "elt(cast(event_id % 4 as int) + 1, '200', '302', '404', '503')"
_D_STATUS = "CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 302 WHEN 2 THEN 404 ELSE 503 END"
_D_HTTP = "CASE event_id % 4 WHEN 0 THEN 9 WHEN 1 THEN 9 WHEN 2 THEN 13 ELSE 17 END"
_MS = "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"
_D_MS = "at_us // 1000 * 1000"
_D_S = "at_us // 1000000 * 1000000"


def _word(*words: str) -> str:
    return f"elt(cast(event_id % {len(words)} as int) + 1, {', '.join(repr(w) for w in words)})"


def _case(*values: object) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE event_id % {len(values)} {whens} END"


def _size(n: str) -> str:
    return f"CASE WHEN {n} >= 1048576 THEN rtrim(rtrim(printf('%.1f', {n} / 1048576.0), '0'), '.') || 'MiB' WHEN {n} >= 1024 THEN regexp_replace(printf('%.1f', {n} / 1024.0), '\\.0$', '') || 'KiB' ELSE {n} || 'B' END"


_BYTES, _D_BYTES = "(event_id * 37 + 1)", _size("(event_id * 37 + 1)")
_KLOG4 = _case(9, 13, 17, 21)

CASES: dict[str, Case] = {
    "flow": Case("''", "''", attributes="map('flow.src_as', string(user_id), 'flow.dst_as', string(event_id), 'flow.type', event_type)", at={"source.as.number": "user_id::VARCHAR", "destination.as.number": "event_id::VARCHAR", "flow.type": "event_type"}),
    "klog": Case(
        f"concat({_word('I', 'W', 'E', 'F')}, date_format(ts, 'MMdd HH:mm:ss.SSSSSS'), '      ', user_id, ' ', event_type, '.go:', event_id, '] \"', event_type, ' seen\" user=', user_id, ' note=\"a b\" podUID=\"u', user_id, '\"')",
        "event_type || ' seen user=' || user_id || ' note=\"a b\"'", _KLOG4, "at_us", {"process.pid": "user_id::VARCHAR", "code.file.path": "event_type || '.go'", "code.line.number": "event_id::VARCHAR"}, {"k8s.pod.uid": "'u' || user_id"}, record_us="at_us + 3600000000",
    ),
    "uvicorn": Case(
        f"concat('INFO:     ', {_IP}, ':', user_id, ' - \"GET /', event_type, '?id=', event_id, ' HTTP/1.1\" ', {_STATUS}, ' Some Text')",
        f"'GET /' || event_type || ' id=' || event_id || ' ' || {_D_STATUS}", _D_HTTP, "NULL", {"client.address": _D_IP, "client.port": "user_id::VARCHAR", "url.query": "'id=' || event_id", "http.response.status_code": f"({_D_STATUS})::VARCHAR", "x.uvicorn.status_text": "'Some Text'"},
    ),
    "collector": Case(
        "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), '\\tinfo\\tmod@v1.2.3/', event_type, '.go:', event_id, '\\tgot ', event_type, '\\t{\"otelcol.component.id\": \"r', user_id, '\", \"otelcol.component.kind\": \"receiver\", \"n\": ', event_id, '}')",
        "'got ' || event_type", "9", _D_MS, {"code.file.path": "'mod/' || event_type || '.go'", "code.line.number": "event_id::VARCHAR", "otel.component.name": "'r' || user_id", "x.collector.n": "event_id::VARCHAR"}, scope="'r' || user_id",
    ),
    "mongod": Case(
        f"concat('{{\"t\":{{\"$date\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\"), '+00:00\"}},\"s\":\"', {_word('I', 'W', 'E', 'F')}, '\",\"c\":\"NETWORK\",\"id\":', event_id, ',\"ctx\":\"conn', user_id, '\",\"msg\":\"got ', event_type, '\",\"attr\":{{\"remote\":\"', {_IP}, ':5', user_id % 10, '\",\"connectionCount\":', user_id, ',\"someKey\":\"v\"}}}}')".replace("user_id % 10", "cast(user_id % 10 as string)"),
        f"'got ' || event_type || ' remote=' || {_D_IP} || ':5' || user_id % 10 || ' connectionCount=' || user_id", _KLOG4, _D_MS, {"client.address": _D_IP, "client.port": "'5' || user_id % 10", "x.mongod.id": "event_id::VARCHAR", "x.mongod.some_key": "'v'"}, scope="'NETWORK'",
    ),
    "gcpjson": Case(
        "concat('{\"message\":\"got ', event_type, '\",\"severity\":\"WARNING\",\"timestamp\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), '\",\"logging.googleapis.com/sourceLocation\":{\"file\":\"a/b.go\",\"line\":\"', event_id, '\",\"function\":\"f\"},\"user\":', user_id, '}')",
        "'got ' || event_type", "13", _D_MS, {"code.line.number": "event_id::VARCHAR", "code.function.name": "'f'", "x.gcpjson.user": "user_id::VARCHAR"},
    ),
    "tracing": Case(
        "concat('{\"timestamp\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"), '\",\"level\":\"ERROR\",\"fields\":{\"message\":\"got ', event_type, '\",\"rows\":', event_id, '},\"target\":\"t::', event_type, '\"}')",
        "'got ' || event_type", "17", "at_us", {"x.tracing.rows": "event_id::VARCHAR"}, scope="'t::' || event_type",
    ),
    "pino": Case(
        f"concat('[TAG] {{\"level\":', {_word('30', '40', '50', '60')}, ',\"time\":', at_us div 1000, ',\"pid\":', user_id, ',\"msg\":\"got ', event_type, '\",\"n\":', event_id, '}}')",
        "'got ' || event_type", _KLOG4, _D_MS, {"process.pid": "user_id::VARCHAR", "x.pino.n": "event_id::VARCHAR"}, scope="'TAG'",
    ),
    "logrus": Case(
        "CASE event_id % 2 WHEN 0 THEN concat('{\"level\":\"warn\",\"ts\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), '\",\"caller\":\"c.go:', user_id, '\",\"msg\":\"got ', event_type, '\",\"error\":\"e', event_id, '\"}') ELSE concat('time=\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), '\" level=warning msg=\"got ', event_type, '\" caller=c.go:', user_id, ' error=e', event_id) END",
        "'got ' || event_type || ': e' || event_id", "13", _D_MS, {"code.file.path": "'c.go'", "code.line.number": "user_id::VARCHAR", "exception.message": "'e' || event_id"},
    ),
    "postgres": Case(
        f"concat({_MS}, ' UTC [', user_id, '] ', {_word('LOG', 'WARNING', 'ERROR', 'FATAL')}, ':  got ', event_type, '\\n', {_MS}, ' UTC [', user_id, '] DETAIL:  key ', event_id)",
        "'got ' || event_type", _KLOG4, _D_MS, {"process.pid": "user_id::VARCHAR", "x.postgres.detail": "'key ' || event_id"},
    ),
    "redis": Case(
        f"concat(user_id, ':', {_word('M', 'S', 'C', 'X')}, ' ', date_format(ts, 'dd MMM yyyy HH:mm:ss.SSS'), ' ', {_word('.', '-', '*', '#')}, ' got ', event_type)",
        "'got ' || event_type", _case(5, 9, 9, 13), _D_MS, {"process.pid": "user_id::VARCHAR", "x.redis.role": _case("'master'", "'slave'", "'child'", "'sentinel'")}, {"service.name": "'redis'"},
    ),
    "nginx": Case(
        f"concat({_IP}, ' - u', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, '?id=', event_id, ' HTTP/1.1\" ', {_STATUS}, ' ', {_BYTES}, ' \"-\" \"curl/8.', user_id, '\" \"198.51.100.', event_id % 250, ', 10.0.0.1\"')",
        f"'GET /' || event_type || ' id=' || event_id || ' ' || {_D_STATUS} || ' ' || {_D_BYTES}", _D_HTTP, _D_S,
        {"client.address": "'198.51.100.' || event_id % 250", "network.peer.address": _D_IP, "user.name": "'u' || user_id", "http.response.body.size": "(event_id * 37 + 1)::VARCHAR", "user_agent.name": "'curl'", "user_agent.version": "'8.' || user_id", "x.nginx.device_type": "'bot'", "network.protocol.version": "'1.1'"}, {"service.name": "'nginx'"},
    ),
    "sentry": Case(
        f"concat(date_format(ts, 'HH:mm:ss'), ' [INFO] a.b.', event_type, ': api.access (method=''GET'' path=''/', event_type, ''' response=''', {_STATUS}, ''' caller_ip=''', {_IP}, ''' request_duration_seconds=''0.012'')')",
        f"'GET /' || event_type || ' ' || {_D_STATUS} || ' 12ms'", _D_HTTP, _D_S, {"client.address": _D_IP, "x.sentry.message_type": "'api.access'", "x.http.request.duration": "'0.012'"}, {"service.name": "'sentry'"}, scope="'a.b.' || event_type", record_us="at_us",
    ),
    "cisco": Case(
        f"concat(event_id, ': *Dec 16 00:36:36.024: %SW_MATM-', {_word('3', '4', '6', '7')}, '-', upper(event_type), ': Host on port Gi4/0/', user_id)",
        "event_id || ': *Dec 16 00:36:36.024: %SW_MATM-' || " + _case("'3'", "'4'", "'6'", "'7'") + " || '-' || upper(event_type) || ': Host on port Gi4/0/' || user_id", _case(17, 13, 9, 5), "NULL",
        {"network.interface.name": "'Gi4/0/' || user_id", "x.cisco.facility": "'SW_MATM'", "x.cisco.mnemonic": "upper(event_type)"}, {"service.name": "'SW_MATM'"},
    ),
    "syslog": Case(
        "concat('Dec 31 10:05:00 host', user_id, ' app-', event_type, '[', event_id, ']: got ', event_type)", "'got ' || event_type", "CASE event_id % 8 WHEN 0 THEN 24 WHEN 1 THEN 21 WHEN 2 THEN 17 WHEN 3 THEN 17 WHEN 4 THEN 13 WHEN 5 THEN 9 WHEN 6 THEN 9 ELSE 5 END", "NULL",
        {"process.pid": "event_id::VARCHAR", "log.source": "'syslog'", "x.syslog.parse_error": "'true'"}, {"host.name": "'host' || user_id", "service.name": "'app-' || event_type"}, attributes="map('priority', string(event_id))",
    ),
    "influx": Case(
        f"concat('[httpd] ', {_IP}, ' - u', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"POST /query?db=', event_type, ' HTTP/1.1\" ', {_STATUS}, ' ', {_BYTES}, ' \"-\" \"c\" id', event_id, ' 20511')",
        f"'POST /query db=' || event_type || ' ' || {_D_STATUS} || ' ' || {_D_BYTES} || ' 20.5ms'", _D_HTTP, _D_S, {"client.address": _D_IP, "user.name": "'u' || user_id", "x.influx.request_id": "'id' || event_id"},
    ),
    "oauth2proxy": Case(
        f"concat({_IP}, ' - id', event_id, ' - u', user_id, ' [', date_format(ts, 'yyyy/MM/dd HH:mm:ss'), '] 203.0.113.46:4180 GET - \"/', event_type, '\" HTTP/1.1 \"M\" ', {_STATUS}, ' ', {_BYTES}, ' 0.123')",
        f"'GET /' || event_type || ' ' || {_D_STATUS} || ' ' || {_D_BYTES} || ' 123ms'", _D_HTTP, _D_S, {"client.address": _D_IP, "user.name": "'u' || user_id", "x.oauth2proxy.request_id": "'id' || event_id"},
    ),
    "coredns": Case(
        f"concat('[INFO] ', {_IP}, ':', user_id, ' - ', event_id, ' \"A IN ', event_type, '.org. udp 24 false 512\" ', {_word('NOERROR', 'NXDOMAIN', 'SERVFAIL', 'REFUSED')}, ' qr 24 0.00007s')",
        _case("'NOERROR'", "'NXDOMAIN'", "'SERVFAIL'", "'REFUSED'") + " || ' A ' || event_type || '.org. 70us'", _case(9, 9, 13, 13), "NULL", {"client.address": _D_IP, "client.port": "user_id::VARCHAR", "dns.question.name": "event_type || '.org.'"},
    ),
    "gcplb": Case(
        "''", f"'GET h' || user_id || '.org/' || event_type || ' ' || {_D_STATUS} || ' 12ms'", _D_HTTP, "NULL", {}, {"host.name": "CASE WHEN user_id % 10 = 7 THEN 'seven' ELSE (user_id % 10)::VARCHAR END", "service.name": "'svc-' || event_type"},
        attributes=f"map('log.source', 'gcp.lb', 'http.request.method', 'get', 'http.response.status_code', {_STATUS}, 'url.domain', concat('h', user_id, '.org'), 'url.path', concat('/', event_type), 'http.request.server.duration', '0.012')",
        resource="map('gcp.label.project_id', string(user_id % 10), 'gcp.label.backend_service_name', concat('k8s1-0a1b2c3d-svc-', event_type, '-4e5f6a7b'))",
    ),
    "awselb": Case(
        "''", f"'GET h' || user_id || '.org/' || event_type || ' ' || {_D_STATUS}", _D_HTTP, "NULL", {}, {"host.name": "'lb' || user_id", "service.name": "'tg-' || event_type"},
        attributes=f"map('log.source', 'aws.elb', 'http.request.method', 'GET', 'aws.elb.status.code', {_STATUS}, 'url.full', concat('https://h', user_id, '.org:443/', event_type, '?x=1'), 'aws.elb.target_processing_time', '-1', 'aws.elb.target_group_arn', concat('arn:aws:x:targetgroup/tg-', event_type, '/1'))",
        resource="map('cloud.resource_id', concat('app/lb', user_id, '/50dc'))",
    ),
    "s3access": Case(
        "''", f"'REST.GET.OBJECT b' || user_id || '/k/' || event_type || ' ' || {_D_STATUS} || ' ' || {_D_BYTES}", _D_HTTP, "NULL", {"client.address": _D_IP}, {"host.name": "'b' || user_id", "service.name": "'w' || event_id"},
        attributes=f"map('log.source', 'aws.s3access', 'rpc.method', 'REST.GET.OBJECT', 'aws.s3.key', concat('k/', event_type), 'http.response.status_code', {_STATUS}, 'http.response.body.size', string({_BYTES}), 'source.address', {_IP}, 'user.id', concat('arn:aws:iam::1:user/w', event_id))",
        resource="map('aws.s3.bucket', concat('b', user_id))",
    ),
    "gcpaudit": Case(
        "CASE event_id % 2 WHEN 0 THEN '' ELSE concat('call ', event_type) END", "CASE event_id % 2 WHEN 0 THEN 'm.' || event_type || ' r/' || user_id ELSE 'call ' || event_type END || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' CANCELLED' ELSE ' UNKNOWN' END", "CASE WHEN event_id % 3 <> 0 THEN 17 END", "NULL",
        {}, {"service.name": "'u' || user_id"}, attributes="map('log.source', 'gcp.audit', 'gcp.audit.method.name', concat('m.', event_type), 'gcp.audit.resource.name', concat('r/', user_id), 'rpc.status_code', string(event_id % 3), 'user.email', concat('u', user_id, '@x.org'))",
    ),
    "eksaudit": Case(
        f"concat('{{\"kind\":\"Event\",\"level\":\"Metadata\",\"verb\":\"update\",\"auditID\":\"', event_id, '\",\"user\":{{\"username\":\"system:serviceaccount:ns:sa', user_id, '\"}},\"objectRef\":{{\"resource\":\"leases\",\"namespace\":\"ns\",\"name\":\"', event_type, '\"}},\"responseStatus\":{{\"code\":', {_STATUS}, '}}}}')",
        f"'UPDATE leases ns/' || event_type || ' ' || {_D_STATUS}", _D_HTTP, "NULL", {"http.request.method": "'UPDATE'", "x.audit.level": "'Metadata'"}, {"service.name": "'sa' || user_id", "host.name": "'c' || user_id"}, attributes="map('log.source', 'aws.eks', 'cloudwatch.log.group.name', concat('/aws/eks/c', user_id, '/cluster'))",
    ),
    "cloudtrail": Case(
        "''", "'ssm:Get' || event_type || ' n' || event_id", "CASE WHEN event_id % 2 = 1 THEN 13 END", "NULL", {}, {"service.name": "'s' || user_id", "host.name": "CASE WHEN user_id % 10 = 7 THEN 'seven' ELSE (user_id % 10)::VARCHAR END", "cloud.account.name": "CASE WHEN user_id % 10 = 7 THEN 'seven' END"},
        attributes="map('log.source', 'aws.cloudtrail', 'rpc.method', concat('ssm.amazonaws.com/Get', event_type), 'aws.principal.arn', concat('arn:aws:sts::1:assumed-role/R/s', user_id), 'aws.request.parameters', concat('{\"name\":\"/a/n', event_id, '\"}'), 'aws.error.code', if(event_id % 2 = 1, 'Denied', ''))".replace("/a/n", "n"),
        resource="map('cloud.account.id', string(user_id % 10))",
    ),
    "rabbitmq": Case(f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '+00:00 [', {_word('debug', 'info', 'warning', 'error')}, '] <0.', event_id, '.0> got ', event_type)", "'got ' || event_type", _case(5, 9, 13, 17), "at_us", {"x.rabbitmq.pid": "'<0.' || event_id || '.0>'"}),
    "mosquitto": Case("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), ': Client c', event_id, ' disconnected.')", "'Client c' || event_id || ' disconnected.'", "NULL", _D_S),
    "stallcheck": Case("concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"), ' stdout F published StallMinutes=', user_id)", "'published StallMinutes=' || user_id", "9", "at_us", {"x.stallcheck.stall_minutes": "user_id::VARCHAR"}),
    "kaudit": Case(
        "concat('audit: type=1400 audit(', at_us div 1000000, '.', lpad(cast((at_us div 1000) % 1000 as string), 3, '0'), ':', event_id, '): apparmor=\"DENIED\" operation=\"open\" profile=\"p', user_id, '\" requested=\"send\" addr=10.0.0.1 port=443')",
        "'[apparmor] DENIED open send, profile p' || user_id || ', to 10.0.0.1:443'", "9", _D_MS, {"x.audit.type": "'1400'", "x.audit.serial": "event_id::VARCHAR", "log.source": "'kernel'"}, {"service.name": "'audit'"},
    ),
    "smartd": Case(f"concat('Device: /dev/d', user_id, ', ', {_word('FAILED SMART self-check', '1 Offline uncorrectable sectors', 'all well')})", "'Device: /dev/d' || user_id || ', ' || " + _case("'FAILED SMART self-check'", "'1 Offline uncorrectable sectors'", "'all well'"), _case(17, 13, "NULL"), "NULL", {"x.smartd.device": "'/dev/d' || user_id"}),
    "gocd": Case("concat('jvm 1    | ', date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' WARN  [q-', user_id, '] Mat:', event_id, ' - got ', event_type, '\\njvm 1    | more')", "'got ' || event_type || chr(10) || 'more'", "13", "NULL", {"thread.name": "'q-' || user_id", "code.function.name": "'Mat'", "code.line.number": "event_id::VARCHAR"}),
    "cron": Case("concat('cron: (u', user_id, ') CMD (', event_type, ')')", "'(u' || user_id || ') CMD (' || event_type || ')'", res={"service.name": "'cron'"}),
    "openvpn": Case(
        "''", f"'u' || user_id || ' connected since ' || event_type || ' from ' || {_D_IP} || ', in ' || {_D_BYTES} || ', out ' || {_size('(event_id * 1000)')}", "NULL", "NULL", {"user.name": "'u' || user_id", "client.address": _D_IP, "client.port": "'77'", "x.openvpn.bytes_sent": "(event_id * 1000)::VARCHAR"},
        attributes=f"map('common_name', concat('u', user_id), 'real_address', concat({_IP}, ':77'), 'bytes_received', string({_BYTES}), 'bytes_sent', string(event_id * 1000), 'connected_since', event_type)",
    ),
    "pbs": Case(
        f"concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00: TASK ', {_word('OK', 'WARNINGS: 2', 'ERROR: x')})", "'[data-store] TASK ' || " + _case("'OK'", "'WARNINGS: 2'", "'ERROR: x'"), _case(9, 13, 17), _D_S, {"x.pbs.task": "event_type", "x.pbs.datastore": "'data-store'", "user.name": "'u' || user_id"}, {"service.name": "event_type"},
        attributes="map('log.file.name', concat('UPID:n:1:2:3:4:', event_type, ':data\\\\x2dstore:u', user_id, ':'))",
    ),
    "pve": Case("concat('line one\\nTASK ', if(event_id % 2 = 0, 'OK', 'ERROR: pipe'))", "'line one' || chr(10) || 'TASK ' || CASE WHEN event_id % 2 = 0 THEN 'OK' ELSE 'ERROR: pipe' END", "CASE WHEN event_id % 2 = 0 THEN 9 ELSE 17 END", "NULL", {"x.pve.task": "event_type", "user.name": "'u' || user_id"}, attributes="map('log.file.path', concat('/var/log/UPID:n:1:2:3:4:', event_type, '::u', user_id, ':'))"),
    "serialconsole": Case(f"concat('[\\\\x1b[0;1;31m', {_word('FAILED', '  OK  ')}, '\\\\x1b[0m] Started ', event_type, '.\\\\r\\\\n')", "'[' || " + _case("'FAILED'", "'  OK  '") + " || '] Started ' || event_type || '.'", _case(17, 9), "NULL", {}, {"host.name": "'h' || user_id"}, attributes="map('cloud.resource_id', 'serialconsole.googleapis.com/p', 'gcp.label.compute.googleapis.com/resource_name', concat('h', user_id))"),
    "logfmt": Case("concat('logger=l.', event_type, ' t=', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"), ' level=info msg=\"got ', event_type, '\" n=', event_id, ' q=\"a b\" source=f.go:', user_id)", "'got ' || event_type || ' n=' || event_id || ' q=\"a b\"'", "9", "at_us", {"code.file.path": "'f.go'", "code.line.number": "user_id::VARCHAR"}, scope="'l.' || event_type"),
    "clickhouse": Case(f"concat(date_format(ts, 'yyyy.MM.dd HH:mm:ss.SSSSSS'), ' [ ', user_id, ' ] {{q', event_id, '}} <', {_word('Trace', 'Debug', 'Information', 'Error')}, '> Exec: got: ', event_type)", "'got: ' || event_type", _case(1, 5, 9, 17), "at_us", {"thread.id": "user_id::VARCHAR", "x.clickhouse.query_id": "'q' || event_id"}, scope="'Exec'"),
    "calico": Case(f"concat({_MS}, ' [', {_word('DEBUG', 'INFO', 'WARNING', 'ERROR')}, '][', user_id, '] felix/', event_type, '.go ', event_id, ': got it')", "'got it'", _case(5, 9, 13, 17), _D_MS, {"code.file.path": "'felix/' || event_type || '.go'", "code.line.number": "event_id::VARCHAR", "thread.id": "user_id::VARCHAR"}),
    "ssmagent": Case("concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSS'), ' WARN Comp', user_id, ' got ', event_type)", "'got ' || event_type", "13", "at_us // 100 * 100", scope="'Comp' || user_id"),
    "litellm": Case("concat(date_format(ts, 'HH:mm:ss'), ' - Lite Proxy:INFO: ', event_type, '.py:', event_id, ' - got it')", "'got it'", "9", "NULL", {"code.file.path": "event_type || '.py'", "code.line.number": "event_id::VARCHAR"}, scope="'Lite Proxy'"),
    "stderrhint": Case("concat('listening ', event_type)", "'listening ' || event_type", "NULL", attributes="map('log.source', 'journal')", resource="map('container.id', string(user_id))", severity="17"),
    "lldpd": Case("concat('{\"observed_at\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\",\"interface\":\"eno', user_id, '\",\"chassis_id\":\"00:11\",\"chassis_name\":\"sw\",\"port_id\":\"Gi', event_id, '\",\"mgmt_ip\":[\"10.0.0.1\"]}')", "'eno' || user_id || ' sees sw port Gi' || event_id || ' 10.0.0.1'", "NULL", _D_S, {"network.interface.name": "'eno' || user_id", "client.mac.address": "'00:11'", "client.address": "'10.0.0.1'", "x.lldp.port_id": "'Gi' || event_id"}),
    "k8s": Case("concat('Pod ns-', event_type, '/web-', event_id, ': Running (1/2 ready) on node-', user_id)", "'Running (1/2 ready)'", at={"k8s.pod.status.phase": "'Running'"}, res={"k8s.namespace.name": "'ns-' || event_type", "k8s.pod.name": "'web-' || event_id", "k8s.node.name": "'node-' || user_id", "host.name": "'node-' || user_id", "service.name": "'web-' || event_id"}),
    # parsers of single formats
    "charon": Case(f"concat('09[NET] <conn|', user_id, '> received packet: from ', {_IP}, '[500] to 10.0.0.9[4500] (', event_id, ' bytes)')", f"'received packet: from ' || {_D_IP} || '[500] to 10.0.0.9[4500] (' || event_id || ' bytes)'", "9", "NULL", {"source.address": _D_IP, "destination.port": "'4500'", "x.ipsec.packet.bytes": "event_id::VARCHAR", "x.ipsec.connection_id": "user_id::VARCHAR"}),
    "containerd": Case("concat('time=\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), '\" level=error msg=\"RunPodSandbox for &PodSandboxMetadata{Name:p', event_id, ',Uid:u', user_id, ',Namespace:ns,Attempt:0,}\" error=boom')", "'RunPodSandbox for &PodSandboxMetadata{Name:p' || event_id || ',Uid:u' || user_id || ',Namespace:ns,Attempt:0,}: boom'", "17", _D_MS, {"k8s.pod.name": "'p' || event_id", "k8s.pod.uid": "'u' || user_id", "exception.message": "'boom'"}),
    "cronlog": Case("concat('(u', user_id, ') CMD (run-', event_type, ' > /dev/null 2>&1)')", "'run-' || event_type", "9", "NULL", {"user.name": "'u' || user_id", "x.cron.command": "'run-' || event_type", "x.cron.event": "'start'"}),
    "filterlog": Case(
        f"concat(user_id, ',,,t', event_id, ',em0,match,', {_word('pass', 'block')}, ',in,4,0x0,,64,1,0,DF,6,tcp,60,', {_IP}, ',192.0.2.5,', event_id + 1024, ',443,0,SA,1,2,3,,')".replace("event_id + 1024", "(event_id + 1024)"),
        _case("'pass'", "'block'") + f" || ' inbound tcp ' || {_D_IP} || ':' || (event_id + 1024) || ' -> 192.0.2.5:443 on em0'", _case(9, 13), "NULL", {"source.address": _D_IP, "destination.port": "'443'", "x.filter.tcp_flags": "'SYN,ACK'", "x.filter.rule": "user_id::VARCHAR"},
    ),
    "kafka": Case(f"concat('[', date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), '] ', {_word('INFO', 'WARN', 'ERROR')}, ' got ', event_type, ' (kafka.log.L', user_id, ')')", "'got ' || event_type", _case(9, 13, 17), _D_MS, scope="'kafka.log.L' || user_id"),
    "pgbouncer": Case(f"concat({_MS}, ' UTC [', user_id, '] LOG C-0x5f', event_id % 10, ': db', user_id, '/u', event_id, '@', {_IP}, ':54 login attempt')".replace("event_id % 10", "(event_id % 10)"), "'login attempt'", "9", _D_MS, {"process.pid": "user_id::VARCHAR", "db.namespace": "'db' || user_id", "user.name": "'u' || event_id", "client.address": _D_IP, "x.pgbouncer.side": "'client'"}),
    "snuba": Case("concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' got ', event_type)", "'got ' || event_type", "9", _D_MS),
    "tekton": Case("concat('Event(v1.ObjectReference{Kind:\"TaskRun\", Namespace:\"ns', user_id, '\", Name:\"t', event_id, '\", UID:\"x\"}): type: ''Warning'' reason: ''Failed'' got ', event_type)", "'TaskRun t' || event_id || ': Failed - got ' || event_type", "13", "NULL", {"x.tekton.kind": "'TaskRun'", "k8s.namespace.name": "'ns' || user_id", "x.tekton.reason": "'Failed'"}),
    "kernel": Case("concat('critical medium error, dev sd', event_type, ', sector ', event_id, ' op 0x0')", "'critical medium error, dev sd' || event_type || ', sector ' || event_id || ' op 0x0'", "17", "NULL", {"x.kernel.device": "'sd' || event_type", "x.block.sector": "event_id::VARCHAR", "x.kernel.subsystem": "'block'"}),
    "tightvnc": Case(f"concat('[ ', user_id, '/ ', event_id, '] ', date_format(ts, 'yyyy-MM-dd HH:mm:ss:SSS'), ' : + Incoming rfb connection from ', {_IP}, ' to port 5900')", f"'Incoming rfb connection from ' || {_D_IP} || ' to port 5900'", "9", _D_MS, {"process.pid": "user_id::VARCHAR", "thread.id": "event_id::VARCHAR", "client.address": _D_IP, "server.port": "'5900'", "x.tightvnc.event": "'connect'"}),
    "k8sevent": Case("concat('{\"object\":{\"type\":\"Warning\",\"reason\":\"BackOff\",\"note\":\"got ', event_type, '\",\"regarding\":{\"kind\":\"Pod\",\"name\":\"p', event_id, '\",\"namespace\":\"n', user_id, '\"}}}')", "'Pod n' || user_id || '/p' || event_id || ': BackOff - got ' || event_type", "13", "NULL", {"k8s.event.reason": "'BackOff'", "k8s.event.regarding.name": "'p' || event_id"}),
}


def _column(name: str) -> str:
    return name.replace(".", "_")


def shaped_case(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CASES[name]
    lines = read_lines(spark, sf_dir).select(
        "event_id", F.expr(c.line).alias("body"), F.expr(c.attributes).cast("map<string,string>").alias("attributes"), F.expr(c.resource).cast("map<string,string>").alias("resource"),
        F.expr(c.severity).cast("int").alias("severity_number"), F.expr(c.record_us).cast("long").alias("ts_us"),
    )
    out = logshape(lines, [name], OPTIONS) if name in BY_NAME else parse(lines, name, options=OPTIONS)
    return out.select(
        "event_id", "branch", "body", "severity_number", "ts_us", *([F.col("scope_name")] if c.scope else []),
        *[F.col("attributes")[k].alias(f"a_{_column(k)}") for k in c.at], *[F.col("resource")[k].alias(f"r_{_column(k)}") for k in c.res],
    )


def oracle(name: str) -> str:
    c = CASES[name]
    cols = ["event_id", f"'{name}' AS branch", f"{c.body} AS body", f"CAST({c.level} AS INTEGER) AS severity_number"]
    ts = c.ts_us if c.ts_us != "NULL" else c.record_us
    cols.append(f"CAST({ts} AS BIGINT) AS ts_us")
    if c.scope:
        cols.append(f"{c.scope} AS scope_name")
    cols += [f"{v} AS a_{_column(k)}" for k, v in c.at.items()] + [f"{v} AS r_{_column(k)}" for k, v in c.res.items()]
    return f"SELECT {', '.join(cols)} FROM {EVENTS}"


QUERIES: dict[str, Callable] = {f"shape_{n}" if n in BY_NAME else f"parse_{n}": partial(shaped_case, n) for n in CASES}
ORACLES = {f"shape_{n}" if n in BY_NAME else f"parse_{n}": oracle(n) for n in CASES}
