"""Branches that claim JSON lines, and console lines with a JSON tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions import agents, bodies, levels, maps, network, pairs, times
from lumenloom.functions.cuts import Cut, before, behind, cut, digits, every, form, marked, named, solid
from lumenloom.functions.maps import first_of
from lumenloom.functions.patterns import group, matches
from lumenloom.operators.logshape.core import Branch, Rec, Shape, as_object, begins, needs, object_text
from lumenloom.operators.logshape.lines import node_of_static_pod, source_place


def is_object(rec: Rec) -> Column:
    return as_object(rec.text).isNotNull()


def whole(rec: Rec) -> Column:
    return as_object(rec.text)


def inner(value: Column) -> Column:
    return F.from_json(value, "map<string,string>")


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


# -- mongod


def shape_mongod(rec: Rec) -> Shape:
    attr = rec.json2
    remote, principal, count = attr["remote"], attr["principalName"], attr["connectionCount"]
    split = network.port(remote).isNotNull()
    rest = maps.without(attr, ["remote", "principalName", "connectionCount"])
    more = F.transform_keys(F.map_filter(rest, lambda _, v: v.isNotNull()), lambda k, _: F.concat(F.lit(rec.ext("mongod.")), snake(k)))
    return Shape(
        body=bodies.compose(None, rec.j("msg"), {"principal": principal, "remote": remote, "connectionCount": count}),
        level=levels.from_source("mongod", rec.j("s")),
        ts_us=times.rfc3339_micros(F.get_json_object(rec.j("t"), "$.$date")),
        put={
            rec.ext("mongod.id"): rec.j("id"),
            rec.ext("mongod.ctx"): rec.j("ctx"),
            "user.name": F.nullif(principal, F.lit("")),
            "client.address": F.when(split, network.host(remote)),
            "client.port": network.port(remote).cast("string"),
            rec.ext("mongod.remote"): F.when(~split, remote),
            rec.ext("mongod.connection_count"): count,
        },
        more=maps.merge(maps.prefixed(rec.json, rec.ext("mongod."), ("t", "s", "c", "id", "ctx", "msg", "attr")), F.coalesce(more, maps.empty())),
        scope=rec.j("c"),
    )


MONGOD_BRANCH = Branch(
    "mongod", shape_mongod, lambda r: object_text(r.text) & needs(r.text, '"$date"', '"msg"'),
    slots={"json": whole, "json2": lambda r: inner(r.j("attr"))},
    claim=lambda r: F.get_json_object(r.text, "$.t").startswith('{"$date"') & (F.get_json_object(r.text, "$.s") != "") & F.get_json_object(r.text, "$.msg").isNotNull(),
)

# -- gcpjson

_GCP_OPERATION, _GCP_PLACE = "logging.googleapis.com/operation", "logging.googleapis.com/sourceLocation"


def shape_gcpjson(rec: Rec) -> Shape:
    place, operation = rec.j(_GCP_PLACE), rec.j(_GCP_OPERATION)
    where = rec.json2
    is_text = operation.isNotNull() & ~operation.startswith("{")
    return Shape(
        body=rec.j("message"),
        level=levels.from_word(rec.j("severity")),
        ts_us=times.rfc3339_micros(rec.j("timestamp")),
        put={
            "code.file.path": F.when(place.startswith("{"), where["file"]).otherwise(place),
            "code.line.number": where["line"].try_cast("long").cast("string"),
            "code.function.name": F.coalesce(where["function"], F.when(is_text, F.regexp_replace(operation, r"\(\)$", ""))),
            rec.ext("gcpjson.operation"): F.when(~is_text, operation),
        },
        more=maps.prefixed(rec.json, rec.ext("gcpjson."), ("message", "severity", "timestamp", _GCP_PLACE, _GCP_OPERATION)),
    )


GCPJSON_BRANCH = Branch(
    "gcpjson", shape_gcpjson, lambda r: object_text(r.text) & needs(r.text, '"severity"', '"message"'),
    slots={"json": whole, "json2": lambda r: inner(r.j(_GCP_PLACE))},
    claim=lambda r: (F.get_json_object(r.text, "$.severity") != "") & F.get_json_object(r.text, "$.message").isNotNull(),
)

# -- tracing


def shape_tracing(rec: Rec) -> Shape:
    fields = rec.json2
    return Shape(
        body=fields["message"],
        level=levels.from_word(rec.j("level")),
        ts_us=times.rfc3339_micros(rec.j("timestamp")),
        more=maps.merge(maps.prefixed(fields, rec.ext("tracing."), ("message",)), maps.prefixed(rec.json, rec.ext("tracing."), ("fields", "timestamp", "level", "target"))),
        scope=rec.j("target"),
    )


TRACING_BRANCH = Branch(
    "tracing", shape_tracing, lambda r: object_text(r.text) & needs(r.text, '"fields"', '"target"', '"level"'),
    slots={"json": whole, "json2": lambda r: inner(r.j("fields"))},
    claim=lambda r: (F.get_json_object(r.text, "$.fields.message") != "") & (F.get_json_object(r.text, "$.level") != "") & (F.get_json_object(r.text, "$.target") != ""),
)

# -- pino


def tagged_object(text: Column) -> Cut:
    """An object, perhaps behind a tag in brackets."""
    inner_ = F.when(text.startswith("["), F.ltrim(behind(text, "]"))).otherwise(text)
    return form(inner_.startswith("{") & inner_.endswith("}"), [F.when(text.startswith("["), before(F.substr(text, F.lit(2)), "]")), inner_])


def _pino_object(rec: Rec) -> Column:
    return F.coalesce(F.get(tagged_object(F.trim(rec.text)).array, F.lit(2)), F.lit(""))


def shape_pino(rec: Rec) -> Shape:
    error = rec.j("error")
    e = rec.json2
    return Shape(
        body=first_of(rec.j("msg"), e["message"]),
        level=levels.from_source("pino", rec.j("level")),
        ts_us=times.epoch_micros(rec.j("time").try_cast("double")),
        put={
            "process.pid": rec.j("pid"),
            "exception.type": F.nullif(e["name"], F.lit("")),
            "exception.message": F.coalesce(F.nullif(e["message"], F.lit("")), F.when(~error.startswith("{"), error)),
            "exception.stacktrace": F.nullif(e["stack"], F.lit("")),
        },
        more=maps.merge(
            F.coalesce(maps.prefixed(e, rec.ext("pino.error."), ("name", "message", "stack")), maps.empty()),
            maps.prefixed(rec.json, rec.ext("pino."), ("level", "time", "pid", "hostname", "msg", "error", "trace_id", "span_id")),
        ),
        scope=rec.g(1),
    )


PINO_BRANCH = Branch(
    "pino", shape_pino, lambda r: needs(r.text, "{", '"time"', '"level"'), cuts=tagged_object, text_of=lambda r: F.trim(r.text),
    slots={"json": lambda r: as_object(r.g(2)), "json2": lambda r: inner(F.when(r.j("error").startswith("{"), r.j("error")))},
    claim=lambda r: matches(r.text, r'"level"\s*:\s*\d') & F.get_json_object(_pino_object(r), "$.time").try_cast("double").isNotNull()
    & first_of(F.get_json_object(_pino_object(r), "$.msg"), F.get_json_object(_pino_object(r), "$.error.message")).isNotNull(),
)

# -- logrus, zap and slog


def text_line(text: Column) -> Column:
    """logrus' TextFormatter without colours: time, level and a quoted message come first."""
    found, (head, time, level, _) = cut(text, "time=", " level=", ' msg="')
    return every(found, head == "", time.startswith('"'), time.endswith('"'), named(F.rtrim(level)))

#: Levels of console lines.
CONSOLE_LEVELS = ("debug", "info", "warn", "error", "dpanic", "panic", "fatal")
_TABS = 4
_TIMES = ("time", "timestamp", "Time", "Timestamp", "ts", "@timestamp")
_LEVELS = ("level", "Level", "severity", "Severity")
_MESSAGES = ("msg", "message", "Msg", "Message")
_EVENTS = ("start reconcile", "end reconcile", "event")
_KNOWN = (*_TIMES, *_LEVELS, *_MESSAGES, *_EVENTS, "caller", "controller", "error", "stacktrace", "logger", "module")


def _logrus_json(rec: Rec) -> Column:
    t = rec.text
    key = lambda *names: t.rlike("|".join(f'"{n}"' for n in names))
    return t.startswith("{") & (F.length(t) >= 10) & key(*_LEVELS) & (key(*_MESSAGES) | key("ts", "time", "Time", "@timestamp")) & is_object(rec)


def _zap_tail(rec: Rec) -> Column:
    """The line itself, or the object in the fifth of the fields that tabs divide."""
    return F.when(rec.text.startswith("{"), rec.text).otherwise(F.get(F.split(rec.text, "\t", _TABS + 1), F.lit(_TABS)))


def _join_error(message: Column, error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) == "", message).when(message.endswith(":"), F.concat(message, F.lit(" "), error)).otherwise(F.concat(message, F.lit(": "), error))


def shape_logrus(rec: Rec) -> Shape:
    t = rec.text
    is_json, is_text = t.startswith("{"), t.startswith("time=")
    zap, kv, j = rec.caps, rec.kv, rec.json
    pick = lambda names: first_of(*[j[n] for n in names])
    event = F.coalesce(*[F.concat(F.lit(f"{k}: "), j[k]) for k in _EVENTS])
    message = F.when(is_json, F.coalesce(pick(_MESSAGES), event)).when(is_text, pairs.last_value(kv, "msg")).otherwise(F.get(zap, F.lit(3)))
    level = F.when(is_json, pick(_LEVELS)).when(is_text, pairs.last_value(kv, "level")).otherwise(F.get(zap, F.lit(1)))
    raw_time = F.when(is_json, pick(_TIMES)).when(is_text, pairs.last_value(kv, "time")).otherwise(F.get(zap, F.lit(0)))
    caller = F.when(is_json, j["caller"]).when(is_text, pairs.last_value(kv, "caller")).otherwise(F.get(zap, F.lit(2)))
    error = F.when(is_text, pairs.last_value(kv, "error")).otherwise(F.nullif(j["error"], F.lit("")))
    rest = F.when(is_text, pairs.as_map(kv, rec.ext("logrus."), ("time", "level", "msg", "caller", "error"))).otherwise(maps.prefixed(j, rec.ext("logrus."), _KNOWN))
    return Shape(
        body=bodies.compose(F.when(is_json, j["module"]), _join_error(message, error)),
        level=levels.from_word(level),
        ts_us=F.coalesce(times.rfc3339_micros(raw_time), times.epoch_micros(raw_time.try_cast("double"))),
        put={
            **source_place(caller),
            rec.ext("k8s.controller"): F.nullif(j["controller"], F.lit("")),
            "exception.message": error,
            "exception.stacktrace": F.nullif(j["stacktrace"], F.lit("")),
        },
        more=rest,
        scope=j["logger"],
    )


def _zap_console(text_: Column) -> Column:
    """A time, a level and two more fields, divided by tabs."""
    cells = F.split(text_, "\t", _TABS)
    at_time = F.get(cells, F.lit(0))
    return (F.length(text_) >= 30) & (F.size(cells) == _TABS) & F.get(cells, F.lit(1)).isin(*CONSOLE_LEVELS) & (F.substring(at_time, 11, 1) == "T") & at_time.try_cast("timestamp").isNotNull()


LOGRUS_BRANCH = Branch(
    "logrus", shape_logrus,
    lambda r: begins(r.text, "{t0123456789") & (F.length(r.text) >= 10),
    slots={
        "caps": lambda r: F.split(r.text, "\t"),
        "json": lambda r: F.coalesce(as_object(_zap_tail(r)), maps.empty()),
        "kv": lambda r: pairs.found(F.when(r.text.startswith("time="), r.text).otherwise(""), pairs.ESCAPED),
    },
    claim=lambda r: F.when(r.text.startswith("{"), _logrus_json(r)).when(r.text.startswith("t"), text_line(r.text)).otherwise(_zap_console(r.text)),
)

# -- collector console lines


@marked("[", "]: ")
def program_line(text: Column, app: Column, pid: Column, rest: Column) -> tuple[Column, list[Column]]:
    """What syslog puts in front, program and process, and what follows."""
    return every(solid(app), digits(pid)), [app, pid, rest]


def _console(rec: Rec) -> Column:
    """time, level, caller, message, fields of the line or of the one in original_message."""

    def cells(text: Column) -> Column:
        head = program_line(text)
        s = F.when(head.ok, F.get(head.array, F.lit(3))).otherwise(text)
        return F.split(F.when(s.contains("\t"), s).otherwise(F.replace(s, F.lit("#011"), F.lit("\t"))), "\t", 5)

    return F.when(rec.text.contains('"otelcol.component'), cells(rec.text)).otherwise(cells(F.coalesce(rec.attributes["original_message"], F.lit(""))))


def _is_console(rec: Rec) -> Column:
    return network.let(_console(rec), _console_parts)


def _console_parts(p: Column) -> Column:
    at = lambda i: F.get(p, F.lit(i))
    zoned = F.regexp_extract(at(0), "(?:Z|[+-][0-9:]{4,6})$", 0) != ""
    return (F.size(p) == 5) & (F.substring(at(0), 11, 1) == "T") & zoned & F.coalesce(times.rfc3339_micros(at(0)), F.lit(0)).cast("boolean") & (F.lower(at(1)) == at(1)) & at(2).contains(":") & at(4).contains('"otelcol.component')


def shape_collector(rec: Rec) -> Shape:
    at = lambda i: F.get(rec.caps, F.lit(i))
    j = maps.without(rec.json, ["resource", "otelcol.signal", "otelcol.component.kind", "otelcol.component.id"])
    name = rec.j("otelcol.component.id")
    debug = (rec.j("otelcol.component.kind") == "exporter") & name.rlike("^debug(/|$)")
    debug = F.coalesce(debug, F.lit(False))
    entries = F.array_sort(F.map_entries(j))
    counts = F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), bodies.quoted(e.value))), " ")
    own = F.map_filter(j, lambda k, v: v.isNotNull() & ~k.startswith("otelcol.") & (k != "error"))
    official = F.map_filter(j, lambda k, v: v.isNotNull() & k.startswith("otelcol."))
    more = maps.merge(F.transform_keys(own, lambda k, _: F.concat(F.lit(rec.ext("collector.")), k)), official)
    place = source_place(at(2))
    return Shape(
        body=F.when(debug, bodies.joined(at(3), counts)).otherwise(at(3)),
        level=F.when(debug, levels.DEBUG).otherwise(levels.from_word(at(1))),
        ts_us=times.rfc3339_micros(at(0)),
        put={
            "process.pid": F.get(program_line(rec.text).read(), F.lit(2)),
            "code.file.path": F.regexp_replace(place["code.file.path"], "@[^/]+", ""),
            "code.line.number": place["code.line.number"],
            "otel.component.name": name,
            "exception.message": F.when(~debug, j["error"]),
        },
        more=F.when(debug, maps.empty()).otherwise(more),
        drop=("original_message",),
        scope=name,
    )


COLLECTOR_BRANCH = Branch(
    "collector", shape_collector, lambda r: r.text.contains('"otelcol.component') | F.coalesce(r.attributes["original_message"].contains('"otelcol.component'), F.lit(False)),
    claim=_is_console, slots={"caps": _console, "json": lambda r: as_object(F.get(r.caps, F.lit(4)))},
)

# -- lldpd

_LLDP = ("chassis_id", "chassis_name", "chassis_descr", "port_id", "port_descr", "via", "age")


def shape_lldpd(rec: Rec) -> Shape:
    first_ip = F.get_json_object(rec.text, "$.mgmt_ip[0]")
    return Shape(
        body=bodies.joined(rec.j("interface"), F.lit("sees"), rec.j("chassis_name"), F.lit("port"), rec.j("port_id"), first_ip),
        ts_us=times.rfc3339_micros(rec.j("observed_at")),
        put={
            "network.interface.name": rec.j("interface"),
            "client.mac.address": F.nullif(rec.j("chassis_id"), F.lit("")),
            "client.address": first_ip,
            rec.ext("lldp.mgmt_ip"): rec.j("mgmt_ip"),
            **{rec.ext(f"lldp.{k}"): F.nullif(rec.j(k), F.lit("")) for k in _LLDP},
        },
        drop=("interface", "client.mac", "client.ip", "mgmt_ip", "observed_at", *_LLDP),
    )


LLDPD_BRANCH = Branch(
    "lldpd", shape_lldpd, lambda r: begins(r.text, "{") & needs(r.text, '"chassis_id"', '"port_id"', '"interface"'), slots={"json": whole},
    claim=lambda r: (F.get_json_object(r.text, "$.interface") != "") & (F.get_json_object(r.text, "$.chassis_name") != "") & (F.get_json_object(r.text, "$.port_id") != ""),
)

# -- Kubernetes: pod status lines, events, lift keys

#: Namespace, pod, phase, how many are ready, node.


@marked("Pod ", "/", ": ")
def pod_line(text: Column, head: Column, namespace: Column, name: Column, said: Column) -> tuple[Column, list[Column]]:
    """``Pod namespace/name: phase (ready/all ready) on node``; the counts and the node may be missing."""
    phase, ready, node = before(said, " "), before(behind(said, "("), " ready)"), behind(said, " on ")
    whole = F.concat(phase, F.coalesce(F.concat(F.lit(" ("), ready, F.lit(" ready)")), F.lit("")), F.coalesce(F.concat(F.lit(" on "), node), F.lit("")))
    ok = every(head == "", solid(namespace), solid(name), named(phase), said == whole, F.coalesce(digits(F.replace(ready, F.lit("/"), F.lit(""))), F.lit(True)), F.coalesce(solid(node), F.lit(True)))
    return F.coalesce(ok, F.lit(False)), [namespace, name, phase, ready, node]


#: The resource's keys and the record's keys that move there.
LIFT = {
    "k8s.namespace.name": ("k8s.namespace.name", "namespace"),
    "k8s.pod.name": ("k8s.pod.name", "pod"),
    "k8s.node.name": ("k8s.node.name", "node"),
    "k8s.cluster.name": ("k8s.cluster.name", "cluster"),
}


def lift(rec: Rec) -> dict[str, Column]:
    """What the resource takes from the record: its own value first."""
    out = {k: F.coalesce(rec.r(k), *[rec.a(s) for s in sources]) for k, sources in LIFT.items()}
    out["host.name"] = F.coalesce(rec.r("host.name"), out["k8s.node.name"])
    return out


def _plain_note(note: Column) -> Column:
    """The message and code of a note that is a JSON object, other notes as they are."""
    at = lambda path: F.when(F.trim(note).startswith("{"), F.get_json_object(note, path))
    short = F.nullif(F.regexp_replace(F.trim(at("$.message")), r"\.+$", ""), F.lit(""))
    code = F.coalesce(F.concat(F.lit(" ("), F.nullif(at("$.code"), F.lit("")), F.lit(")")), F.lit(""))
    return F.coalesce(F.concat(short, code), note)


def shape_k8s(rec: Rec) -> Shape:
    pod, event, subject = rec.caps, rec.json, rec.json2
    is_pod = pod.isNotNull()
    from_attrs = rec.a("k8s.event.reason").isNotNull()
    is_event = ~is_pod & (F.coalesce(event["reason"], subject["kind"]).isNotNull() | from_attrs)
    reason = F.coalesce(event["reason"], rec.a("k8s.event.reason"))
    tail = F.when(from_attrs & rec.text.contains(": "), F.regexp_extract(rec.text, r"(?s): [^:]* - (.*)$", 1))
    note = first_of(event["message"], rec.a("k8s.event.note"), tail)
    note = network.let(note, _plain_note)
    kind = first_of(subject["kind"], rec.a("k8s.event.regarding.kind"))
    name = first_of(subject["name"], rec.a("k8s.event.regarding.name"))
    namespace = first_of(subject["namespace"], rec.a("k8s.event.regarding.namespace"))
    host = F.get_json_object(event["source"], "$.host")
    typ = F.coalesce(event["type"], F.when(F.coalesce(rec.a("k8s.object.kind"), F.lit("Event")) == "Event", rec.a("k8s.event.type")))
    up = lift(rec)
    static = node_of_static_pod(F.when(is_pod, group(pod, 2)).otherwise(up["k8s.pod.name"]), tuple(rec.options.get("static_pod_nodes", ())))
    node = F.when(is_pod, F.coalesce(group(pod, 5), static))
    return Shape(
        body=F.when(is_pod, bodies.joined(group(pod, 3), F.concat(F.lit("("), group(pod, 4), F.lit(" ready)")))).when(is_event, F.coalesce(F.concat(reason, F.lit(": "), note), reason, note)),
        level=F.when(is_event & (typ == "Normal"), levels.INFO).when(is_event & (typ == "Warning"), levels.WARN),
        put={"k8s.pod.status.phase": F.when(is_pod, group(pod, 3))},
        drop=("namespace", "pod", "node", "cluster", *LIFT),
        resource={
            "k8s.namespace.name": F.when(is_pod, group(pod, 1)).otherwise(F.coalesce(up["k8s.namespace.name"], namespace)),
            "k8s.pod.name": F.when(is_pod, group(pod, 2)).otherwise(F.coalesce(up["k8s.pod.name"], F.when(kind == "Pod", name))),
            "k8s.node.name": F.coalesce(node, up["k8s.node.name"], F.when(kind == "Node", name), F.when(~is_event, static)),
            "k8s.cluster.name": up["k8s.cluster.name"],
            "host.name": F.coalesce(node, host, up["host.name"], F.when(kind == "Node", name), F.when(~is_event, static)),
            "service.name": F.when(is_pod, group(pod, 2)).when(is_event & name.isNotNull(), F.concat_ws("/", F.coalesce(kind, F.lit("")), name)).when(is_event, kind),
        },
        original=False,
    )


def _k8s_claim(rec: Rec) -> Column:
    t = F.trim(rec.text)
    event = object_text(rec.text) & t.rlike('"involvedObject"|"reason"') & F.coalesce(F.get_json_object(t, "$.reason"), F.get_json_object(t, "$.involvedObject.kind")).isNotNull()
    keys = F.coalesce(rec.a("k8s.event.reason"), *[rec.a(k) for k in LIFT]).isNotNull()
    return pod_line(t).ok | F.coalesce(event, F.lit(False)) | keys


K8S_BRANCH = Branch(
    "k8s", shape_k8s, lambda r: F.lit(True), claim=_k8s_claim,
    slots={"caps": lambda r: pod_line(F.trim(r.text)).read(), "json": lambda r: F.when(object_text(r.text), as_object(r.text)), "json2": lambda r: inner(r.j("involvedObject"))},
)

# -- EKS audit


def shape_eksaudit(rec: Rec) -> Shape:
    at = lambda path: F.nullif(F.get_json_object(rec.text, path), F.lit(""))
    verb, code = F.upper(at("$.verb")), at("$.responseStatus.code").try_cast("int")
    resource = F.concat_ws("/", at("$.objectRef.resource"), at("$.objectRef.subresource"))
    target = F.when(at("$.objectRef.resource").isNull(), at("$.requestURI")).otherwise(bodies.joined(resource, F.concat_ws("/", at("$.objectRef.namespace"), at("$.objectRef.name"))))
    cluster = F.nullif(F.regexp_extract(rec.any("cloudwatch.log.group.name"), "^/aws/eks/([^/]*)", 1), F.lit(""))
    return Shape(
        body=bodies.joined(verb, target, code.cast("string")),
        level=levels.from_http(code),
        put={"http.request.method": verb, rec.ext("audit.level"): at("$.level"), "http.response.status_code": code.cast("string")},
        resource={"service.name": agents.short_principal(at("$.user.username")), "host.name": agents.alias(cluster, rec.options.get("account_aliases", {}))},
    )


EKS_BRANCH = Branch(
    "eksaudit", shape_eksaudit, lambda r: (r.source() == "aws.eks") & (F.length(r.text) <= 256 << 10),
    claim=lambda r: object_text(r.text) & F.coalesce(F.nullif(F.get_json_object(r.text, "$.verb"), F.lit("")), F.get_json_object(r.text, "$.auditID")).isNotNull(),
)

