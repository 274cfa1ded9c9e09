"""Branches that claim by the shape of one text line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions import agents, bodies, levels, network, pairs, times
from lumenloom.functions.cleaning import strip_ansi
from lumenloom.functions.maps import first_of
from lumenloom.functions.cuts import CLOCK, DATE, MONTHS, Cut, at, before, behind, digits, every, first_line, form, fraction, last, like, marked, more_lines, named, request, solid, spaced, until_last
from lumenloom.functions.patterns import first, group
from lumenloom.operators.logshape.core import Branch, Rec, Shape, begins, needs

DIGITS = "0123456789"


def source_place(place: Column) -> dict[str, Column]:
    """``file.go:12`` as its file and line; the whole as the file where there is no line."""
    has = place.rlike(r"^.+:-?\d+$")
    return {
        "code.file.path": F.when(has, F.regexp_extract(place, r"^(.+):-?\d+$", 1)).otherwise(F.nullif(place, F.lit(""))),
        "code.line.number": F.when(has, F.regexp_extract(place, r":(-?\d+)$", 1)),
    }


def as_int(text: Column) -> Column:
    """Digits without leading zeros; other texts as they are."""
    return F.coalesce(text.try_cast("long").cast("string"), text)


def path_of(target: Column) -> Column:
    return F.substring_index(target, "?", 1)


def query_of(target: Column) -> Column:
    return F.when(target.contains("?"), F.regexp_extract(target, r"\?(.*)$", 1))


def dash(text: Column) -> Column:
    return F.nullif(text, F.lit("-"))


def trimmed(rec: Rec) -> Column:
    return F.trim(rec.text)


def plain(rec: Rec) -> Column:
    return strip_ansi(rec.text)


# -- klog


@spaced(of=lambda t: before(t, "]"))
def klog_line(text: Column, w: Column) -> tuple[Column, list[Column]]:
    """``Lmmdd hh:mm:ss.uuuuuu threadid file:line] msg``, as klog's documentation has it; the thread is padded."""
    place = at(w, 3)
    file, number = before(place, ":"), behind(place, ":")
    ok = every(F.size(w) == 4, F.substring(at(w, 0), 1, 1).isin(*"IWEF"), F.length(at(w, 0)) == 5, digits(F.substr(at(w, 0), F.lit(2))), fraction(at(w, 1), f"{CLOCK}."), digits(at(w, 2)), file != "", digits(number), ~text.contains("\n"))
    return ok, [F.left(at(w, 0), F.lit(1)), F.substr(at(w, 0), F.lit(2)), at(w, 1), at(w, 2), file, number, F.ltrim(behind(text, "]"))]


STATIC_PODS = ("kube-apiserver-", "kube-controller-manager-", "kube-scheduler-", "etcd-")
_LIFTED = ("pod", "podUID", "podID", "containerName", "containerID")


def node_of_static_pod(pod: Column, more: tuple[str, ...] = ()) -> Column:
    out = F.lit(None).cast("string")
    for p in (*STATIC_PODS, *more):
        out = F.coalesce(out, F.when(pod.startswith(p), F.nullif(F.substr(pod, F.lit(len(p) + 1)), F.lit(""))))
    return out


def shape_klog(rec: Rec) -> Shape:
    message = F.trim(F.coalesce(rec.g(7), F.lit("")))
    quoted = first(message, r'^"([^"]+)"')
    kv = rec.kv
    pod = pairs.last_value(kv, "pod")
    both = pod.rlike("^[^/]+/.+$")
    node = node_of_static_pod(rec.r("k8s.pod.name"), tuple(rec.options.get("static_pod_prefixes", ())))
    level = levels.from_source("klog", rec.g(1))
    for letter, word in rec.options.get("klog_levels", {}).items():
        level = F.when(rec.g(1) == letter, levels.from_word(F.lit(word))).otherwise(level)
    return Shape(
        body=bodies.joined(F.coalesce(quoted, message), pairs.line(kv, _LIFTED)),
        level=level,
        ts_us=times.without_year(F.concat(rec.g(2), F.lit(" "), F.rpad(rec.g(3), 15, "0")), "MMdd HH:mm:ss.SSSSSS", F.coalesce(rec.ts_us, F.unix_micros(F.current_timestamp())), rec.options.get("klog_year", 0)),
        put={
            "process.pid": as_int(rec.g(4)),
            "code.file.path": rec.g(5),
            "code.line.number": as_int(rec.g(6)),
            "container.id": pairs.last_value(kv, "containerID"),
        },
        resource_fill={
            "k8s.namespace.name": F.when(both, F.substring_index(pod, "/", 1)),
            "k8s.pod.name": F.when(both, F.regexp_extract(pod, "^[^/]+/(.+)$", 1)),
            "k8s.pod.uid": F.coalesce(pairs.last_value(kv, "podUID"), pairs.last_value(kv, "podID")),
            "k8s.container.name": pairs.last_value(kv, "containerName"),
            "k8s.node.name": node,
            "host.name": node,
        },
    )


KLOG_BRANCH = Branch("klog", shape_klog, lambda r: begins(r.text, "IWEF") & (F.length(r.text) >= 20), cuts=klog_line, slots={"kv": lambda r: pairs.found(F.regexp_extract(F.trim(r.g(7)), r'(?s)^"[^"]+"\s*(.*)$', 1))})

# -- access lines


def access(rec: Rec, *, client: Column, user: Column | None, method: Column, target: Column, status: Column, size: Column | None = None, micros: Column | None = None, agent: Column | None = None, put: dict | None = None, **more) -> Shape:
    path, query, code = path_of(target), query_of(target), status.try_cast("int")
    n = size.try_cast("long") if size is not None else None
    return Shape(
        body=bodies.http_line(method, path, code, query=query, size=n, micros=micros),
        level=levels.from_http(code),
        put={
            "client.address": client,
            "http.request.method": method,
            "url.path": path,
            "url.query": F.nullif(query, F.lit("")),
            "http.response.status_code": code.cast("string"),
            **({"http.response.body.size": F.when(n > 0, n.cast("string"))} if n is not None else {}),
            **({"user.name": dash(user)} if user is not None else {}),
            **({"user_agent.original": F.nullif(agent, F.lit(""))} if agent is not None else {}),
            **(put or {}),
        },
        **more,
    )


#: Level names of Python's logging, and the one that uvicorn adds.
PYTHON_LEVELS = ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def uvicorn_line(text: Column) -> Cut:
    """``LEVEL:     message``: the level with its colon is padded."""
    said = behind(text, ":")
    return form(before(text, ":").isin(*PYTHON_LEVELS) & said.startswith(" ") & ~text.contains("\n"), [before(text, ":"), F.trim(said)])


@marked(' - "')
def uvicorn_access(said: Column, peer: Column, rest: Column) -> tuple[Column, list[Column]]:
    """``client:port - "request" status text``, uvicorn's own access format."""
    status = F.trim(last(rest, '" '))
    ok = every(rest.contains('" '), solid(peer), peer.contains(":"), digits(last(peer, ":")), digits(F.left(status, F.lit(3))), F.length(before(status, " ")) == 3)
    return ok, [until_last(peer, ":"), last(peer, ":"), until_last(rest, '" '), F.left(status, F.lit(3)), F.trim(F.substr(status, F.lit(4)))]


def shape_uvicorn(rec: Rec) -> Shape:
    caps = rec.caps2
    is_access = caps.isNotNull()
    request = F.split(group(caps, 3), " ", 3)
    method, target, protocol = (F.nullif(F.get(request, F.lit(i)), F.lit("")) for i in range(3))
    path, query, code = path_of(target), query_of(target), group(caps, 4).try_cast("int")
    return Shape(
        body=F.when(is_access, bodies.http_line(method, path, code, query=query)).otherwise(rec.g(2)),
        level=F.coalesce(F.when(is_access, levels.from_http(code)), levels.from_word(rec.g(1))),
        put={
            "client.address": F.when(is_access, F.translate(group(caps, 1), "[]", "")),
            "client.port": group(caps, 2),
            "http.request.method": method,
            "url.path": F.when(is_access, path),
            "url.query": F.nullif(query, F.lit("")),
            "network.protocol.name": F.when(protocol.isNotNull(), "http"),
            "network.protocol.version": F.nullif(F.substr(protocol, F.lit(6)), F.lit("")),
            "http.response.status_code": code.cast("string"),
            rec.ext("uvicorn.status_text"): group(caps, 5),
        },
    )


UVICORN_BRANCH = Branch("uvicorn", shape_uvicorn, lambda r: begins(r.text, "TDIWEC") & needs(r.text, ":"), cuts=uvicorn_line, slots={"caps2": lambda r: uvicorn_access(r.g(2)).read()})


@marked(" - ", " [", '] "', '" ', " ", ' "', '" "', '"')
def combined_line(text: Column, addr: Column, user: Column, time: Column, asked: Column, status: Column, size: Column, referer: Column, agent: Column, more: Column) -> tuple[Column, list[Column]]:
    """nginx's ``combined`` format, and one quoted field more: the addresses that a request was forwarded for."""
    three, (method, target, protocol) = request(asked)
    return every(three, solid(addr), solid(user), digits(status), digits(size)), [addr, user, time, method, target, protocol, status, size, referer, agent, before(behind(more, ' "'), '"')]


CLF_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def forwarded(header: Column) -> Column:
    """The first entry of X-Forwarded-For, if it is an address."""
    one = F.trim(F.substring_index(header, ",", 1))
    return F.when(network.is_address(one), one).when(network.is_address(network.host(one)), network.host(one))


def shape_nginx(rec: Rec) -> Shape:
    method, target, protocol = rec.g(4), rec.g(5), rec.g(6)
    agent, peer = dash(rec.g(10)), rec.g(1)
    client = forwarded(rec.g(11))
    bytes_out = rec.g(8).try_cast("long")
    path, query, code = path_of(target), query_of(target), rec.g(7).try_cast("int")
    return Shape(
        body=bodies.http_line(method, path, code, query=query, size=bytes_out),
        level=levels.from_http(code),
        ts_us=times.micros(rec.g(3), CLF_TIME),
        put={
            "client.address": F.coalesce(client, peer),
            "network.peer.address": F.when(client.isNotNull(), peer),
            "http.request.method": method,
            "url.path": F.nullif(path, F.lit("")),
            "url.query": F.nullif(query, F.lit("")),
            "network.protocol.name": F.when(protocol.isNotNull(), "http"),
            "network.protocol.version": F.nullif(F.substr(protocol, F.lit(6)), F.lit("")),
            "http.response.status_code": code.cast("string"),
            "http.response.body.size": bytes_out.cast("string"),
            "http.request.header.referer": dash(rec.g(9)),
            "user.name": dash(rec.g(2)),
            "user_agent.original": agent,
            "user_agent.name": agents.browser(agent),
            "user_agent.version": agents.browser_version(agent),
            "user_agent.os.name": agents.system(agent),
            rec.ext("nginx.device_type"): F.when(agent.isNotNull(), agents.device(agent)),
        },
        resource_fill={"service.name": F.lit(rec.options.get("nginx_service", "nginx"))},
    )


NGINX_BRANCH = Branch("nginx", shape_nginx, lambda r: needs(r.text, "[", '"'), cuts=combined_line)


@marked("[httpd] ", " - ", " [", '] "', '" ', " ", ' "', '" "', '" ', " ")
def influx_line(text: Column, head: Column, addr: Column, user: Column, time: Column, asked: Column, status: Column, size: Column, _: Column, agent: Column, request_id: Column, micros: Column) -> tuple[Column, list[Column]]:
    """The common log format behind ``[httpd] ``, then referer, agent, request id and microseconds."""
    three, (method, target, _) = request(asked)
    return every(three, head == "", solid(addr), solid(user), digits(status), F.length(status) == 3, solid(size), solid(request_id), digits(micros)), [addr, user, time, method, target, status, size, agent, request_id, micros]


def shape_influx(rec: Rec) -> Shape:
    return access(
        rec, client=rec.g(1), user=rec.g(2), method=rec.g(4), target=rec.g(5), status=rec.g(6), size=rec.g(7), agent=rec.g(8),
        micros=rec.g(10).try_cast("long"), put={rec.ext("influx.request_id"): rec.g(9)},
        ts_us=F.coalesce(rec.ts_us, times.micros(rec.g(3), CLF_TIME)),
    )


INFLUX_BRANCH = Branch("influx", shape_influx, lambda r: r.text.startswith("[httpd] "), cuts=influx_line, text_of=trimmed)


@marked(" - ", " - ", " [", "] ", " ", " ", ' "', '" ', ' "', '" ', " ", " ")
def oauth_line(text: Column, client: Column, request_id: Column, user: Column, time: Column, host: Column, method: Column, upstream: Column, target: Column, protocol: Column, agent: Column, status: Column, size: Column, secs: Column) -> tuple[Column, list[Column]]:
    """The proxy's default request format: client, request id and user, time, host, method, upstream, target, protocol, agent, status, size, seconds."""
    ok = every(*map(solid, (client, request_id, host, method, upstream, protocol)), digits(status), F.length(status) == 3, digits(size), secs.try_cast("double").isNotNull())
    return ok, [client, request_id, user, time, method, upstream, target, agent, status, size, secs]


def shape_oauth(rec: Rec) -> Shape:
    user = F.coalesce(F.nullif(dash(F.substring_index(F.trim(rec.g(3)), " ", -1)), F.lit("")), dash(rec.g(6)))
    return access(
        rec, client=rec.g(1), user=user, method=rec.g(5), target=rec.g(7), status=rec.g(9), size=rec.g(10), agent=rec.g(8),
        micros=F.round(rec.g(11).try_cast("double") * 1e6).cast("long"), put={rec.ext("oauth2proxy.request_id"): rec.g(2)},
        ts_us=F.coalesce(rec.ts_us, times.utc_micros(rec.g(4), "yyyy/MM/dd HH:mm:ss")),
    )


OAUTH_BRANCH = Branch("oauth2proxy", shape_oauth, lambda r: needs(r.text, " - ", " [", '"'), cuts=oauth_line, text_of=trimmed)


@marked(" - ", ' "', '" ', of=lambda t: F.when(t.startswith("["), behind(t, "] ")).otherwise(t))
def coredns_line(text: Column, remote: Column, number: Column, question: Column, answer: Column) -> tuple[Column, list[Column]]:
    """The log plugin's common format: remote, id, the question of seven words, the answer of four; a level may stand in front."""
    q, a = F.split(question, " "), F.split(answer, " ")
    secs = F.rtrim(at(a, 3), F.lit("s"))
    ok = every(solid(remote), digits(number), F.size(q) == 7, digits(at(q, 4)), digits(at(q, 6)), F.size(a) == 4, digits(at(a, 2)), at(a, 3).endswith("s"), secs.try_cast("double").isNotNull())
    return ok, [remote, at(q, 0), at(q, 2), at(a, 0), secs]


def shape_coredns(rec: Rec) -> Shape:
    secs = rec.g(5).try_cast("double")
    return Shape(
        body=bodies.joined(rec.g(4), rec.g(2), rec.g(3), bodies.duration_text(F.round(secs * 1e6))),
        level=levels.from_dns(rec.g(4)),
        put={
            "client.address": network.host(rec.g(1)),
            "client.port": network.port(rec.g(1)).cast("string"),
            "dns.question.name": rec.g(3),
            rec.ext("dns.question.type"): rec.g(2),
            rec.ext("dns.response_code"): rec.g(4),
            rec.ext("dns.duration"): secs.cast("string"),
        },
    )


COREDNS_BRANCH = Branch("coredns", shape_coredns, lambda r: needs(r.text, " - ", '"') & (F.length(r.text) >= 20), cuts=coredns_line)

# -- servers

#: The server's message severities.
POSTGRES_LEVELS = ("LOG", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG", *(f"DEBUG{i}" for i in range(1, 6)), "FATAL", "PANIC")


@marked(" ", " ", " [", "] ", ":")
def postgres_line(text: Column, day: Column, clock: Column, zone: Column, pid: Column, level: Column, said: Column) -> tuple[Column, list[Column]]:
    """A log_line_prefix of ``%m [%p] ``, the severity and the message; further lines stay together."""
    w = F.ltrim(said)
    ok = every(like(day, DATE), F.length(day) == 10, fraction(clock, f"{CLOCK}."), named(zone), digits(pid), level.isin(*POSTGRES_LEVELS), said.startswith(" "))
    return ok, [F.concat(day, F.lit(" "), clock), zone, pid, level, first_line(w), more_lines(w)]


#: Hours from UTC of the zones that are read.
ZONES = {"UTC": 0, "GMT": 0, "CET": 1, "CEST": 2}


def postgres_detail(more: Column, label: str) -> Column:
    """What a further line of this label says; it has a head of its own."""
    of = F.transform(F.filter(F.split(more, "\n"), lambda x: before(behind(x, "] "), ":") == label), lambda x: F.trim(behind(x, f"] {label}:")))
    return at(of, 0)


def shape_postgres(rec: Rec) -> Shape:
    shift = F.lit(None).cast("long")
    for zone, hours in ZONES.items():
        shift = F.when(rec.g(2) == zone, F.lit(hours * 3_600_000_000)).otherwise(shift)
    more = rec.g(6)
    return Shape(
        body=F.trim(rec.g(5)),
        level=levels.from_source("postgres", rec.g(4)),
        ts_us=times.utc_micros(F.rpad(rec.g(1), 26, "0"), "yyyy-MM-dd HH:mm:ss.SSSSSS") - shift,
        put={"process.pid": as_int(rec.g(3)), **{rec.ext(f"postgres.{w.lower()}"): F.nullif(postgres_detail(more, w), F.lit("")) for w in ("DETAIL", "STATEMENT", "HINT", "CONTEXT")}},
    )


POSTGRES_BRANCH = Branch("postgres", shape_postgres, lambda r: (F.length(r.text) >= 30) & (F.substring(r.text, 5, 1) == "-") & needs(r.text, "] "), cuts=postgres_line)


@marked(":", " ", " ", " ", " ", " ", " ")
def redis_line(text: Column, pid: Column, role: Column, day: Column, month: Column, year: Column, clock: Column, mark: Column, said: Column) -> tuple[Column, list[Column]]:
    """``pid:role dd Mon yyyy hh:mm:ss.mmm mark message``."""
    ok = every(digits(pid), role.isin(*"MSCX"), digits(day), month.isin(*MONTHS), digits(year), fraction(clock, f"{CLOCK}."), mark.isin(*".-*#"), ~text.contains("\n"))
    return ok, [pid, role, F.concat_ws(" ", day, month, year, clock), mark, F.ltrim(said)]


def shape_redis(rec: Rec) -> Shape:
    role = F.when(rec.g(2) == "M", "master").when(rec.g(2) == "S", "slave").when(rec.g(2) == "C", "child").otherwise("sentinel")
    return Shape(
        body=rec.g(5),
        level=levels.from_source("redis", rec.g(4)),
        ts_us=times.utc_micros(rec.g(3), "d MMM yyyy HH:mm:ss.SSS"),
        put={"process.pid": as_int(rec.g(1)), rec.ext("redis.role"): role},
        resource_fill={"service.name": F.lit(rec.options.get("redis_service", "redis"))},
    )


REDIS_BRANCH = Branch("redis", shape_redis, lambda r: begins(r.text, DIGITS) & needs(r.text, ":") & (F.length(r.text) >= 20), cuts=redis_line)


@marked(" [", "] ", ": ")
def sentry_line(text: Column, clock: Column, level: Column, logger: Column, said: Column) -> tuple[Column, list[Column]]:
    """``hh:mm:ss [LEVEL] logger: event``."""
    return every(like(clock, CLOCK), F.length(clock) == 8, named(level), logger != "", ~text.contains("\n")), [clock, level, logger, F.ltrim(said)]


@marked("(")
def sentry_event(said: Column, name: Column, inner: Column) -> tuple[Column, list[Column]]:
    """A structured event: its name and its pairs in brackets."""
    return every(solid(F.rtrim(name)), said.endswith(")")), [F.rtrim(name), until_last(inner, ")")]


def shape_sentry(rec: Rec) -> Shape:
    event, kv = rec.caps2, rec.kv
    got = {k: pairs.last_value(kv, k) for k in ("method", "path", "response", "view", "caller_ip", "user_agent", "request_duration_seconds")}
    code = got["response"].try_cast("int")
    micros = F.round(got["request_duration_seconds"].try_cast("double") * 1e6).cast("long")
    line = F.when(code.isNotNull() & got["method"].isNotNull() & got["path"].isNotNull(), bodies.http_line(got["method"], got["path"], code, micros=micros))
    day = F.floor(rec.ts_us / 86_400_000_000) * 86_400_000_000
    clock = (F.substring(rec.g(1), 1, 2).cast("long") * 3600 + F.substring(rec.g(1), 4, 2).cast("long") * 60 + F.substring(rec.g(1), 7, 2).cast("long")) * 1_000_000
    at = day + clock
    return Shape(
        body=F.coalesce(line, group(event, 1), rec.g(4)),
        level=F.coalesce(levels.from_http(code), levels.from_word(rec.g(2))),
        ts_us=F.when(at > rec.ts_us + 3_600_000_000, at - 86_400_000_000).otherwise(at),
        put={
            "http.request.method": got["method"],
            "url.path": got["path"],
            "http.response.status_code": code.cast("string"),
            "client.address": got["caller_ip"],
            "user_agent.original": got["user_agent"],
            rec.ext("http.request.duration"): got["request_duration_seconds"],
            rec.ext("sentry.view"): got["view"],
            rec.ext("sentry.message_type"): group(event, 1),
        },
        resource_fill={"service.name": F.lit(rec.options.get("sentry_service", "sentry"))},
        scope=rec.g(3),
    )


SENTRY_BRANCH = Branch(
    "sentry", shape_sentry, lambda r: (F.substring(r.text, 3, 1) == ":") & (F.substring(r.text, 6, 1) == ":") & F.left(r.text, F.lit(30)).contains("["), cuts=sentry_line,
    slots={"caps2": lambda r: sentry_event(r.g(4)).read(), "kv": lambda r: pairs.found(F.coalesce(r.g2(2), F.lit("")), pairs.SINGLE_QUOTED)},
)


@marked(" ", " [", "] ")
def rabbit_line(text: Column, day: Column, clock: Column, level: Column, said: Column) -> tuple[Column, list[Column]]:
    """``date time+zone [level] message``; an Erlang process may stand before the message."""
    pid = F.when(said.startswith("<") & digits(F.translate(before(said, ">"), "<.", "")) & said.contains("> "), F.concat(before(said, ">"), F.lit(">")))
    zone = F.translate(F.substr(clock, F.lit(10)), "0123456789", "")
    ok = every(like(day, DATE), F.length(day) == 10, like(clock, f"{CLOCK}.0"), zone.isin("+:", "-:", "+", "-"), named(level), ~text.contains("\n"))
    return ok, [F.concat(day, F.lit(" "), clock), level, pid, F.when(pid.isNotNull(), behind(said, "> ")).otherwise(said)]


def shape_rabbit(rec: Rec) -> Shape:
    return Shape(body=F.trim(rec.g(4)), level=levels.from_word(rec.g(2)), ts_us=times.rfc3339_micros(rec.g(1)), put={rec.ext("rabbitmq.pid"): rec.g(3)})


RABBIT_BRANCH = Branch("rabbitmq", shape_rabbit, lambda r: needs(r.text, " ["), cuts=rabbit_line, text_of=plain)

#: First words of the broker's messages about connections, bridges and itself.
BROKER_WORDS = ("New", "Client", "Connecting", "Bridge", "Socket", "mosquitto", "Config", "Opening")


@marked(": ")
def mosquitto_line(text: Column, time: Column, said: Column) -> tuple[Column, list[Column]]:
    """A log_timestamp_format of ``%Y-%m-%dT%H:%M:%S``, then a message of the broker."""
    return every(like(time, f"{DATE}T{CLOCK}"), F.length(time) == 19, before(said, " ").isin(*BROKER_WORDS), ~text.contains("\n")), [time, said]


MOSQUITTO_BRANCH = Branch(
    "mosquitto", lambda r: Shape(body=r.g(2), ts_us=times.rfc3339_micros(r.g(1))),
    lambda r: (F.substring(r.text, 11, 1) == "T") & (F.substring(r.text, 20, 2) == ": "), cuts=mosquitto_line,
)


@marked("published ", "=")
def stall_line(text: Column, head: Column, name: Column, value: Column) -> tuple[Column, list[Column]]:
    """``published Name=value``, perhaps behind a container runtime's time, stream and tag."""
    h = F.split(head, " ")
    runtime = every(F.size(h) == 4, at(h, 0) != "", at(h, 1).isin("stdout", "stderr"), at(h, 2).isin("F", "P"), at(h, 3) == "")
    return every((head == "") | runtime, named(name), solid(value), ~text.contains("\n")), [at(h, 0), name, value]


def shape_stall(rec: Rec) -> Shape:
    return Shape(
        body=F.concat(F.lit("published "), rec.g(2), F.lit("="), rec.g(3)),
        level=F.lit(levels.INFO),
        ts_us=times.rfc3339_micros(rec.g(1)),
        put={rec.ext("stallcheck.stall_minutes"): F.when(rec.g(2) == "StallMinutes", as_int(rec.g(3)))},
    )


STALL_BRANCH = Branch("stallcheck", shape_stall, lambda r: needs(r.text, "published "), cuts=stall_line)


@marked("audit: type=", " audit(", ".", ":", "): ")
def kaudit_line(text: Column, head: Column, kind: Column, secs: Column, part: Column, serial: Column, rest: Column) -> tuple[Column, list[Column]]:
    """``audit: type=n audit(seconds.fraction:serial): pairs``, as the kernel's audit_log_start() prints it."""
    return every(head == "", digits(kind), digits(secs), digits(part), digits(serial)), [kind, secs, part, serial, rest]


def shape_kaudit(rec: Rec) -> Shape:
    kv = rec.kv
    v = lambda *k: first_of(*[pairs.last_value(kv, x) for x in k])
    head = bodies.joined(F.upper(v("apparmor")), v("operation"), v("requested", "requested_mask"))
    to = F.concat(F.lit(", to "), v("faddr", "addr"), F.coalesce(F.concat(F.lit(":"), v("fport", "port")), F.lit("")))
    text = F.concat(head, F.coalesce(F.concat(F.lit(", profile "), v("profile")), F.lit("")), F.coalesce(to, F.lit("")))
    return Shape(
        body=bodies.compose(F.lit("apparmor"), text),
        level=F.lit(levels.INFO),
        ts_us=rec.g(2).try_cast("long") * 1_000_000 + F.substring(F.rpad(rec.g(3), 9, "0"), 1, 6).try_cast("long"),
        put={rec.ext("audit.type"): as_int(rec.g(1)), rec.ext("audit.serial"): as_int(rec.g(4))},
        fill={"log.source": F.lit("kernel")},
        resource={"service.name": F.lit("audit")},
    )


KAUDIT_BRANCH = Branch("kaudit", shape_kaudit, lambda r: begins(r.text, "a") & needs(r.text, "audit: type=", "apparmor="), cuts=kaudit_line, slots={"kv": lambda r: pairs.found(r.g(5))})

@marked("Device: ", ", ")
def smartd_line(text: Column, head: Column, device: Column, said: Column) -> tuple[Column, list[Column]]:
    """``Device: /dev/name [type], message``; the type may be missing."""
    name = before(device, " [")
    return every(head == "", name.startswith("/dev/"), solid(name), (device == name) | device.endswith("]"), ~text.contains("\n")), [name, said]


def shape_smartd(rec: Rec) -> Shape:
    low = F.lower(rec.g(2))
    bad = F.when(low.contains("uncorrectable sectors") | low.contains("unreadable (pending) sectors"), levels.WARN).when(rec.g(2).contains("FAILED"), levels.ERROR)
    return Shape(level=bad, put={rec.ext("smartd.device"): rec.g(1)})


SMARTD_BRANCH = Branch("smartd", shape_smartd, lambda r: begins(r.text, "D") & needs(r.text, "Device: "), cuts=smartd_line)

def without_wrapper(text: Column) -> Column:
    """Without the ``jvm n    | `` that the service wrapper puts before each line."""
    rest = behind(text, "|")
    return F.when(text.startswith("jvm ") & digits(F.rtrim(F.substr(before(text, "|"), F.lit(5)))), F.when(rest.startswith(" "), F.substr(rest, F.lit(2))).otherwise(rest)).otherwise(text)


@marked(" ", " ", " [", "] ", ":", " - ")
def gocd_line(text: Column, day: Column, clock: Column, level: Column, thread: Column, place: Column, number: Column, said: Column) -> tuple[Column, list[Column]]:
    """log4j's ``%d{ISO8601} %5p [%t] %c{1}:%L - %m``."""
    ok = every(like(day, DATE), F.length(day) == 10, fraction(clock, f"{CLOCK},"), named(F.trim(level)), solid(place), digits(number))
    return ok, [F.concat(day, F.lit(" "), clock), F.trim(level), thread, place, number, said]


def shape_gocd(rec: Rec) -> Shape:
    inner = F.transform(F.split(rec.text, "\n"), without_wrapper)
    parts = F.transform(inner, lambda x: gocd_line(x).read())
    read = F.filter(parts, lambda c: c.isNotNull())
    head = F.get(read, F.lit(0))
    messages = F.transform(F.arrays_zip(inner.alias("t"), parts.alias("c")), lambda z: F.when(z.c.isNotNull(), F.get(z.c, F.lit(6))).otherwise(z.t))
    worst = F.array_max(F.transform(read, lambda c: F.coalesce(levels.from_word(F.get(c, F.lit(2))), F.lit(0))))
    return Shape(
        body=F.array_join(messages, "\n"),
        level=F.when(worst > 0, worst),
        put={"thread.name": F.get(head, F.lit(3)), "code.function.name": F.get(head, F.lit(4)), "code.line.number": as_int(F.get(head, F.lit(5)))},
    )


GOCD_BRANCH = Branch("gocd", shape_gocd, lambda r: r.text.startswith("jvm "), claim=lambda r: F.exists(F.split(r.text, "\n"), lambda x: F.coalesce(gocd_line(without_wrapper(x)).ok, F.lit(False))))

CRON_BRANCH = Branch("cron", lambda r: Shape(body=r.g(1), resource={"service.name": F.lit("cron")}), lambda r: r.text.startswith("cron: "), cuts=lambda t: form(t.startswith("cron: "), [F.substr(t, F.lit(7))]))

_LOGFMT_LIFTED = ("level", "lvl", "t", "ts", "logger", "component", "module", "msg", "source", "caller", "uname")


def shape_logfmt(rec: Rec) -> Shape:
    kv = rec.kv
    place = pairs.value(kv, "source", "caller")
    has = place.rlike(r"^.+:-?\d+$")
    return Shape(
        body=bodies.joined(pairs.value(kv, "msg"), pairs.line(kv, _LOGFMT_LIFTED)),
        level=levels.from_word(pairs.value(kv, "level", "lvl")),
        ts_us=times.rfc3339_micros(pairs.value(kv, "t", "ts")),
        put={**{k: F.when(has, v) for k, v in source_place(place).items()}, "user.email": pairs.value(kv, "uname")},
        scope=pairs.value(kv, "logger", "component", "module"),
    )


def _logfmt_keys(rec: Rec) -> Column:
    """A level, a message with a text, and one of the keys that this kind of logger has."""
    padded = F.concat(F.lit(" "), F.translate(rec.text, "\t\n", "  "))
    has = lambda *keys: F.array_contains(F.array(*[padded.contains(f" {k}=") for k in keys]), True)
    own = has("logger", "component", "module", "lvl") | rec.text.startswith("t=") | rec.text.startswith("ts=")
    said = F.substr(padded, F.call_function("instr", padded, F.lit("msg=")) + 4)
    return (rec.text.contains("level=") | rec.text.contains("lvl=")) & own & ~said.startswith('""') & ~F.left(said, F.lit(1)).isin("", " ")


LOGFMT_BRANCH = Branch(
    "logfmt", shape_logfmt, slots={"kv": lambda r: pairs.found(r.text, pairs.ESCAPED)}, gate=lambda r: needs(r.text, "msg=") & ~r.text.startswith("time="),
    claim=_logfmt_keys,
)


@marked(" [", "] {", "} <", "> ", ": ")
def clickhouse_line(text: Column, time: Column, thread: Column, query: Column, level: Column, component: Column, said: Column) -> tuple[Column, list[Column]]:
    """``date time [ thread ] {query} <Level> component: message``, the message of one or more lines."""
    ok = every(fraction(time, f"0000.00.00 {CLOCK}."), digits(F.trim(thread)), named(level), component != "", ~component.contains("\n"))
    return ok, [time, F.trim(thread), query, level, component, said]


def shape_clickhouse(rec: Rec) -> Shape:
    return Shape(
        body=rec.g(6),
        level=levels.from_source("clickhouse", rec.g(4)),
        ts_us=times.utc_micros(F.rpad(rec.g(1), 26, "0"), "yyyy.MM.dd HH:mm:ss.SSSSSS"),
        put={"thread.id": as_int(rec.g(2)), rec.ext("clickhouse.query_id"): rec.g(3)},
        scope=rec.g(5),
    )


CLICKHOUSE_BRANCH = Branch("clickhouse", shape_clickhouse, lambda r: begins(r.text, DIGITS) & needs(r.text, "} <"), cuts=clickhouse_line)


@marked(" [", "][", "] ", " ", ": ")
def calico_line(text: Column, time: Column, level: Column, thread: Column, file: Column, number: Column, said: Column) -> tuple[Column, list[Column]]:
    """``date time [LEVEL][thread] file line: message``."""
    return every(fraction(time, f"{DATE} {CLOCK}."), F.length(time) == 23, digits(thread), file != "", digits(number), ~text.contains("\n")), [time, level, thread, file, number, said]


def shape_calico(rec: Rec) -> Shape:
    return Shape(
        body=rec.g(6),
        level=levels.from_word(rec.g(2)),
        ts_us=times.utc_micros(rec.g(1), "yyyy-MM-dd HH:mm:ss.SSS"),
        put={"code.file.path": rec.g(4), "code.line.number": as_int(rec.g(5)), "thread.id": as_int(rec.g(3))},
    )


CALICO_BRANCH = Branch("calico", shape_calico, lambda r: begins(r.text, DIGITS) & needs(r.text, "]["), cuts=calico_line)


@marked(" ", " ", " ", " ")
def ssm_line(text: Column, day: Column, clock: Column, level: Column, component: Column, said: Column) -> tuple[Column, list[Column]]:
    """``date time LEVEL [component] message``, seconds with four decimals."""
    ok = every(like(day, DATE), F.length(day) == 10, fraction(clock, f"{CLOCK}."), F.length(clock) == 13, level.isin("ERROR", "WARN", "INFO", "DEBUG", "TRACE"), component != "", ~text.contains("\n"))
    return ok, [F.concat(day, F.lit(" "), clock), level, component, said]


SSM_BRANCH = Branch(
    "ssmagent",
    lambda r: Shape(body=r.g(4), level=levels.from_word(r.g(2)), ts_us=times.utc_micros(r.g(1), "yyyy-MM-dd HH:mm:ss.SSSS"), scope=r.g(3)),
    lambda r: (F.substring(r.text, 5, 1) == "-") & (F.substring(r.text, 11, 1) == " "), cuts=ssm_line,
)


@marked(" - ", ":", ": ", ":", " - ")
def litellm_line(text: Column, clock: Column, logger: Column, level: Column, file: Column, number: Column, said: Column) -> tuple[Column, list[Column]]:
    """A Python format of ``%(asctime)s - %(name)s:%(levelname)s: %(filename)s:%(lineno)s - %(message)s``, the time without a date."""
    ok = every(like(clock, CLOCK), F.length(clock) == 8, logger != "", F.upper(level).isin(*PYTHON_LEVELS), solid(file), digits(number), ~text.contains("\n"))
    return ok, [clock, logger, level, file, number, said]


def shape_litellm(rec: Rec) -> Shape:
    return Shape(body=rec.g(6), level=levels.from_word(rec.g(3)), put={"code.file.path": rec.g(4), "code.line.number": as_int(rec.g(5))}, scope=rec.g(2))


LITELLM_BRANCH = Branch("litellm", shape_litellm, lambda r: needs(r.text, " - "), cuts=litellm_line, text_of=plain)
