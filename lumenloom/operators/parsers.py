"""Parsers of single formats, each a branch of its own; lines of other forms stay as they are.

The formats that the ordered dispatch knows too (klog, nginx, ...) run here
through parse() by name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import bodies, levels, maps, network, pairs, times
from lumenloom.functions.cuts import CLOCK, DATE, Cut, at, before, behind, cut, digits, every, first_line, form, fraction, last, like, marked, more_lines, named, solid, spaced, until_last, words
from lumenloom.functions.maps import first_of
from lumenloom.functions.patterns import first, group
from lumenloom.operators.logshape import BY_NAME
from lumenloom.operators.logshape.core import Branch, Rec, Shape, as_object, flatten, needs, object_text, shaped

# -- charon


@marked("[", "] <", "> ")
def charon_line(text: Column, thread: Column, system: Column, connection: Column, said: Column) -> tuple[Column, list[Column]]:
    """``thread[SUBSYSTEM] <connection|number> message``; the number may be missing."""
    name, number = before(connection, "|"), behind(connection, "|")
    ok = every(digits(thread), named(system), name != "", F.coalesce((number == "") | digits(number), F.lit(True)), ~text.contains("\n"))
    return ok, [thread, system, name, number, F.ltrim(said)]


@marked(" packet: from ", "[", "] to ", "[", "] (", " bytes)")
def packet(said: Column, verb: Column, src: Column, sport: Column, dst: Column, dport: Column, size: Column, _: Column) -> tuple[Column, list[Column]]:
    """``received packet: from host[port] to host[port] (n bytes)``, and the same of what is sent."""
    return every(verb.isin("received", "sending"), src != "", digits(sport), dst != "", digits(dport), digits(size)), [verb, src, sport, dst, dport, size]


def word_behind(text_: Column, mark: str) -> Column:
    """The word behind the first ``mark``, null where there is none."""
    return F.nullif(before(F.ltrim(behind(text_, mark)), " "), F.lit(""))


def child_sa(said: Column) -> tuple[Column, Column]:
    """Name and state of ``CHILD_SA name{number} state``."""
    found, (_, name, _, state) = cut(said, "CHILD_SA ", "{", "}")
    ok = every(found, solid(name))
    return F.when(ok, name), F.when(ok & state.startswith(" "), F.nullif(before(F.ltrim(state), " "), F.lit("")))


def spis(said: Column) -> list[Column]:
    """The two indexes of ``SPIs one_i other_o``."""
    w = words(F.coalesce(behind(said, "SPIs "), behind(said, "SPI ")), 3)
    return [F.when(at(w, i).endswith(end), F.substr(at(w, i), F.lit(1), F.length(at(w, i)) - 2)) for i, end in enumerate(("_i", "_o"))]


def identity(said: Column) -> tuple[Column, Column]:
    """Who authenticates, and how it went."""
    rest = behind(said, "authentication of '")
    how = words(behind(rest, "' with "), 3)
    return before(rest, "'"), F.when(at(how, 1).isin("successful", "failed"), at(how, 1))


def shape_charon(r: Rec) -> Shape:
    said, packet = r.g(5), r.caps2
    low = F.lower(said)
    who, auth = identity(said)
    child, state = child_sa(said)
    spi_in, spi_out = spis(said)
    selector = behind(said, "TS ")
    sent = group(packet, 1) == "sending"
    late = low.contains("retransmit") | low.contains("timeout") | low.contains("giving up")
    level = F.when(low.contains("error") | low.contains("failed"), levels.ERROR).when(late, levels.WARN).otherwise(levels.INFO)
    return Shape(
        body=said,
        level=level,
        put={
            "thread.id": r.g(1),
            r.ext("ipsec.subsystem"): r.g(2),
            r.ext("ipsec.connection"): r.g(3),
            r.ext("ipsec.connection_id"): r.g(4),
            "source.address": group(packet, 2),
            "source.port": group(packet, 3),
            "destination.address": group(packet, 4),
            "destination.port": group(packet, 5),
            "network.io.direction": F.when(sent, "transmit").when(~sent, "receive"),
            r.ext("ipsec.packet.bytes"): group(packet, 6),
            r.ext("ipsec.child_sa"): child,
            r.ext("ipsec.child_sa.state"): state,
            r.ext("ipsec.spi.in"): spi_in,
            r.ext("ipsec.spi.out"): spi_out,
            r.ext("ipsec.traffic_selector"): F.when(digits(F.left(selector, F.lit(1))) & (F.translate(selector, "0123456789./ =", "") == ""), selector),
            r.ext("ipsec.proposal"): F.ltrim(behind(said, "selected proposal:")),
            r.ext("ipsec.delete.spi"): F.when(said.contains("DELETE for "), F.substring_index(behind(said, "CHILD_SA with SPI "), " ", 1)),
            r.ext("ipsec.auth.identity"): who,
            r.ext("ipsec.auth.result"): auth,
        },
    )


CHARON_BRANCH = Branch("charon", shape_charon, lambda r: needs(r.text, "[", "<"), cuts=charon_line, slots={"caps2": lambda r: packet(r.g(5)).read()})

# -- containerd

#: Stand for an escaped backslash and quote while a quoted text is looked for.
_BACKSLASH, _QUOTE = "\u0002", "\u0003"


def _hidden_escapes(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))


@marked('time="', '" level=', ' msg="', '"', of=_hidden_escapes)
def containerd_line(text: Column, head: Column, time: Column, level: Column, said: Column, more: Column) -> tuple[Column, list[Column]]:
    """logrus' TextFormatter: time, level, a quoted message with escapes, further pairs."""
    back = lambda c: F.replace(F.replace(c, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    return every(head == "", ~time.contains('"'), named(level)), [time, level, back(said), back(F.ltrim(more))]


def shape_containerd(r: Rec) -> Shape:
    msg = F.replace(F.replace(r.g(3), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    # Every id of 64 digits, and the word that stands before it and tells what it is of.
    kinds, ids = (F.regexp_extract_all(msg, F.lit('([A-Za-z]+)[ :="]+([0-9a-f]{64})'), i) for i in (1, 2))
    of = lambda *names: F.coalesce(*[F.get(ids, (F.nullif(F.array_position(kinds, w), F.lit(0)) - 1).cast("int")) for w in names])
    image = F.filter(F.regexp_extract_all(msg, F.lit('"([^" ]*)"'), 1), lambda x: x.rlike(r"^[A-Za-z0-9][\w.-]*(?:/[\w.-]+)+:[\w.-]+$"))
    member = lambda struct, key: before(behind(F.concat(F.lit(","), before(behind(msg, struct + "{"), "}"), F.lit(",")), f",{key}:"), ",")
    error = pairs.last_value(r.kv, "error")
    return Shape(
        body=F.when(error.isNotNull(), F.concat(msg, F.lit(": "), error)).otherwise(msg),
        level=levels.from_word(r.g(2)),
        ts_us=times.rfc3339_micros(r.g(1)),
        put={
            "container.id": F.coalesce(of("for", "shim", "container"), pairs.last_value(r.kv, "id")),
            r.ext("containerd.sandbox.id"): of("id", "sandbox"),
            "container.image.name": F.get(image, F.lit(0)),
            "k8s.pod.name": member("PodSandboxMetadata", "Name"),
            "k8s.pod.uid": member("PodSandboxMetadata", "Uid"),
            "k8s.namespace.name": member("PodSandboxMetadata", "Namespace"),
            "k8s.container.name": member("ContainerMetadata", "Name"),
            "exception.message": error,
            r.ext("containerd.namespace"): pairs.last_value(r.kv, "namespace"),
        },
    )


CONTAINERD_BRANCH = Branch("containerd", shape_containerd, lambda r: r.text.startswith('time="'), cuts=containerd_line, slots={"kv": lambda r: pairs.found(F.coalesce(r.g(4), F.lit("")))})

# -- cron


@marked("(", ") ")
def job(text: Column, head: Column, user: Column, rest: Column) -> tuple[Column, list[Column]]:
    """``(user) CMD (command)`` at the end of a line: a command begins; with CMDEND it has ended."""
    verb, command = before(rest, " "), behind(rest, "(")
    ok = every(user != "", verb.isin("CMD", "CMDEND"), F.ltrim(behind(rest, " ")).startswith("("), command.endswith(")"), F.length(command) > 1, ~command.contains("\n"))
    return F.coalesce(ok, F.lit(False)), [user, verb, until_last(command, ")")]


@marked("pam_unix(cron:session): session ", " for user ")
def session(text: Column, _: Column, verb: Column, user: Column) -> tuple[Column, list[Column]]:
    """PAM's ``session opened for user name``, and ``closed``."""
    name = before(before(user, " "), "(")
    return every(verb.isin("opened", "closed"), name != ""), [verb, name]


@marked("(", ") ")
def run_parts(text: Column, head: Column, folder: Column, said: Column) -> tuple[Column, list[Column]]:
    """``(/etc/cron.daily) starting name``, and ``finished``."""
    w = words(said)
    return every(head == "", folder.startswith("/etc/cron."), F.size(w) == 2, at(w, 0).isin("starting", "finished"), at(w, 1) != ""), [folder, at(w, 0), at(w, 1)]


def clean_command(command: Column) -> Column:
    """Without output redirection to nowhere at its end, and without the lock that it waits for."""
    bare = F.regexp_replace(command, r"(?:\s*(?:2>&1|>\s*/dev/null))+\s*$", "")
    locked = F.regexp_extract(bare, r"^(?:\S*/)?flock\s+(?:\S+\s+)*?\S+\.lock\s+(.+)$", 1)
    return F.coalesce(F.nullif(locked, F.lit("")), bare)


def shape_cron(r: Rec) -> Shape:
    mine, pam, part = ([F.get(c.read(), F.lit(i + 1)) for i in range(3)] for c in (job(r.text), session(r.text), run_parts(r.text)))
    ended = mine[1] == "CMDEND"
    command = F.coalesce(clean_command(mine[2]), part[2])
    event = F.when(ended | (part[1] == "finished"), "end").when(pam[0].isNotNull(), F.concat(F.lit("session_"), pam[0])).otherwise("start")
    body = F.coalesce(
        F.concat(part[2], F.lit(" "), part[1]), F.when(ended, F.concat(command, F.lit(" finished"))), command, F.concat(F.lit("session "), pam[0], F.lit(" for "), pam[1]),
    )
    return Shape(body=body, level=F.lit(levels.INFO), put={"user.name": F.coalesce(mine[0], pam[1]), r.ext("cron.command"): command, r.ext("cron.event"): event, r.ext("cron.directory"): part[0]})


CRON_LINE_BRANCH = Branch("cronlog", shape_cron, lambda r: r.text.contains("("), claim=lambda r: job(r.text).ok | session(r.text).ok | run_parts(r.text).ok)

# -- packet filter

_V4_TCP, _V6_TCP = {"sport": 20, "dport": 21, "flags": 23}, {"sport": 16, "dport": 17, "flags": 19}
#: Flag letters and their names.
TCP_FLAGS = {"S": "SYN", "A": "ACK", "F": "FIN", "R": "RST", "P": "PSH", "U": "URG", "E": "ECE", "C": "CWR"}


def flag_names(letters: Column) -> Column:
    """``SA`` as ``SYN,ACK``; unknown letters as they are."""
    name = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in TCP_FLAGS.items()], c)
    return F.nullif(F.array_join(F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), name), ","), F.lit(""))


def shape_filter(r: Rec) -> Shape:
    f = lambda i: F.nullif(F.get(r.caps, F.lit(i)), F.lit(""))
    v4 = f(8) == "4"
    proto = F.when(v4, f(16)).otherwise(f(12))
    ports = proto.isin("tcp", "udp")
    src, dst = F.when(v4, f(18)).otherwise(f(14)), F.when(v4, f(19)).otherwise(f(15))
    sport, dport = F.when(ports, F.when(v4, f(20)).otherwise(f(16))), F.when(ports, F.when(v4, f(21)).otherwise(f(17)))
    flags = F.when(proto == "tcp", flag_names(F.when(v4, f(23)).otherwise(f(19))))
    icmp = F.when(proto.isin("icmp", "ipv6-icmp"), F.when(v4, f(20)).otherwise(f(16)))
    end = lambda a, p: F.when(p.isNotNull(), F.concat(a, F.lit(":"), p)).otherwise(a)
    text = bodies.joined(f(6), F.when(f(7) == "out", "outbound").otherwise("inbound"), proto, end(src, sport), F.lit("->"), end(dst, dport), F.concat(F.lit("on "), f(4)))
    return Shape(
        body=text,
        level=F.when(f(6) == "block", levels.WARN).otherwise(levels.INFO),
        put={
            "source.address": src, "destination.address": dst, "source.port": sport, "destination.port": dport, "network.transport": proto, "network.type": F.when(v4, "ipv4").otherwise("ipv6"),
            "network.interface.name": f(4), r.ext("filter.action"): f(6), r.ext("filter.direction"): f(7), r.ext("filter.rule"): f(0), r.ext("filter.tracker"): f(3), r.ext("filter.reason"): f(5),
            r.ext("filter.length"): F.when(v4, f(17)).otherwise(f(13)), r.ext("filter.ttl"): F.when(v4, f(11)), r.ext("filter.tcp_flags"): flags, r.ext("filter.icmp_type"): icmp,
        },
    )


def _filter_fields(f: Column) -> Column:
    """Rule, interface, reason, action, direction and version of at least 18 fields are there."""
    return every(F.size(f) >= 18, digits(at(f, 0)), at(f, 4) != "", at(f, 5) != "", at(f, 6).isin("pass", "block", "reject", "match"), at(f, 7).isin("in", "out"), at(f, 8).isin("4", "6"))


FILTER_BRANCH = Branch(
    "filterlog", shape_filter, lambda r: needs(r.text, ","), slots={"caps": lambda r: F.split(r.text, ",")},
    claim=lambda r: network.let(F.split(r.text, ","), _filter_fields),
)

# -- Kafka, PgBouncer, Snuba, Snooze, Tekton


@marked("[", "] ", " ")
def kafka_line(text: Column, head: Column, time: Column, level: Column, said: Column) -> tuple[Column, list[Column]]:
    """log4j's ``[%d] %p %m (%c)``; the logger may be missing."""
    logger = F.rtrim(last(said, " ("), F.lit(")"))
    has = every(said.contains(" ("), said.endswith(")"), logger.rlike(r"^[\w.$]+$"))
    ok = every(head == "", like(time, f"{DATE} {CLOCK},000"), F.length(time) == 23, level.isin("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"))
    return ok, [time, level, F.ltrim(F.when(has, until_last(said, " (")).otherwise(said)), F.when(has, logger)]

KAFKA_BRANCH = Branch(
    "kafka",
    lambda r: Shape(body=r.g(3), level=levels.from_word(r.g(2)), ts_us=times.utc_micros(r.g(1), "yyyy-MM-dd HH:mm:ss,SSS"), scope=r.g(4), put={r.ext("kafka.component"): first(r.g(3), r"^\[([^\]=]+)[\]=]")}),
    lambda r: r.text.startswith("["), cuts=kafka_line,
)


@marked(" ", " ", " [", "] ", " ")
def pgbouncer_line(text: Column, day: Column, clock: Column, zone: Column, pid: Column, level: Column, said: Column) -> tuple[Column, list[Column]]:
    """``date time zone [pid] LEVEL message``."""
    ok = every(like(day, DATE), F.length(day) == 10, fraction(clock, f"{CLOCK}."), named(zone), digits(pid), level.isin("LOG", "DEBUG", "NOISE", "INFO", "WARNING", "ERROR", "FATAL"))
    return ok, [F.concat(day, F.lit(" "), clock), zone, pid, level, F.ltrim(said)]


def connection(said: Column) -> tuple[Column, list[Column]]:
    """Whether a message begins with ``side-0xnumber: database/user@address:port``, or its first part alone; side, database, user, address, port, message."""
    found, (side, db, user, addr, port, rest) = cut(said, ": ", "/", "@", ":", " ")
    full = every(found, named(db), named(user), F.translate(addr, "0123456789.", "") == "", addr != "", digits(port))
    is_side = side.startswith("C-0x") | side.startswith("S-0x")
    when = lambda c: F.when(is_side & full, c)
    return is_side, [F.when(is_side, side), when(db), when(user), when(addr), when(port), F.when(is_side, F.ltrim(F.when(full, rest).otherwise(behind(said, ": "))))]


def shape_pgbouncer(r: Rec) -> Shape:
    said = r.g(5)
    _, (side, db, user, addr, port, message) = connection(said)
    return Shape(
        body=F.coalesce(F.nullif(message, F.lit("")), said),
        level=F.when(r.g(4) == "LOG", levels.INFO).otherwise(levels.from_word(r.g(4))),
        ts_us=times.utc_micros(F.rpad(r.g(1), 26, "0"), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        put={
            "process.pid": r.g(3), "db.namespace": db, "user.name": user, "client.address": addr,
            "client.port": port, r.ext("pgbouncer.connection"): side, r.ext("pgbouncer.side"): F.when(side.startswith("C"), "client").when(side.startswith("S"), "server"),
        },
    )


PGBOUNCER_BRANCH = Branch("pgbouncer", shape_pgbouncer, lambda r: needs(r.text, "["), cuts=pgbouncer_line)

def python_line(text: Column) -> Cut:
    """The asctime of Python's logging, then the message."""
    said = F.substr(text, F.lit(24))
    return form(like(text, f"{DATE} {CLOCK},000") & said.startswith(" ") & (F.ltrim(said) != ""), [F.left(text, F.lit(23)), F.ltrim(said)])


def shape_snuba(r: Rec) -> Shape:
    is_json = r.text.startswith("{")
    return Shape(
        body=F.when(is_json, r.json2["message"]).otherwise(r.g(2)),
        level=F.when(is_json, levels.from_word(r.j("level"))).otherwise(levels.INFO),
        ts_us=F.when(is_json, times.rfc3339_micros(r.j("timestamp"))).otherwise(times.utc_micros(r.g(1), "yyyy-MM-dd HH:mm:ss,SSS")),
        more=maps.prefixed(r.json2, r.ext("snuba."), ("message",)),
        scope=r.j("target"),
    )


SNUBA_BRANCH = Branch(
    "snuba", shape_snuba, lambda r: r.text.rlike(r"^[{\d]"),
    slots={"caps": lambda r: python_line(r.text).read(), "json": lambda r: as_object(r.text), "json2": lambda r: F.from_json(r.j("fields"), "map<string,string>")},
    claim=lambda r: python_line(r.text).ok | (object_text(r.text) & (F.get_json_object(r.text, "$.fields.message") != "") & (F.get_json_object(r.text, "$.target") != "")),
)


@spaced(4, of=first_line)
def levelled_line(text: Column, w: Column) -> tuple[Column, list[Column]]:
    """Date, time and a level, which may stand in brackets and have a colon, then the message of one or more lines."""
    level = F.rtrim(F.ltrim(at(w, 2), F.lit("[")), F.lit("]:"))
    return every(F.size(w) == 4, level.isin("DEBUG", "INFO", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL")), [level, at(w, 3), more_lines(text)]


def snooze_branch(rules: Sequence[tuple[str, str]]) -> Branch:
    """rules: namespaces and containers whose lines begin with a level; only the first line is read, times stay."""
    place = lambda r: F.concat_ws("\u0001", r.r("k8s.namespace.name"), r.r("k8s.container.name"))
    return Branch(
        "snooze",
        lambda r: Shape(body=F.concat(r.g(2), F.coalesce(r.g(3), F.lit(""))), level=F.when(r.g(1) == "CRITICAL", levels.FATAL).otherwise(levels.from_word(r.g(1))), original=False),
        lambda r: place(r).isin([f"{a}\u0001{b}" for a, b in rules]),
        cuts=levelled_line,
    )


@marked("Event(v1.ObjectReference{", "}): type: '", "' reason: '", "'")
def tekton_event(text: Column, head: Column, subject: Column, kind: Column, reason: Column, note: Column) -> tuple[Column, list[Column]]:
    """What client-go logs of an event: the object, its type, reason and note."""
    return every(head == "", named(kind), named(reason)), [subject, kind, reason, F.ltrim(note)]


@marked(" ", " status is being set to &{", "{", "} ")
def tekton_run(text: Column, kind: Column, name: Column, condition: Column, time: Column, rest: Column) -> tuple[Column, list[Column]]:
    """``Kind name status is being set to &{type status severity {time} reason message}``: a condition as Go prints it."""
    c, said = words(condition), until_last(F.ltrim(rest), "}")
    ok = every(kind.isin("PipelineRun", "TaskRun"), solid(name), named(at(c, 0)), named(at(c, 1)), rest.endswith("}"), named(before(said, " ")))
    return ok, [kind, name, at(c, 0), at(c, 1), before(said, " "), F.coalesce(F.ltrim(behind(said, " ")), F.lit(""))]


#: How many tasks of a run have ended how, and the word that says so.
TASKS = {"completed": "Completed", "failed": "Failed", "cancelled": "Cancelled", "skipped": "Skipped"}


def shape_tekton(r: Rec) -> Shape:
    event = r.text.startswith("Event")
    at, run = r.caps, r.caps2
    of = lambda k: first(group(at, 1), rf'\b{k}:\\?"([^"\\]+)')
    tasks = lambda how: F.when(r.text.contains("Tasks Completed"), first(r.text, how + ":? *([0-9]+)"))
    note = F.trim(group(at, 4))
    kind, named = F.when(event, of("Kind")).otherwise(group(run, 1)), F.when(event, of("Name")).otherwise(group(run, 2))
    status, reason = group(run, 4), F.when(event, group(at, 3)).otherwise(group(run, 5))
    more = F.when(event, note).otherwise(F.trim(group(run, 6)))
    return Shape(
        body=F.concat(bodies.joined(kind, named), F.lit(": "), reason, F.coalesce(F.concat(F.lit(" - "), F.nullif(more, F.lit(""))), F.lit(""))),
        level=F.when(event & (group(at, 2) == "Warning"), levels.WARN).when(status == "False", levels.ERROR).otherwise(levels.INFO),
        put={
            r.ext("tekton.kind"): kind,
            r.ext("tekton.name"): named,
            "k8s.namespace.name": F.when(event, of("Namespace")),
            r.ext("tekton.uid"): F.when(event, of("UID")),
            r.ext("tekton.reason"): reason,
            r.ext("tekton.status"): status,
            **{r.ext(f"tekton.tasks.{k}"): tasks(how) for k, how in TASKS.items()},
        },
    )


TEKTON_BRANCH = Branch(
    "tekton", shape_tekton, lambda r: r.text.startswith("Event") | r.text.startswith("PipelineRun") | r.text.startswith("TaskRun"),
    slots={"caps": lambda r: tekton_event(r.text).read(), "caps2": lambda r: tekton_run(r.text).read()}, claim=lambda r: tekton_event(r.text).ok | tekton_run(r.text).ok,
)

# -- kernel


@marked("sd ", ": [", "] ")
def scsi_line(text: Column, head: Column, address: Column, device: Column, said: Column) -> tuple[Column, list[Column]]:
    """``sd host:channel:target:lun: [name] message``, the head of sd_printk()."""
    return every(head == "", F.size(F.split(address, ":")) == 4, digits(F.translate(address, ":", ""))), [address, device, F.ltrim(said)]


@marked("critical medium error, dev ", ", sector ", " ")
def medium_line(text: Column, head: Column, device: Column, sector: Column, _: Column) -> tuple[Column, list[Column]]:
    """``critical medium error, dev name, sector n ...``, as blk_print_req_error() has it."""
    return every(head == "", named(device), digits(sector)), [device, sector]


@marked("IPVS: ", ": ", " ", " - ")
def balancer_line(text: Column, head: Column, scheduler: Column, protocol: Column, target: Column, said: Column) -> tuple[Column, list[Column]]:
    """``IPVS: scheduler: PROTOCOL target - message``."""
    return every(head == "", named(scheduler), named(protocol), digits(F.translate(target, ".:", ""))), [scheduler, protocol, target, said]


@marked("net_ratelimit: ", " callbacks suppressed")
def limiter_line(text: Column, head: Column, n: Column, rest: Column) -> tuple[Column, list[Column]]:
    """``net_ratelimit: n callbacks suppressed``."""
    return every(head == "", rest == "", digits(n)), [n]


#: How network interfaces are named.
NICS = ("veth", "eth", "eno", "enp", "ens", "bond", "br", "cni", "tun", "tap", "wlan", "docker", "cali", "flannel")


@marked(": ")
def interface_line(text: Column, name: Column, said: Column) -> tuple[Column, list[Column]]:
    """An interface's name and a colon, then the message."""
    known = F.array_contains(F.array(*[name.startswith(n) for n in NICS]), True)
    return every(known, name.rlike(r"^[\w.-]+$")), [name, F.ltrim(said)]


def uptime(text: Column) -> Column:
    """The seconds since the start in brackets that a line begins with, null where it doesn't."""
    found, (head, secs, _) = cut(text, "[", "]")
    return F.when(every(found, head == "", digits(F.translate(F.trim(secs), ".", ""))), F.trim(secs))


def kernel_line(r: Rec) -> Column:
    """Without the uptime in front."""
    return F.trim(F.when(uptime(r.text).isNotNull(), behind(r.text, "]")).otherwise(r.text))


#: Words that tell an error or a warning.
KERNEL_ERRORS = ("critical", "medium error", "i/o error", "sense key : medium")
KERNEL_WARNINGS = ("no destination available", "callbacks suppressed", "link down", "link is down", "unstable", "warn")


def shape_kernel(r: Rec) -> Shape:
    t = r.line
    disk, medium, balancer, limiter, nic = ([F.get(c.read(), F.lit(i + 1)) for i in range(4)] for c in (scsi_line(t), medium_line(t), balancer_line(t), limiter_line(t), interface_line(t)))
    kinds = {k: p[0].isNotNull() for k, p in (("scsi", disk), ("block", medium), ("ipvs", balancer))} | {"clocksource": t.startswith("clocksource:")}
    system = F.lit("network")
    for kind, is_it in reversed(kinds.items()):
        system = F.when(is_it, kind).otherwise(system)
    low = F.lower(t)
    any_of = lambda words: F.array_contains(F.array(*[low.contains(w) for w in words]), True)
    return Shape(
        body=F.coalesce(disk[2], nic[1], t),
        level=F.when(any_of(KERNEL_ERRORS), levels.ERROR).when(any_of(KERNEL_WARNINGS), levels.WARN).otherwise(levels.INFO),
        put={
            r.ext("kernel.subsystem"): system,
            r.ext("kernel.uptime"): uptime(r.text),
            r.ext("kernel.device"): F.coalesce(disk[1], medium[0]),
            r.ext("scsi.address"): disk[0],
            r.ext("scsi.sense_key"): F.trim(before(F.ltrim(F.ltrim(behind(t, "Sense Key")), F.lit(": ")), "[")),
            r.ext("scsi.sense"): F.trim(behind(t, "Add. Sense: ")),
            r.ext("block.sector"): medium[1],
            r.ext("ipvs.scheduler"): balancer[0],
            "network.transport": F.lower(balancer[1]),
            "destination.address": balancer[2],
            "network.interface.name": nic[0],
            r.ext("kernel.suppressed"): limiter[0],
        },
    )


def _kernel(r: Rec) -> Column:
    t = kernel_line(r)
    out = t.startswith("clocksource:")
    for form in (scsi_line, medium_line, balancer_line, limiter_line, interface_line):
        out = out | F.coalesce(form(t).ok, F.lit(False))
    return out


KERNEL_BRANCH = Branch("kernel", shape_kernel, lambda r: F.length(r.text) > 3, slots={"line": kernel_line}, claim=_kernel)

# -- remote desktop server


@marked("[", "/", "]")
def vnc_line(text: Column, head: Column, pid: Column, thread: Column, rest: Column) -> tuple[Column, list[Column]]:
    """``[ process/ thread] date time:millis mark message``; the mark of an event may be missing, and a colon may stand before it."""
    line = F.ltrim(rest)
    behind_time = F.ltrim(F.substr(line, F.lit(24)))
    said = F.when(behind_time.startswith(":"), F.ltrim(F.substr(behind_time, F.lit(2)))).otherwise(behind_time)
    mark = F.when(F.substring(said, 1, 1).isin("+", "-", "!") & (F.substring(said, 2, 1) == " "), F.left(said, F.lit(1)))
    number = lambda c: digits(F.trim(c)) & (F.length(F.trim(c)) <= 18)
    ok = every(F.trim(head) == "", number(pid), number(thread), rest.startswith(" "), like(line, f"{DATE} {CLOCK}:000"), F.substring(line, 24, 1) == " ", ~text.contains("\n"))
    return ok, [F.trim(pid), F.trim(thread), F.left(line, F.lit(23)), mark, F.when(mark.isNotNull(), F.ltrim(F.substr(said, F.lit(2)))).otherwise(said)]


def shape_vnc(r: Rec) -> Shape:
    msg = F.regexp_replace(r.g(5), r"[ \t\r\n]+$", "")
    low, zone = F.lower(msg), r.options.get("time_zone", "UTC")
    error = msg.startswith("Exception") | low.contains("error") | low.contains("failed")
    event = F.when(low.contains("disconnect"), "disconnect").when(low.contains("authenticat"), "auth").when(low.contains("connection from") | low.contains("connected"), "connect").when(error, "error").when(r.g(4).isNotNull(), "lifecycle").otherwise("other")
    wall = F.regexp_replace(r.g(3), r":(\d{3})$", ".$1")
    utc = times.utc_micros(wall, "yyyy-MM-dd HH:mm:ss.SSS")
    # A wall time that a clock change skips does not come back from UTC as itself.
    local = F.to_utc_timestamp(F.timestamp_micros(utc), zone)
    back = F.from_utc_timestamp(local, zone)
    incoming = r"^Incoming rfb connection from (.*?)(?: to port (\d+))?$"
    started = r"^Rfb server started at (.*):(\d+)$"
    return Shape(
        body=msg,
        level=F.when(error, levels.ERROR).when(low.rlike("rejected|denied|refused|warning"), levels.WARN).otherwise(levels.INFO),
        ts_us=F.when(F.unix_micros(back) == utc, F.unix_micros(local)),
        put={
            "process.pid": r.g(1), "thread.id": r.g(2), r.ext("tightvnc.event"): event, "client.address": first(msg, incoming, 1), "server.port": F.coalesce(first(msg, incoming, 2), first(msg, started, 2)),
            r.ext("tightvnc.client.id"): first(msg, r"Client #(\d+)"), r.ext("tightvnc.view_only"): first(msg, r"^Authenticated with view-only password = (\d+)"), "server.address": first(msg, started, 1),
        },
        original=False,
    )


VNC_BRANCH = Branch("tightvnc", shape_vnc, lambda r: needs(r.text, "[", "/", "]"), cuts=vnc_line)

# -- Kubernetes events as objects


def shape_k8sevent(r: Rec) -> Shape:
    o = r.json
    about = r.json2
    kind, name, ns = about["kind"], about["name"], about["namespace"]
    subject = F.when((kind != "") & (name != ""), F.concat(kind, F.lit(" "), F.coalesce(F.concat(F.nullif(ns, F.lit("")), F.lit("/")), F.lit("")), name))
    note = first_of(o["note"], o["message"])
    text = F.coalesce(F.concat(subject, F.lit(": "), o["reason"]), subject, o["reason"])
    source = F.coalesce(F.get_json_object(o["deprecatedSource"], "$.component"), F.get_json_object(o["source"], "$.component"))
    return Shape(
        body=F.coalesce(F.concat(text, F.lit(" - "), note), text, note),
        level=F.when(o["type"] == "Warning", levels.WARN).otherwise(levels.INFO),
        put={
            "k8s.event.type": o["type"], "k8s.event.reason": o["reason"], "k8s.event.regarding.kind": kind, "k8s.event.regarding.name": name, "k8s.event.regarding.namespace": ns, "k8s.event.source": source,
            "k8s.event.note": note,
        },
        original=False,
    )


def _event_object(r: Rec) -> Column:
    """The object at structured.object, object, or the top."""
    inner = F.coalesce(F.get_json_object(r.text, "$.structured.object"), F.get_json_object(r.text, "$.object"))
    return as_object(F.coalesce(inner, r.text))


K8S_EVENT_BRANCH = Branch(
    "k8sevent", shape_k8sevent, lambda r: object_text(r.text) & r.text.rlike('"(?:regarding|involvedObject|reason)"'),
    slots={"json": _event_object, "json2": lambda r: F.from_json(F.coalesce(r.j("regarding"), r.j("involvedObject")), "map<string,string>")},
    claim=lambda r: _event_object(r)["reason"].isNotNull(),
)

PARSERS: dict[str, Branch] = {b.name: b for b in (
    CHARON_BRANCH, CONTAINERD_BRANCH, CRON_LINE_BRANCH, FILTER_BRANCH, KAFKA_BRANCH, PGBOUNCER_BRANCH, SNUBA_BRANCH, TEKTON_BRANCH, KERNEL_BRANCH, VNC_BRANCH, K8S_EVENT_BRANCH,
)}


def parse(df: DataFrame, *names: str, options: dict | None = None, more: Sequence[Branch] = ()) -> DataFrame:
    """``df`` with the lines of these formats parsed, the first that claims a line; see logshape() for columns and options."""
    chosen = [PARSERS.get(n) or BY_NAME[n] for n in names] + list(more)
    return flatten(shaped(df, chosen, options))


# -- Windows events

FAILURE_KEYWORD = 0x10000000000000
LEVELS = {1: levels.FATAL, 2: levels.ERROR, 3: levels.WARN, 4: levels.INFO, 0: levels.INFO, 5: levels.DEBUG}


def event_level(level: Column, keywords: Column) -> Column:
    """An audit failure is WARN; else by the event's own level."""
    out = F.lit(None).cast("int")
    for k, v in LEVELS.items():
        out = F.when(level == k, v).otherwise(out)
    failed = F.coalesce(F.exists(keywords, lambda k: F.lower(k) == "audit failure"), F.lit(False))
    return F.when(failed, levels.WARN).otherwise(out)


def windows_events(df: DataFrame, templates: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """Windows events (channel, provider, event_id, level, keywords, computer, message, event_data map) as log records.

    The body is the first line of the message, or the template of (provider,
    id) with ``{Field}`` filled from the event's data (an empty text for a
    missing one), or ``<provider> event <id> key=value ...`` in order of keys.
    """
    data = F.col("event_data")
    pairs_text = F.array_join(F.transform(F.array_sort(F.map_entries(data)), lambda e: F.concat(e.key, F.lit("="), e.value)), " ")
    fallback = bodies.joined(F.concat(F.col("provider"), F.lit(" event")), F.col("event_id").cast("string"), pairs_text)
    body = F.coalesce(F.nullif(F.trim(F.substring_index("message", "\n", 1)), F.lit("")), fallback)
    for (provider, event), template in (templates or {}).items():
        cells = [F.coalesce(data[p[1:-1]], F.lit("")) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{[^}]*\})", template) if p]
        body = F.when((F.col("provider") == provider) & (F.col("event_id") == event), F.concat(*cells)).otherwise(body)
    number = event_level(F.col("level"), F.col("keywords"))
    service = F.lower(F.regexp_replace(F.regexp_replace("provider", "^Microsoft-Windows-", ""), r"\s+", "-"))
    return df.withColumns({
        "body": body, "severity_number": number, "severity_text": levels.text(number),
        "resource": maps.of({"host.name": F.col("computer"), "service.name": service}),
        "attributes": maps.merge(maps.of({"log.source": F.lit("windows"), "winlog.channel": F.col("channel"), "winlog.provider": F.col("provider"), "winlog.event_id": F.col("event_id")}), F.coalesce(maps.prefixed(data, "winlog.event_data."), maps.empty())),
    })
