"""Branches of network devices and of syslog, whose inner line is shaped again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions import levels, network, times
from lumenloom.functions.cuts import CLOCK, DATE, MONTHS, at, before, behind, cut, digits, every, like, marked, named, solid, spaced, words
from lumenloom.functions.maps import lookup
from lumenloom.functions.patterns import captures, first, group
from lumenloom.operators.logshape.core import Branch, Rec, Shape, begins
from lumenloom.operators.logshape.lines import as_int

# -- Cisco, HP switches, wireless controllers, access points


def codes(text: Column) -> Column:
    """Facility, severity and mnemonic of each ``%FACILITY-SEVERITY-MNEMONIC:`` of a text, as vendors' message guides have them."""
    marked = F.filter(F.slice(F.split(text, "%"), 2, 1 << 20), lambda x: x.contains(":"))
    parts = F.transform(marked, lambda x: F.split(before(x, ":"), "-"))
    name = lambda c: named(c) & (F.upper(c) == c)
    return F.filter(parts, lambda c: (F.size(c) == 3) & name(at(c, 0)) & ~digits(F.left(at(c, 0), F.lit(1))) & (F.length(at(c, 1)) == 1) & at(c, 1).isin(*DIGITS) & name(at(c, 2)))


def coded(text: Column) -> Column:
    """The first code's parts from place 1 on; null where there is none."""
    found = codes(text)
    return F.when(text.contains("%") & (F.size(found) > 0), F.concat(F.array(F.lit("")), at(found, 0)))


@marked("[", "]")
def access_point(text: Column, head: Column, time: Column, said: Column) -> tuple[Column, list[Column]]:
    """``[*MM/dd/yyyy hh:mm:ss.ffff] message``; the mark of an unset clock may be missing."""
    clock = F.ltrim(time, F.lit("*"))
    form = f"00/00/0000 {CLOCK}"
    return every(head == "", like(clock, form), F.translate(F.substr(clock, F.lit(len(form) + 1)), ".0123456789", "") == "", ~text.contains("\n")), [F.ltrim(said)]


def syslog_stamp(w: Column) -> Column:
    """The words begin with month, day and clock, as RFC 3164 has them in section 4.1.2."""
    return every(at(w, 0).isin(*MONTHS), digits(at(w, 1)), F.length(at(w, 1)) <= 2, like(at(w, 2), CLOCK))


def source_file(place: Column) -> Column:
    """``name.c`` or ``name.h``."""
    return place.endswith(".c") | place.endswith(".h")


@spaced(5, of=F.ltrim)
def switch_line(text: Column, w: Column) -> tuple[Column, list[Column]]:
    """A switch's line behind a blank: time, host, component[task]:, perhaps file(line) and a sequence number, ``%%`` and the message."""
    found, (component, task, place, said) = cut(at(w, 4), "[", "]:", "%%")
    f = words(F.trim(place))
    file, number = before(at(f, 0), "("), F.rtrim(behind(at(f, 0), "("), F.lit(")"))
    has = every(source_file(file), digits(number), digits(at(f, 1)))
    ok = every(text.startswith(" "), syslog_stamp(w), F.length(at(w, 2)) == 8, found, component != "", ~text.contains("\n"))
    when = lambda c: F.when(has, c)
    return ok, [F.concat_ws(" ", at(w, 0), at(w, 1), at(w, 2)), at(w, 3), component, task, when(file), when(number), when(at(f, 1)), F.ltrim(said)]


@marked(": *", ": ", ": %", ":")
def controller_line(text: Column, point: Column, task: Column, time: Column, code: Column, said: Column) -> tuple[Column, list[Column]]:
    """A controller's line: access point, ``*task``, time, code, perhaps file:line, message."""
    w = words(F.ltrim(said), 2)
    file, number = before(at(w, 0), ":"), behind(at(w, 0), ":")
    has = F.coalesce(source_file(file) & digits(number), F.lit(False))
    ok = every(point != "", ~point.contains(":"), task != "", syslog_stamp(words(time)), F.size(F.split(code, "-")) == 3, ~text.contains("\n"))
    return ok, [point, task, F.when(has, file), F.when(has, number), F.when(has, at(w, 1)).otherwise(F.ltrim(said))]


ROUTINE = ("pmkr0 lookup", "client roamed")
#: Levels of mnemonics that differ from their own digit.
WARN_MNEMONICS = (
    "UPDOWN", "CHANGED", "PORTSTATUS", "LINK_DOWN", "LINK_UP", "TOPOLOGY_CHANGE", "TOPOLOGY_CHANGE_RCVD", "TOPOTRAP", "ROOT_BRIDGE_CHANGE", "BLOCK", "UNBLOCK",
    "PORT_ROLE", "PORT_STATE", "SPANTREE_PORT_STATE", "FWD_CHANGE", "LEARN_CHANGE", "LISTENING_TO_FORWARDING", "MACFLAP_NOTIF", "MAC_FLAP", "CLIENT_DEAUTH", "POE_OVERLOAD",
)
INFO_MNEMONICS = ("CLIENT_ASSOCIATE", "CLIENT_DISASSOCIATE", "POE_ALLOCATED", "POE_REMOVED")
DIGITS = {"0": 24, "1": 21, "2": 18, "3": 17, "E": 17, "4": 13, "W": 13, "5": 10, "N": 10, "6": 9, "I": 9, "7": 5, "D": 5}
#: Names of interfaces with slots and ports, and of those with a number; the first that is found wins.
SLOTTED = ("HundredGigabitEthernet", "FortyGigabitEthernet", "TenGigabitEthernet", "GigabitEthernet", "FastEthernet", "Hu", "Fo", "Te", "Gi", "Fa")
NUMBERED = ("gi", "fa", "te", "Vlan", "Port-channel", "Loopback", "Tunnel")
#: What a controller says of a client, label by label.
CLIENT_LABELS = ("Client MAC", "AP Name", "Radio", "WLAN Id")


def source_line(rec: Rec) -> Column:
    return F.coalesce(rec.a(rec.options.get("cisco_source", "log.record.original")), rec.text)


def interface(source: Column) -> Column:
    """The interface that a message names; a name is looked for by its pattern only where it stands at all."""
    found = [(n, rf"\b({n}\d+(?:/\d+)+)") for n in SLOTTED] + [(n, rf"\b({n}\d+)\b") for n in NUMBERED]
    return F.coalesce(*[F.when(source.contains(n), first(source, p)) for n, p in found])


def mnemonic_level(rec: Rec, mnemonic: Column, digit: Column) -> Column:
    unset = F.coalesce(rec.severity, F.lit(0)) == 0
    return F.when(mnemonic.isin(*WARN_MNEMONICS), levels.WARN).when(mnemonic.isin(*INFO_MNEMONICS), levels.INFO).when(unset, lookup(digit, DIGITS))


def client_label(message: Column, label: str) -> Column:
    """What stands behind a label, up to the next comma."""
    return F.nullif(F.rtrim(F.ltrim(F.regexp_extract(message, label + ":([^,]*)", 1)), F.lit(" .")), F.lit(""))


def without_labels(message: Column) -> Column:
    """The clauses of a message, each up to a client's label; clauses that are nothing else are left out."""
    own = F.transform(F.split(message, ","), lambda c: F.trim(F.regexp_replace(c, f"(?:{'|'.join(CLIENT_LABELS)}):.*$", ""), F.lit(" .:")))
    return F.nullif(F.array_join(F.filter(own, lambda c: c != ""), ", "), F.lit(""))


def shape_cisco(rec: Rec) -> Shape:
    code, ap_line, src = rec.caps2, rec.caps3, rec.line
    is_ap = ap_line.isNotNull()
    ap = group(ap_line, 1)
    marked = F.coalesce(rec.a(rec.ext("cisco.facility")), rec.a("cisco_facility"))
    facility = F.coalesce(marked, group(code, 1))
    mnemonic = F.coalesce(rec.a(rec.ext("cisco.mnemonic")), rec.a("cisco_mnemonic"), group(code, 3))
    digit = F.coalesce(rec.a(rec.ext("cisco.severity")), rec.a("cisco_severity"), group(code, 2))
    is_hp = ~is_ap & facility.isNull()
    is_wlc = ~is_ap & marked.isNull() & facility.isNotNull() & F.coalesce(F.size(rec.caps) == 6, F.lit(False))
    # Groups are those of a controller's line or of a switch's, whichever the line is.
    wlc = lambda i: F.when(is_wlc, rec.g(i))
    hp = lambda i: F.when(is_hp & (F.size(rec.caps) == 9), rec.g(i))
    label = lambda k: F.when(is_wlc, client_label(rec.g(5), k))
    lower = F.lower(ap)
    routine = F.lit(False)
    for part in rec.options.get("access_point_downgrade") or ROUTINE:
        routine = routine | lower.contains(part.lower())
    other = ~is_ap & ~is_hp
    unprefixed = F.regexp_replace(rec.text, r"^<\d+>\s*", "")
    return Shape(
        body=F.when(is_ap, ap).when(is_wlc, F.coalesce(without_labels(rec.g(5)), unprefixed)).when(is_hp, F.coalesce(hp(8), unprefixed)).otherwise(unprefixed),
        level=F.when(is_ap & (rec.severity == levels.WARN) & routine, levels.INFO).when(other, mnemonic_level(rec, mnemonic, digit)),
        put={
            rec.ext("cisco.facility"): F.when(other, facility),
            rec.ext("cisco.mnemonic"): F.when(other, mnemonic),
            rec.ext("cisco.severity"): F.when(other, digit),
            "network.interface.name": F.when(other & ~is_wlc, interface(src)),
            "thread.name": F.coalesce(wlc(2), hp(4)),
            "code.file.path": F.coalesce(wlc(3), hp(5)),
            "code.line.number": F.coalesce(wlc(4), hp(6)),
            rec.ext("cisco.sequence"): hp(7),
            rec.ext("wifi.ap.name"): wlc(1),
            rec.ext("wifi.client.ap"): label("AP Name"),
            rec.ext("wifi.radio"): label("Radio"),
            rec.ext("wifi.wlan.id"): label("WLAN Id"),
        },
        drop=("cisco_facility", "cisco_mnemonic", "cisco_severity"),
        resource_fill={
            "host.name": F.when(is_hp, hp(2)).when(~is_ap, rec.a("net.peer.name")),
            "service.name": F.when(is_hp, F.trim(hp(3))).when(other & marked.isNull(), facility),
        },
    )


def _switch(source: Column) -> Column:
    return F.coalesce(source.startswith(" ") & source.contains("%%") & switch_line(source).ok, F.lit(False))


CISCO_BRANCH = Branch(
    "cisco", shape_cisco,
    slots={
        "line": source_line,
        "caps": lambda r: F.when(r.line.startswith(" "), switch_line(r.line).read()).when(r.line.contains(": *"), controller_line(r.line).read()),
        "caps2": lambda r: coded(r.line),
        "caps3": lambda r: access_point(r.text).read(),
    },
    gate=lambda r: r.text.contains("%") | begins(r.text, "[") | r.has(r.ext("cisco.facility"), "cisco_facility", r.options.get("cisco_source", "log.record.original")),
    claim=lambda r: r.has(r.ext("cisco.facility"), "cisco_facility") | F.coalesce(access_point(r.text).ok, F.lit(False)) | F.coalesce(coded(source_line(r)).isNotNull(), F.lit(False)) | _switch(source_line(r)),
)

# -- syslog

#: RFC 5424, section 6: version, time, host, application, process, message id, structured data, message. The standard leaves one reading.
RFC5424 = r"^(\d+) +(\S+) +(\S+) +(\S+) +(\S+) +(\S+) +(-|(?:\[(?:[^\"\]]|\"(?:[^\"\\]|\\.)*\")*\])+) *((?s:.*))$"


def is_new(text: Column) -> Column:
    """A version, then a date with a T."""
    w = words(text, 3)
    return digits(at(w, 0)) & F.coalesce(like(at(w, 1), f"{DATE}T"), F.lit(False))


@spaced(4)
def old_line(text: Column, w: Column) -> tuple[Column, list[Column]]:
    """RFC 3164, section 4.1: time, then host or tag, and the message."""
    return syslog_stamp(w) & (F.size(w) == 4) & (F.length(at(w, 2)) == 8) & (at(w, 3) != ""), [F.concat_ws(" ", at(w, 0), at(w, 1), at(w, 2)), at(w, 3)]


@marked(": ", ": %", ":")
def ios_line(text: Column, number: Column, time: Column, code: Column, said: Column) -> tuple[Column, list[Column]]:
    """``sequence: *time: %FACILITY-severity-MNEMONIC: message`` of network devices; the mark of an unset clock may be missing."""
    c = F.split(code, "-")
    ok = every(digits(number), syslog_stamp(words(F.ltrim(time, F.lit("*")))), F.size(c) == 3, F.length(at(c, 1)) == 1, digits(at(c, 1)))
    return F.coalesce(ok, F.lit(False)), [number, time, at(c, 0), at(c, 1), at(c, 2), F.ltrim(said)]


@marked(":")
def tagged(text: Column, tag: Column, said: Column) -> tuple[Column, list[Column]]:
    """``tag[process]: message``; the process may be missing."""
    app, pid = before(tag, "["), F.rtrim(behind(tag, "["), F.lit("]"))
    return F.coalesce(every(solid(tag), app != "", ~tag.contains("\n"), (app == tag) | (digits(pid) & tag.endswith("]"))), F.lit(False)), [app, pid, F.ltrim(said)]


def wrapped(rec: Rec) -> Column:
    return F.trim(F.coalesce(rec.a(rec.options.get("syslog_source", "message")), rec.text))


def _groups(rec: Rec) -> Column:
    """Groups of the line's own form, tried in this order."""
    ios, old = ios_line(rec.line), old_line(rec.line)
    return F.when(is_new(rec.line), captures(rec.line, RFC5424)).when(ios.ok, ios.array).when(old.ok, old.array).otherwise(F.array(rec.line))


def _unwrapped(text: Column) -> Column:
    """The text begins with a time as one of the forms has it."""
    return F.coalesce(is_new(text) | syslog_stamp(words(text, 4)) | ios_line(text).ok, F.lit(False))


def _is_old(rec: Rec) -> Column:
    return F.size(rec.caps) == 3


def _no_host(rec: Rec) -> Column:
    """The old form's first token is a tag and not a host."""
    token = F.regexp_extract(rec.g(2), r"^(\S*)", 1)
    return token.endswith(":") & ~network.is_address(token) & ~network.is_address(F.regexp_replace(token, ":$", ""))


def _tag(rec: Rec) -> Column:
    text = F.when(_no_host(rec), rec.g(2)).otherwise(F.regexp_extract(rec.g(2), r"(?s)^\S*\s+(.*)$", 1))
    return F.when(_is_old(rec), F.coalesce(tagged(text).read(), F.array(F.lit(""), F.lit(""), F.lit(""), text)))


def syslog_parts(rec: Rec) -> dict[str, Column]:
    """host, missing, app, pid, content, time and the device fields of the line, content null where it can't be read."""
    is_new, is_ios, is_old = F.size(rec.caps) == 9, F.size(rec.caps) == 7, _is_old(rec)
    no = lambda c: F.nullif(c, F.lit("-"))
    missing = F.coalesce(is_old & _no_host(rec), F.lit(False))
    token = F.regexp_extract(rec.g(2), r"^(\S*)", 1)
    bare = F.regexp_replace(token, ":$", "")
    host = F.when(~missing, F.when(network.is_address(bare), bare).otherwise(token))
    return {
        "host": F.when(is_new, no(rec.g(3))).when(is_old, F.coalesce(no(rec.g3(3)), host)),
        "missing": missing,
        "app": F.when(is_new, no(rec.g(4))).when(is_old, F.coalesce(no(rec.g3(4)), rec.g2(1))),
        "pid": F.when(is_new, no(rec.g(5))).when(is_old, F.coalesce(no(rec.g3(5)), rec.g2(2))),
        "content": F.when(is_new, rec.g(8)).when(is_ios, rec.g(6)).when(is_old, F.coalesce(rec.g3(8), rec.g2(3))),
        "ts_us": F.when(is_new, times.rfc3339_micros(rec.g(2))),
        "facility": F.when(is_ios, rec.g(3)),
        "mnemonic": F.when(is_ios, rec.g(5)),
        "sequence": F.when(is_ios, rec.g(1)),
    }


def shape_syslog(rec: Rec) -> Shape:
    p = syslog_parts(rec)
    own = rec.a(rec.options.get("syslog_source", "message")).isNull()
    peer = F.coalesce(rec.a("net.peer.name"), rec.r("net.peer.name"))
    return Shape(
        body=p["content"],
        level=levels.from_priority(rec.attributes["priority"]),
        ts_us=F.coalesce(rec.ts_us, p["ts_us"]),
        put={
            "process.pid": as_int(p["pid"]),
            "log.source": F.lit("syslog"),
            "source.address": rec.a("net.peer.ip"),
            rec.ext("syslog.parse_error"): F.when(own, "true"),
            rec.ext("cisco.facility"): p["facility"],
            rec.ext("cisco.mnemonic"): p["mnemonic"],
            rec.ext("cisco.sequence"): p["sequence"],
        },
        fill={"log.record.original": F.nullif(rec.line, F.lit(""))},
        resource={"host.name": F.coalesce(p["host"], F.when(p["missing"], peer)), "service.name": p["app"]},
        original=False,
    )


SYSLOG_BRANCH = Branch(
    "syslog", shape_syslog, slots={"line": wrapped, "caps": _groups, "caps2": _tag, "caps3": lambda r: captures(r.g2(3), RFC5424)}, gate=lambda r: r.has(r.options.get("syslog_source", "message"), "priority") | (F.length(r.text) >= 13),
    claim=lambda r: F.coalesce(r.a(r.options.get("syslog_source", "message")).isNotNull(), F.lit(False)) | r.has("priority")
    | _unwrapped(F.trim(r.text)),
)

