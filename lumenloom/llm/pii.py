"""Personal data replaced by keyed pseudonyms of the same format.

Numbers are validated where their kind allows it (check digits, ranges, a real
calendar day) and then permuted by a keyed Feistel network within the values of
that format, so the pseudonym passes the same tests as the original, equal values
have equal pseudonyms in all documents, and the holder of the key can undo it.
An address stays in its special block (private, loopback, multicast, ...) or
outside of all; a North American telephone number keeps valid area and exchange
codes. Of other telephone numbers only the country code and the form stay.
"""

from __future__ import annotations

import datetime as dt
import functools
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 10


class Feistel:
    """A keyed permutation of the numbers below ``size``, for each kind of value."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _value(self, kind: str, r: int, x: int) -> int:
        return int.from_bytes(blake2b(f"{kind}|{r}|{x}".encode(), key=self.key, digest_size=64).digest(), "big")

    def permute(self, kind: str, x: int, size: int, back: bool = False) -> int:
        """x's pseudonym, or with ``back`` the number whose pseudonym x is.

        Alternating modular Feistel rounds over a * b >= size; results outside
        of the range go round again, which keeps it a permutation.
        """
        if size < 2:
            return x
        b = math.isqrt(size - 1) + 1
        a = -(-size // b)
        kind = f"{kind}|{size}"
        while True:
            hi, lo = divmod(x, b)
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if r % 2:
                    v = self._value(kind, r, hi)
                    lo = (lo - v if back else lo + v) % b
                else:
                    v = self._value(kind, r, lo)
                    hi = (hi - v if back else hi + v) % a
            x = hi * b + lo
            if x < size:
                return x


def luhn(digits: str) -> int:
    """The sum whose last digit is 0 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total


def iban_rest(compact: str) -> int:
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _fill(shape: str, symbols: str, place: Callable[[str], bool]) -> str:
    """``shape`` with the characters that ``place`` picks replaced by those of ``symbols`` in turn."""
    it = iter(symbols)
    return "".join(next(it) if place(c) else c for c in shape)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def _number(f: Feistel, kind: str, digits: str, back: bool) -> str:
    return str(f.permute(f"{kind}{len(digits)}", int(digits), 10 ** len(digits), back)).zfill(len(digits)) if digits else ""


def _in_alphabet(f: Feistel, kind: str, text: str, alphabet: str, back: bool) -> str:
    base, x = len(alphabet), 0
    for c in text:
        x = x * base + alphabet.index(c)
    y, out = f.permute(f"{kind}{len(text)}", x, base ** len(text), back), []
    for _ in text:
        y, r = divmod(y, base)
        out.append(alphabet[r])
    return "".join(reversed(out))


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


#: Characters that are permuted together; a longer value is cut into such parts.
_PART = 64


def _classes(f: Feistel, kind: str, text: str, back: bool) -> str:
    """Letters and digits permuted together, each place within its own class."""
    if len(text) > _PART:
        return "".join(_classes(f, f"{kind}{i}", text[i : i + _PART], back) for i in range(0, len(text), _PART))
    places = [next((a for a in (_LOWER, _UPPER, _DIGIT) if c in a), "") for c in text]
    x, size = 0, 1
    for c, a in zip(text, places):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join("a" if a is _LOWER else "A" if a is _UPPER else "0" if a else c for c, a in zip(text, places))
    y, out = f.permute(f"{kind}{shape}", x, size, back), []
    for c, a in zip(reversed(text), reversed(places)):
        if a:
            y, r = divmod(y, len(a))
            out.append(a[r])
        else:
            out.append(c)
    return "".join(reversed(out))


def email(f: Feistel, s: str, back: bool = False) -> str | None:
    local, _, domain = s.partition("@")
    labels = domain.split(".")
    if len(local) > 64 or len(domain) > 253 or any(not x or x[0] == "-" or x[-1] == "-" for x in labels) or local[0] == "." or local[-1] == "." or ".." in local:
        return None
    return f"{_classes(f, 'email', local, back)}@{domain}"


def secret(f: Feistel, s: str, back: bool = False) -> str | None:
    """Keys that their first characters tell; these stay."""
    n = 4 if s[:4] in ("AKIA", "ASIA", "ghp_", "gho_", "ghs_") else 3 if s[:3] == "sk-" else 5
    return s[:n] + (_in_alphabet(f, "aws", s[n:], _UPPER + _DIGIT, back) if s[:4] in ("AKIA", "ASIA") else _classes(f, "secret", s[n:], back))


def assigned(f: Feistel, s: str, back: bool = False) -> str | None:
    """A quoted value that a name like token or password is set to; one of another kind has that kind's pseudonym."""
    for kind, pattern in _ALONE.items():
        if kind != "assigned" and pattern.fullmatch(s) and (new := _MAKE[kind](f, s, back)) is not None:
            return new
    return _classes(f, "assigned", s, back)


def iban(f: Feistel, s: str, back: bool = False) -> str | None:
    compact = s.replace(" ", "")
    if not 15 <= len(compact) <= 34 or iban_rest(compact) != 1:
        return None
    account = _classes(f, f"iban{compact[:2]}", compact[4:], back)
    check = 98 - iban_rest(compact[:2] + "00" + account)
    return _fill(s, f"{compact[:2]}{check:02d}{account}", lambda c: c != " ")


def card(f: Feistel, s: str, back: bool = False) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn(d) % 10 or len(set(d)) == 1:
        return None
    body = d[0] + _number(f, f"card{d[0]}", d[1:-1], back)
    check = -luhn(body + "0") % 10
    return _fill(s, f"{body}{check}", _is_digit)


def ssn(f: Feistel, s: str, back: bool = False) -> str | None:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    y = f.permute("ssn", x, 898 * 99 * 9999, back)
    y, serial = divmod(y, 9999)
    area, group = divmod(y, 99)
    area += 1
    return f"{area + (area >= 666):03d}{s[3]}{group + 1:02d}{s[6]}{serial + 1:04d}"


def _american(f: Feistel, d: str, back: bool) -> str:
    """Ten digits; neither area nor exchange begins with 0 or 1 in those that can be dialled, and both kinds keep to themselves."""
    if d[0] > "1" and d[3] > "1":
        x = ((int(d[0]) - 2) * 8 + int(d[3]) - 2) * 10**8 + int(d[1:3] + d[4:])
        head, rest = divmod(f.permute("phone+1", x, 64 * 10**8, back), 10**8)
        rest = f"{rest:08d}"
        return f"{head // 8 + 2}{rest[:2]}{head % 8 + 2}{rest[2:]}"
    while True:  # the numbers between are those of the other kind
        d = _number(f, "phone-", d, back)
        if not (d[0] > "1" and d[3] > "1"):
            return d


def phone(f: Feistel, s: str, back: bool = False) -> str | None:
    """The country code stays; the rest is permuted."""
    d = _digits(s)
    if not 10 <= len(d) <= 15:
        return None
    head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+1|1(?=[ .-])|", s)[0]
    rest = _digits(s[len(head) :])
    new = _american(f, rest, back) if head in ("", "1", "+1") and len(rest) == 10 else _number(f, f"phone{head}", rest, back)
    return head + _fill(s[len(head) :], new, _is_digit)


#: Blocks of addresses with a meaning of their own.
BLOCKS = [
    ipaddress.ip_network(b)
    for b in (
        "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
        "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    )
]


def _block(x: int) -> tuple[int, int] | None:
    """First address and size of the special block that x is in."""
    return next(((int(b.network_address), b.num_addresses) for b in BLOCKS if ipaddress.IPv4Address(x) in b), None)


def ip(f: Feistel, s: str, back: bool = False) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    block = _block(x)
    if block:
        x = block[0] + f.permute(f"ip{block[0]}", x - block[0], block[1], back)
    else:
        x = f.permute("ip", x, 1 << 32, back)
        while _block(x):
            x = f.permute("ip", x, 1 << 32, back)
    return ".".join(map(str, x.to_bytes(4, "big")))


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def date(f: Feistel, s: str, back: bool = False) -> str | None:
    """Days from 1900 to 2099, year first, or last after day and month (month and day, if only that is a day).

    Dates with a day or month of one digit keep to themselves, and are written without zeros.
    """
    sep = re.search(r"[-/.]", s)[0]
    parts = s.split(sep)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    short = len(parts[0]) == 1 or len(parts[1]) == 1
    for order in orders:
        try:
            day = dt.date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        if not _FIRST <= day.toordinal() <= _LAST:
            continue
        # A day above 12 shows its order; the pseudonym must be read in the same order, so each order has its own days.
        mine = _days(order != (2, 0, 1), len(parts[0]) == 4, short)
        if day.toordinal() not in mine[1]:
            continue
        new = dt.date.fromordinal(mine[0][f.permute(f"date{order}{'short' * short}", mine[1][day.toordinal()], len(mine[0]), back)])
        out = list(parts)
        for i, n in zip(order, (new.year, new.month, new.day)):
            out[i] = str(n) if short else str(n).zfill(len(parts[i]))
        return sep.join(out)
    return None


@functools.cache
def _days(day_first: bool, year_first: bool, short: bool = False) -> tuple[list[int], dict[int, int]]:
    days = [d for d in range(_FIRST, _LAST + 1) if year_first or day_first or dt.date.fromordinal(d).day > 12]
    if short:
        days = [d for d in days if min(dt.date.fromordinal(d).day, dt.date.fromordinal(d).month) < 10]
    return days, {d: i for i, d in enumerate(days)}


_N, _E = r"(?<![0-9A-Za-z_.+-])", r"(?![0-9A-Za-z_])"
#: A named group per kind; earlier ones win at the same place.
PARTS = {
    "email": r"(?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-]))",
    "secret": r"(?P<secret>(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pos]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[bp]-[A-Za-z0-9-]{10,})(?![0-9A-Za-z]))",
    "assigned": r"(?i:(?<![A-Za-z])(?:token|secret|passwd|password|api[ _-]?key|access[ _-]?key)[\"']?[ \t]*[:=][ \t]*)(?P<q>[\"'])(?P<assigned>[^\"'\s]+)(?P=q)",
    "iban": r"(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))",
    "card": _N + r"(?P<card>[0-9]{13,19}|[0-9]{4}(?P<s0>[ -])[0-9]{4}(?P=s0)[0-9]{4}(?P=s0)[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\.?[0-9])" + _E,
    "ssn": _N + r"(?<![0-9] )(?P<ssn>[0-9]{3}(?P<s4>[ -])[0-9]{2}(?P=s4)[0-9]{4})(?![ -]?[0-9])" + _E,
    "ip": _N + r"(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\.?[0-9])" + _E,
    "date": _N
    + r"(?P<date>[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{2}(?P<s2>[-/.])[0-9]{2}(?P=s2)[0-9]{4}|[1-9][0-9]?(?P<s5>[-/.])[1-9][0-9]?(?P=s5)[0-9]{4})(?![-/.]?[0-9])"
    + r"(?:(?![0-9A-Za-z_])|(?=T[0-9]{2}:))",
    "phone": r"(?<![0-9A-Za-z_.])(?P<phone>\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
    + r"|(?:1[ .-])?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:1[.-])?(?<![0-9] )[0-9]{3}(?P<s3>[ .-])[0-9]{3}(?P=s3)[0-9]{4})(?![ .-]?[0-9])"
    + _E,
}
KINDS = list(PARTS)
PATTERN = re.compile("|".join(PARTS.values()))
_ALONE = {k: re.compile(p) for k, p in PARTS.items()}
_STEP = re.compile(r"[0-9A-Za-z]+|.", re.S)
_MAKE = {"email": email, "secret": secret, "assigned": assigned, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date}
#: Every finding has one of these: a digit, an @, or the beginning of a key or of an assignment.
_ANY = re.compile(r"[0-9@]|AKIA|ASIA|gh[pos]_|sk-|xox[bp]-|(?i:token|secret|passwd|password|key)[\"']?[ \t]*[:=]")


def replace(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end (before the change) of each.

    What looks like a kind but is not valid stays; the search goes on behind
    its first character group.
    """
    out, spans, at, done = [], [], 0, 0
    if not _ANY.search(text):
        return text, spans
    while m := PATTERN.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        new = _MAKE[kind](feistel, m[kind], back)
        if new is None:
            # Another kind may match at the same place or inside.
            for other in KINDS[KINDS.index(kind) + 1 :]:
                n = _ALONE[other].match(text, m.start())
                if n and (new := _MAKE[other](feistel, n[other], back)) is not None:
                    kind, m = other, n
                    break
        if new is None:
            at = _STEP.match(text, m.start()).end()
            continue
        out += [text[done : m.start(kind)], new]
        spans.append((kind, m.start(kind), m.end(kind)))
        at = done = m.end(kind)
    return "".join([*out, text[done:]]) if spans else text, spans


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and ``pii``: kind, start and end of each value found.

    Null texts stay null with a null ``pii``; texts without findings stay as
    they are. Whole texts are searched; places count characters of the old text.
    A column pii of ``docs`` is replaced. ``back`` undoes the replacement.
    """
    keep = [c for c in docs.columns if c != "pii"]
    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    fields = docs.select(*keep).schema.add("pii", T.ArrayType(span))
    at = keep.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts, spans = [], []
                for x in part.column(at):
                    s = x.as_py()
                    new, found = replace(s, feistel, back) if s is not None else (None, None)
                    texts.append(new)
                    spans.append(found if found is None else [dict(zip(("kind", "start", "end"), f)) for f in found])
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=fields.names)

    return docs.select(*keep).mapInArrow(run, fields)
