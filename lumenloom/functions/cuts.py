"""Lines cut at the marks that their formats put between fields, and tests of what stands between.

A format is a row of marks and a function of the pieces between them: whether
they look right, and which fields they make up. A line is cut once; the tests
and fields read its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache, reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.network import let
from lumenloom.functions.patterns import captures

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Dates and times with each digit as 0.
DATE, CLOCK = "0000-00-00", "00:00:00"


@dataclass(frozen=True)
class Cut:
    """ok: whether a line has the form; array: its fields then, from place 1 on."""

    ok: Column
    array: Column

    def read(self) -> Column:
        """The fields, null for lines of other forms."""
        return F.when(self.ok, self.array)


@cache
def _between(marks: tuple[str, ...]) -> str:
    """A pattern with a group for each piece before, between and behind the marks' first places in this order."""
    plain = lambda t: re.sub(r"([^\w\s])", r"\\\1", t)
    pieces = [(f"([^{plain(m)}]*)" if len(m) == 1 else "((?s:.*?))") + plain(m) for m in marks]
    return "^" + "".join(pieces) + "((?s:.*))$"


def cut(text: Column, *marks: str) -> tuple[Column, list[Column]]:
    """Whether all marks stand in the text in this order, and the pieces before, between and behind their first places."""
    caps = captures(text, _between(marks))
    return F.size(caps) > 1, [F.get(caps, F.lit(i + 1)) for i in range(len(marks) + 1)]


def form(ok: Column, fields: Sequence[Column]) -> Cut:
    """A form that is told without cutting."""
    return Cut(F.coalesce(ok, F.lit(False)), F.array(F.lit(""), *fields))


Fields = Callable[..., tuple[Column, Sequence[Column]]]


def _bound(base: Column, read: Callable[[Column], tuple[Column, Sequence[Column]]]) -> Cut:
    """``read`` gives test and fields from a value that is computed once for all of them."""
    return Cut(F.coalesce(let(base, lambda c: read(c)[0]), F.lit(False)), let(base, lambda c: F.array(F.lit(""), *read(c)[1])))


def marked(*marks: str, of: Callable[[Column], Column] = lambda t: t) -> Callable[[Fields], Callable[[Column], Cut]]:
    """A form whose function takes the text and its pieces between these marks, and gives the test and the fields."""

    def made(parts: Fields) -> Callable[[Column], Cut]:
        @wraps(parts)
        def at_text(text: Column) -> Cut:
            pieces = lambda c: [F.get(c, F.lit(i + 1)) for i in range(len(marks) + 1)]
            whole = lambda c: parts(text, *pieces(c))
            return _bound(captures(of(text), _between(marks)), lambda c: ((F.size(c) > 1) & whole(c)[0], whole(c)[1]))

        return at_text

    return made


def spaced(most: int = -1, of: Callable[[Column], Column] = lambda t: t) -> Callable[[Fields], Callable[[Column], Cut]]:
    """A form whose function takes the text and its words, see words()."""

    def made(parts: Fields) -> Callable[[Column], Cut]:
        @wraps(parts)
        def at_text(text: Column) -> Cut:
            return _bound(words(of(text), most), lambda w: parts(text, w))

        return at_text

    return made


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def before(text: Column, mark: str) -> Column:
    """Up to the first mark; all where there is none."""
    return F.substring_index(text, mark, 1)


def behind(text: Column, mark: str) -> Column:
    """Behind the first mark; null where there is none."""
    at = F.call_function("instr", text, F.lit(mark))
    return F.when(at > 0, F.substr(text, at + len(mark)))


def last(text: Column, mark: str) -> Column:
    """Behind the last mark; all where there is none."""
    return F.substring_index(text, mark, -1)


def until_last(text: Column, mark: str) -> Column:
    """Up to the last mark; null where there is none."""
    return F.when(text.contains(mark), F.substr(text, F.lit(1), F.length(text) - F.length(last(text, mark)) - len(mark)))


def words(text: Column, most: int = -1) -> Column:
    """The words between runs of blanks; the last one holds the rest, if there are more than ``most``."""
    return F.split(text, " +", most)


def at(words_: Column, i: int) -> Column:
    return F.get(words_, F.lit(i))


def digits(text: Column) -> Column:
    """Nothing but digits, one at least."""
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def like(text: Column, form: str) -> Column:
    """It begins with this form, in which 0 is any digit."""
    return F.translate(F.left(text, F.lit(len(form))), "123456789", "000000000") == form


def fraction(text: Column, form: str) -> Column:
    """This form, then digits alone."""
    return like(text, form) & digits(F.substr(text, F.lit(len(form) + 1)))


def solid(text: Column) -> Column:
    """Something, without a blank in it."""
    return (text != "") & ~text.contains(" ")


def named(text: Column) -> Column:
    """Letters, digits and underscores alone."""
    return text.rlike(r"^\w+$")


def unbracketed(text: Column, mark: str = "[") -> Column:
    """Up to a bracket, without blanks before it."""
    return F.rtrim(before(text, mark))


def first_line(text: Column) -> Column:
    return before(text, "\n")


def more_lines(text: Column) -> Column:
    """All behind the first line, its break with it; null where there is one line alone."""
    rest = F.substr(text, F.length(first_line(text)) + 1)
    return F.nullif(rest, F.lit(""))


def request(text: Column) -> tuple[Column, list[Column]]:
    """``GET /path HTTP/1.1``: whether it is these three words, and the words."""
    w = F.split(text, " ")
    return F.size(w) == 3, [at(w, i) for i in range(3)]
