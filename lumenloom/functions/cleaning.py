"""Text cleaning: colour codes, escapes, serial consoles, blank lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: terminal codes in full, and the narrower set of the line transformer.
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b"
ANSI_NARROW = r"\x1b\[[0-9;]*[a-zA-Z]"


def strip_ansi(text: Column, narrow: bool = False) -> Column:
    return F.regexp_replace(text, ANSI_NARROW if narrow else ANSI, "")


def unescape(text: Column) -> Column:
    """``\\xNN``, ``\\n``, ``\\r``, ``\\t`` and ``\\\\`` as the characters they name.

    The text is cut at its escapes, and each piece is turned by built-in functions.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\\x[0-9A-Fa-f]{2}|\\[nrt\\]|\\|[^\\]+)"), 1)

    def turn(p: Column) -> Column:
        return (
            F.when(p.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.chr(F.conv(F.substring(p, 3, 2), 16, 10).cast("long")))
            .when(p == "\\n", "\n")
            .when(p == "\\r", "\r")
            .when(p == "\\t", "\t")
            .when(p == "\\\\", "\\")
            .otherwise(p)
        )

    return F.when(F.instr(text, "\\") > 0, F.array_join(F.transform(pieces, turn), "")).otherwise(text)


def serial_console(text: Column) -> Column:
    """Escapes turned, colour codes and line ends gone."""
    return F.rtrim(F.regexp_replace(strip_ansi(unescape(text)), r"[\r\n]+$", ""))


def is_blank(text: Column) -> Column:
    """White space alone once colour codes and escapes are gone; an empty text is not blank."""
    return (F.length(text) > 0) & (F.trim(F.regexp_replace(strip_ansi(unescape(text)), r"\s+", "")) == "")


def one_line(text: Column, most: int | None = None) -> Column:
    """White space runs as one blank, cut at ``most`` characters."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return out if most is None else F.left(out, F.lit(most))


def array_text(values: Column, sep: str = "", as_bytes: bool = False) -> Column:
    """The elements joined by ``sep``, or numbers of 0 to 255 as the text of these bytes; '' for an empty array."""
    if as_bytes:
        return F.decode(F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")), "UTF-8")
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)
