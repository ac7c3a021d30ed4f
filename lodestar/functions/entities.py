"""HTML character references as Spark columns, decoded as HTML 5 says.

Names and their characters come from Python's table; nothing of the text leaves the JVM."""

from __future__ import annotations

import html.entities
import zlib
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of the table of names, looked up by CRC-32, so that a look-up compares some ten names and not all.
PARTS = 256
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: The same, but for those that a semicolon closes.
CLOSED = REFERENCE.replace(";?", ";")
UNKNOWN = "�"
_ENTRY, _VALUE = "\x01", "\x02"


@cache
def _parts() -> tuple[str, ...]:
    """The table's parts, each as text that str_to_map reads."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for name, value in html.entities.html5.items():
        parts[zlib.crc32(name.encode()) % PARTS].append(f"{name}{_VALUE}{value}")
    return tuple(_ENTRY.join(p) for p in parts)


@cache
def _open_names() -> str:
    """A pattern of the names that need no semicolon, the longest first, at the beginning of a reference."""
    names = [n for n in html.entities.html5 if not n.endswith(";")]
    return f"^(?:{'|'.join(sorted(names, key=lambda n: (-len(n), n)))})"


def _of_byte(n: int) -> str:
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def _character(n: Column) -> Column:
    """The character of a code point, by its UTF-16 units."""
    beyond = n - F.lit(0x10000)
    pair = F.concat(F.hex(F.shiftright(beyond, 10) + F.lit(0xD800)), F.hex(beyond.bitwiseAND(F.lit(0x3FF)) + F.lit(0xDC00)))
    units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(pair)
    return F.decode(F.unhex(units), "UTF-16BE")


def _numeric(reference: Column) -> Column:
    """What a reference by number stands for: bytes 128 to 159 are Windows-1252's, code points that no text may have give nothing."""
    hexadecimal = F.lower(F.substring(reference, 2, 1)) == "x"
    digits = F.regexp_extract(reference, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    # seven digits hold every code point in either notation, and no number of eight or more is one
    value = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    windows = F.array(*[F.lit(_of_byte(b)) for b in range(0x80, 0xA0)])
    forbidden = value.between(1, 8) | value.between(14, 31) | value.isin(11, 127) | value.between(0xFDD0, 0xFDEF) | (value.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when((F.length(digits) > 7) | (digits == ""), F.lit(UNKNOWN))
        .when((value > 0x10FFFF) | value.between(0xD800, 0xDFFF), F.lit(UNKNOWN))
        .when(value.between(0x80, 0x9F), F.get(windows, value - F.lit(0x80)))
        .when(forbidden, F.lit(""))
        .otherwise(_character(value))
    )


def _named(reference: Column, closed: bool) -> Column:
    """What a reference by name stands for: the whole name, else the longest beginning that needs no semicolon (if not closed) and the rest; else itself."""
    table = F.array(*[F.str_to_map(F.lit(p), F.lit(_ENTRY), F.lit(_VALUE)) for p in _parts()])

    def value(name: Column) -> Column:
        return F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % PARTS).cast("int")), name)

    if closed:
        return F.coalesce(value(reference), F.concat(F.lit("&"), reference))
    begin = F.regexp_extract(reference, _open_names(), 0)
    rest = F.concat(value(begin), F.substr(reference, F.length(begin) + 1))
    return F.coalesce(value(reference), F.when(begin != "", rest), F.concat(F.lit("&"), reference))


def decode_entities(column: Column, closed: bool = False) -> Column:
    """All HTML character references decoded; null stays null, and texts without `&` aren't touched.

    closed leaves references as they are that no semicolon ends (`&amp` at the end of a cut title).
    A number beyond Unicode, however many digits it has, gives U+FFFD. The text is handed to the
    function as one value, for else what it is made of would be computed three times."""
    pattern = CLOSED if closed else REFERENCE

    def whole(text: Column) -> Column:
        decoded = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda r: F.when(r.startswith("#"), _numeric(r)).otherwise(_named(r, closed)))
        joined = F.zip_with(F.split(text, pattern, -1), F.concat(decoded, F.array(F.lit(""))), lambda between, mark: F.concat(between, mark))
        return F.when(text.contains("&"), F.array_join(joined, "")).otherwise(text)

    return F.get(F.transform(F.array(column), whole), F.lit(0))
