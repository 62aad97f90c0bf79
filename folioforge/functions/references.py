"""Character references of HTML, decoded in one pass by built-in functions. The table of names is that of Python's own library."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names with their semicolon; and the old ones that count without one, the longest first.
_NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
_OLD = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
_OLD_RX = "^(" + "|".join(sorted(_OLD, key=lambda k: (-len(k), k))) + ")"
#: Numbers from 128 to 159 mean the signs of windows-1252 that stand there, if any.
_LOW = [chr(n) for n in range(128, 160)]
_MEANT = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]


def _table(names: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _sign(code: Column) -> Column:
    """The sign of a number: none for control signs and codes without a sign, the replacement sign outside of Unicode."""
    sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    outside = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(outside, "\ufffd").when(control, "").otherwise(F.translate(sign, "".join(_LOW), "".join(_MEANT)))


def _piece(p: Column) -> Column:
    """What an ampersand and the text p behind it stand for."""
    token = F.regexp_extract(p, r"^(?:#[0-9]+|#[xX][0-9A-Fa-f]+);?", 0)
    digits = F.regexp_extract(token, r"^#[xX]?0*([0-9A-Fa-f]*)", 1)
    number = F.when(F.length(digits) > 8, F.lit(None)).when(token.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    number = F.when(digits == "", F.lit(0)).otherwise(number.cast("long"))
    name = F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]*;", 0)
    known, old = F.try_element_at(_table(_NAMED), name), F.regexp_extract(p, _OLD_RX, 1)
    behind = lambda t: F.substring(p, F.length(t) + 1, F.length(p))
    return F.when(token != "", F.concat(_sign(number), behind(token))).when(known.isNotNull(), F.concat(known, behind(name))).when(old != "", F.concat(F.try_element_at(_table(_OLD), old), behind(old))).otherwise(F.concat(F.lit("&"), p))


def decoded(text: Column) -> Column:
    """Text with its numeric and named references decoded once, also old names without a semicolon."""
    pieces = lambda t: F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(_piece(p)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces(text), "")).otherwise(text)
