"""Date strings: 'Month D, YYYY' is the canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.fixed import MONTH_FORMS, MONTHS
from folioforge.functions.text import let


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), number)


def full_month(word: Column) -> Column:
    """A month's full name for its short or full form; any other word capitalised."""
    out = None
    for short, name in MONTH_FORMS:
        hit = F.lower(word).isin(short.lower(), name.lower())
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20))))


def normal_date(value: Column, year: Column | None = None) -> Column:
    """Six layouts to the canonical form; a zone behind is dropped; without a year the given one is used; others stay."""
    bare = F.regexp_replace(F.trim(value), r"(?i)\s+(?:PST|UTC|EST|CST|MST|PDT|EDT|CDT|MDT|AOE|GMT)$", "")
    return let(bare, lambda v: _layouts(v, year))


def _layouts(v: Column, year: Column | None) -> Column:
    g = lambda rx, k: F.regexp_extract(v, rx, k)
    n = lambda rx, k: F.regexp_extract(v, rx, k).cast("int")
    made = lambda month, day, y: F.concat(month, F.lit(" "), day.cast("string"), F.lit(", "), y)
    iso, us = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
    day_first, month_first = r"^(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})", r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    bare_month, bare_day = r"^([A-Za-z]+)\s+(\d{1,2})(?:,\s*)?$", r"^(\d{1,2})\s+([A-Za-z]+)(?:,\s*)?$"
    out = F.when(v.rlike(iso) & n(iso, 2).between(1, 12), made(month_name(n(iso, 2)), n(iso, 3), g(iso, 1)))
    out = out.when(v.rlike(us) & n(us, 1).between(1, 12), made(month_name(n(us, 1)), n(us, 2), g(us, 3)))
    out = out.when(v.rlike(day_first), made(full_month(g(day_first, 2)), n(day_first, 1), g(day_first, 3)))
    out = out.when(v.rlike(month_first), made(full_month(g(month_first, 1)), n(month_first, 2), g(month_first, 3)))
    if year is not None:
        y = year.cast("string")
        out = out.when(v.rlike(bare_month) & y.isNotNull(), made(full_month(g(bare_month, 1)), n(bare_month, 2), y))
        out = out.when(v.rlike(bare_day) & y.isNotNull(), made(full_month(g(bare_day, 2)), n(bare_day, 1), y))
    return F.when(F.coalesce(v, F.lit("")).isin("", "unknown"), F.lit("unknown")).otherwise(out.otherwise(v))


def format_deadline(stamp: Column) -> Column:
    """'YYYY-MM-DD hh:mm:ss' to the canonical form, '' for anything else."""
    return F.coalesce(F.date_format(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")), "MMMM d, yyyy"), F.lit(""))


def comparison_key(value: Column) -> Column:
    """Lower case, months in full, no punctuation, single spaces."""
    out = F.lower(F.trim(value))
    for short, name in MONTH_FORMS:
        out = F.regexp_replace(out, rf"\b{short.lower()}\b", name.lower())
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9 ]", " "), r" +", " "))


def short_date(value: Column, as_of: Column) -> Column:
    """'Mon D, YYYY' for ranges, single and ISO dates; a missing year is as_of's, or the next for months before as_of's."""
    rng, one, iso = r"([A-Za-z]+)\s+(\d+)[-–](\d+)(?:,?\s+(\d{4}))?", r"([A-Za-z]+)\s+(\d+)(?:,?\s+(\d{4}))?", r"(\d{4})-(\d{2})-(\d{2})"
    g = lambda rx, k: F.regexp_extract(value, rx, k)
    short = lambda rx: F.substring(g(rx, 1), 1, 3)
    number = lambda rx: F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.lower(short(rx)))
    year = lambda rx, k: F.when(g(rx, k) != "", g(rx, k)).otherwise((F.year(as_of) + F.when(number(rx) < F.month(as_of), 1).otherwise(0)).cast("string"))
    out = F.when(F.coalesce(value, F.lit("")).isin("", "unknown"), F.lit("Unknown"))
    out = out.when(value.rlike(rng), F.concat(short(rng), F.lit(" "), g(rng, 2), F.lit("-"), g(rng, 3), F.lit(", "), year(rng, 4)))
    out = out.when(value.rlike(one), F.concat(short(one), F.lit(" "), g(one, 2), F.lit(", "), year(one, 3)))
    out = out.when(value.rlike(iso), F.concat(F.substring(month_name(g(iso, 2).cast("int")), 1, 3), F.lit(" "), g(iso, 3).cast("int").cast("string"), F.lit(", "), g(iso, 1)))
    return out.otherwise(value)
