"""Values of rules: typed handlers, cleaners and places as column functions, with registries that callers may extend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.dates import full_month, normal_date
from folioforge.functions.fixed import (
    CITY_STATES,
    CORRUPTION_WORDS,
    COUNTRIES,
    DAYS,
    KNOWN_COUNTRIES,
    MONTH_FORMS,
    MONTHS,
    NEGATIVE_NAMES,
    NUMBER_WORDS,
    TERRITORIES,
    TERRITORY_NAMES,
    US_STATE_CODES,
    US_STATES,
    VENUE_WORDS,
)
from folioforge.functions.text import any_contains, let, negated

# ---- What counts as known -----------------------------------------------------------------------------------------------


def is_known(value: Column, mode: str = "report") -> Column:
    """quality: not null, not unknown; report: nor ''; site: nor not_mentioned; display: nor none of them in any case."""
    bad = {"quality": ["unknown"], "report": ["unknown", ""], "site": ["unknown", "", "not_mentioned"], "display": ["unknown", "", "not_mentioned", "none"]}[mode]
    return value.isNotNull() & ~(F.lower(value) if mode == "display" else value).isin(*bad)


# ---- Cleaners -------------------------------------------------------------------------------------------------------------


def file_size(v: Column) -> Column:
    rx = r"(?i)(\d+)\s*(MB|megabytes?)"
    return F.when(v.rlike(rx), F.concat(F.regexp_extract(v, rx, 1), F.lit("MB"))).otherwise(v)


def page_count(v: Column) -> Column:
    out = v
    for n, word in enumerate(NUMBER_WORDS, 1):
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", str(n))
    out = F.regexp_replace(out, r"(?i)\bpage\b", "pages")
    return F.trim(F.regexp_replace(out, r"(?i)(\d+)[- ]?pages", "$1 pages"))


def system_name(v: Column) -> Column:
    out = F.when(F.lit(False), v)
    for name in ("OpenReview", "EasyChair", "CMT", "SoftConf", "HotCRP"):
        out = out.when(F.lower(F.trim(v)) == name.lower(), F.lit(name))
    return out.otherwise(v)


#: Venue patterns in the order in which they are tried.
VENUES = [
    (r"(?:proceedings\s+of\s+)?machine\s+learning\s+research", "PMLR"), (r"pmlr", "PMLR"), (r"acm\s+digital\s+library", "ACM Digital Library"), (r"acm\s+dl", "ACM Digital Library"),
    (r"ieee\s+xplore", "IEEE Xplore"), (r"ieee", "IEEE"), (r"springer", "Springer"), (r"lecture\s+notes\s+in\s+computer\s+science", "LNCS"), (r"lncs", "LNCS"),
    (r"journal\s+of\s+machine\s+learning\s+research", "JMLR"), (r"jmlr", "JMLR"),
]


def venue(v: Column) -> Column:
    bare = F.trim(F.regexp_replace(v, r"(?i)^(?:published?\s+(?:in|by|through|via)\s+(?:the\s+)?)", ""))
    out = F.when(F.lit(False), v)
    for rx, name in VENUES:
        out = out.when(F.lower(bare).rlike(rx), F.lit(name))
    return out.otherwise(bare)


def _stripped(v: Column, labels: list[str]) -> Column:
    for rx in labels:
        v = F.regexp_replace(v, f"(?i)^{rx}", "")
    return v


def deadline(v: Column) -> Column:
    labels = [r"(?:paper\s+)?submission\s+(?:deadline\s+)?", r"(?:papers?\s+)?due\s+", r"deadline\s+", r"manuscripts?\s+(?:due\s+)?", r"submit\s+(?:by\s+)?", r"(?:is|was|at)\s+"]
    return normal_date(F.trim(_stripped(v, labels)))


def notification(v: Column) -> Column:
    labels = [
        r"(?:acceptance\s+)?notification\s+(?:date\s+)?",
        r"(?:acceptance\s+)?decisions?\s+(?:announced|sent|released)\s+",
        r"authors?\s+(?:will\s+be\s+)?notified\s+(?:by|in)\s+",
        r"(?:is|was|on)\s+",
    ]
    return normal_date(F.trim(_stripped(v, labels)))


def artifact(v: Column) -> Column:
    return F.when(any_contains(F.lower(v), ["required", "mandatory", "must submit", "must provide"]), "required").otherwise("optional")


def model_policy(v: Column) -> Column:
    low = F.lower(v)
    return (
        F.when(any_contains(low, ["prohibited", "not allowed", "forbidden", "banned", "not permitted"]), "prohibited")
        .when(any_contains(low, ["must be disclosed", "disclosure required", "must disclose", "should disclose", "disclosure", "must be marked", "must mark"]), "must_disclose")
        .when(any_contains(low, ["discouraged", "not recommended", "should not"]), "discouraged")
        .when(any_contains(low, ["allowed", "permitted", "acceptable", "can use", "may use"]), "allowed")
        .otherwise("must_disclose")
    )


def page_number(v: Column) -> Column:
    """A range, the first number, or the first number word that is contained (a substring test, so their order matters)."""
    out = F.when(F.lit(False), v)
    for rx in (r"(?i)between\s+(\d+)\s+and\s+(\d+)", r"(\d+)\s*-\s*(\d+)", r"(?i)(\d+)\s+to\s+(\d+)"):
        out = out.when(v.rlike(rx), F.concat(F.regexp_extract(v, rx, 1), F.lit("-"), F.regexp_extract(v, rx, 2), F.lit(" pages")))
    out = out.when(v.rlike(r"\d"), F.concat(F.regexp_extract(v, r"(\d+)", 1), F.lit(" pages")))
    for n, word in enumerate(NUMBER_WORDS, 1):
        out = out.when(F.contains(F.lower(v), F.lit(word)), F.lit(f"{n} pages"))
    return out.otherwise("unknown")


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "file_size": file_size, "page_count": page_count, "system_name": system_name, "venue": venue, "deadline": deadline, "notification": notification,
    "artifact": artifact, "model_policy": model_policy, "page_number": page_number,
}


def cleaned(name: Column, value: Column) -> Column:
    """The cleaner named by a column applied to value; no name leaves it."""
    out = F.when(F.lit(False), value)
    for key, cleaner in CLEANERS.items():
        out = out.when(name == key, cleaner(value))
    return out.otherwise(value)


# ---- Typed handlers ---------------------------------------------------------------------------------------------------------


def _words(x: list[str] | Column) -> Column:
    """A list of words as a column; null is none."""
    return F.coalesce(x if isinstance(x, Column) else F.array(*map(F.lit, x)).cast("array<string>"), F.array().cast("array<string>"))


def _first_held(match: Column, words: list[str] | Column) -> Column:
    """The first of the words that a match holds."""
    return F.get(F.filter(_words(words), lambda w: F.contains(F.lower(match), F.lower(w))), F.lit(0))


def boolean_value(text: Column, match: Column, pattern: Column, positive: list[str] | Column, negative: list[str] | Column) -> Column:
    """False by the pattern's name, a negative word, or a negated positive word (the first that the match holds); else true."""
    return boolean_of(match, pattern, positive, negative, lambda word: negated(text, word))


def boolean_of(match: Column, pattern: Column, positive: list[str] | Column, negative: list[str] | Column, denied: Callable[[Column], Column]) -> Column:
    """boolean_value(), with what tells whether the text negates a word."""
    word = _first_held(match, positive)
    return F.when(any_contains(F.lower(pattern), NEGATIVE_NAMES), False).when(_first_held(match, negative).isNotNull(), False).when(word.isNotNull(), ~denied(word)).otherwise(True)


def enum_value(match: Column, allowed: list[str] | Column, cleaner: str | Column | None = None) -> Column:
    """The cleaner's label if allowed, else the first allowed value contained, else required or optional by common words."""
    label = cleaned(cleaner, match) if isinstance(cleaner, Column) else CLEANERS[cleaner](match) if cleaner else match
    low = F.lower(label)
    out = F.when(F.array_contains(_words(allowed), label), label)
    first = F.get(F.filter(_words(allowed), lambda v: F.contains(low, F.lower(v))), F.lit(0))
    return out.when(first.isNotNull(), first).when(any_contains(low, ["required", "mandatory"]), "required").when(any_contains(low, ["optional", "encouraged"]), "optional").otherwise("unknown")


def season_months(v: Column) -> Column:
    out = F.when(F.lit(False), v)
    year = F.regexp_extract(v, r"\d{4}", 0)
    for season, months in (("spring", "March-May"), ("summer", "June-August"), ("fall", "September-November"), ("autumn", "September-November"), ("winter", "December-February")):
        out = out.when(F.contains(F.lower(v), F.lit(season)), F.trim(F.concat(F.lit(f"{months} "), year)))
    return out.otherwise(v)


def date_range(v: Column) -> Column:
    """'Month D - D, YYYY' or 'Month D - Month D, YYYY' for ranges in any dash, 'to' or 'through'; others stay."""
    rx = r"([A-Z][a-z]+)\s+(\d{1,2})\s*-\s*(?:([A-Z][a-z]+)\s+)?(\d{1,2}),?\s+(\d{4})"

    def made(plain: Column) -> Column:
        g = lambda k: F.regexp_extract(plain, rx, k)
        second = F.when((g(3) == "") | (g(3) == g(1)), F.lit("")).otherwise(F.concat(g(3), F.lit(" ")))
        return F.when(plain.rlike(rx), F.concat(g(1), F.lit(" "), g(2), F.lit(" - "), second, g(4), F.lit(", "), g(5)))

    return F.coalesce(let(F.regexp_replace(v, r"\s*[–−]\s*|\s+to\s+|\s+through\s+", " - "), made), v)


def valid_date_range(v: Column) -> Column:
    low = F.lower(v)
    garbage = ["at short notice", "available at", "devoted to", "subject to", "open to"]
    named = any_contains(low, [m[:3].lower() for m in MONTHS]) | v.rlike(r"\d{4}")
    return named & ~any_contains(low, garbage) & F.length(v).between(6, 100) & ~v.isin("", "unknown")


def date_value(match: Column, cleaner: str | Column | None = None, is_range: bool | Column = False) -> Column:
    """A date string without labels, weekdays and ordinals, months in full; TBD for what is to be announced."""
    v = cleaned(cleaner, F.trim(match)) if isinstance(cleaner, Column) else CLEANERS[cleaner](F.trim(match)) if cleaner else F.trim(match)
    v = F.trim(F.regexp_replace(v, r"^(?s:.*):", ""))  # what stands behind the last colon
    v = F.regexp_replace(v, r"(?i)^(?:author response period|response period|rebuttal period|submission period|review period)\s+", "")
    v = F.regexp_replace(v, r"(?i)(?:Sun|Mon|Tue|Wed|Thu|Fri|Sat)\.?\s+", "")
    v = F.regexp_replace(v, r"(?i)\b(\d+)(?:st|nd|rd|th)\b", "$1")
    v = F.regexp_replace(v, r"(?i)\bthe\s+(\d)", "$1")
    for short, name in MONTH_FORMS:
        v = F.regexp_replace(v, rf"(?i)\b{short}\b", name)
    v = F.trim(F.regexp_replace(v, r"\s+", " "))
    if is_range is not False:
        single = v
        v = let(date_range(v), lambda r: F.when(valid_date_range(r), r).otherwise("unknown"))
        v = v if is_range is True else F.when(is_range, v).otherwise(single)
    v = let(v, season_months)
    return F.when(any_contains(F.lower(match), ["tbd", "tba", "to be announced", "coming soon"]), "TBD").otherwise(v)


def not_stale(v: Column, as_of_year: int, most: int = 2) -> Column:
    """unknown for dates whose year is more than most years before as_of_year."""
    year = F.regexp_extract(v, r"\b(\d{4})\b", 1)
    return F.when((year != "") & (F.nullif(year, F.lit("")).cast("int") < as_of_year - most), "unknown").otherwise(v)


def number_value(match: Column, low: int | None = None, high: int | None = None) -> Column:
    n = F.nullif(F.regexp_extract(match, r"(\d+)", 1), F.lit("")).cast("long")
    ok = n.isNotNull() & ((n >= low) if low is not None else F.lit(True)) & ((n <= high) if high is not None else F.lit(True))
    return F.when(ok, n.cast("string")).otherwise("unknown")


def string_value(match: Column) -> Column:
    """A place or name without its label, leading words, trailing words, acronym and punctuation."""
    v = F.trim(F.regexp_replace(match, r"\s+", " "))
    v = F.trim(F.regexp_replace(v, r"(?i)^[^:]*(?:location|venue|place|city)[^:]*:", ""))
    for rx in (r"will\s+be\s+held\s+(?:in|at)\s+", r"held\s+(?:in|at)\s+", r"takes?\s+place\s+in\s+", r"to\s+be\s+held\s+(?:in|at)\s+"):
        v = F.regexp_replace(v, f"(?i)^{rx}", "")
    for word in ("Place", "Location", "Venue", "City", "At", "In"):
        v = F.regexp_replace(v, rf"^{word} \s*", "")
    v = F.regexp_replace(v, r"(?i)\s+(?:from|on|during|at)\s*$", "")
    for word in ("The", "A", "An", "And", "Or", "For", "In", "At", "On"):
        v = F.regexp_replace(v, rf" {word}$", "")
    return F.regexp_replace(F.regexp_replace(v, r"\s+[A-Z]{3,10}$", ""), r"[,;.]+$", "")


HANDLERS: dict[str, Callable[..., Column]] = {"boolean": boolean_value, "enum": enum_value, "date": date_value, "number": number_value, "string": string_value, "list": lambda match: F.array(F.trim(match))}


# ---- Places ---------------------------------------------------------------------------------------------------------------


def valid_location(v: Column) -> Column:
    """Whether a string looks like a place: a comma, 2 to 5 words, a capital in front, no dates, no prose."""
    low, first = F.lower(v), F.trim(F.get(F.split(F.lower(v), ","), F.lit(0)))
    garbage = ["of the ", "such ", " you", "research", "job fair", "attend ", "paper", "submission", "abstract", "however", "thus", "question"]
    months = "|".join(m.lower() for m in MONTHS)
    return (
        F.length(v).between(5, 100)
        & F.contains(v, F.lit(","))
        & ~first.isin(*DAYS, *[m.lower() for m in MONTHS])
        & ~low.rlike(rf"\b(?:{months})\s+\d{{1,2}}\s*(?:-|to|through)\b")
        & ~any_contains(low, garbage)
        & F.size(F.regexp_extract_all(v, F.lit(r"\S+"), 0)).between(2, 5)
        & F.substring(v, 1, 1).rlike(r"[A-Z]")
        & (v != "unknown")
    )


def title_case(v: Column) -> Column:
    """Capitals after anything that isn't a letter, small letters elsewhere."""
    runs = F.regexp_extract_all(F.lower(v), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 20))), "")


def is_venue(part: Column) -> Column:
    return any_contains(part, VENUE_WORDS) | (F.length(part) > 40)


def corrupted(parts: Column, whole_words: bool = False) -> Column:
    """Prose, dates, glued words and venues that aren't places. By default words are sought anywhere, inside others too."""
    joined = F.array_join(parts, " ")
    words = joined.rlike(r"\b(?:" + "|".join(CORRUPTION_WORDS) + r")\b") if whole_words else any_contains(joined, CORRUPTION_WORDS)
    out = words | F.exists(parts, lambda p: p.isin(*[m.lower() for m in MONTHS])) | F.exists(parts, lambda p: any_contains(p, DAYS))
    out |= joined.rlike(r"(china|australia|portugal|japan|france|germany|italy|spain|india|korea|canada|brazil)[a-z]{5,}") | F.contains(joined, F.lit("|"))
    out |= joined.rlike(r"\d+\*|^university\s+(in|of)\s+|^\d+\s+|^\d+$|^[a-z]+\s+\d{4}$")
    out |= (F.size(parts) == 1) & is_venue(F.get(parts, F.lit(0))) & ~F.get(parts, F.lit(0)).isin(*CITY_STATES)
    return out | F.exists(parts, lambda p: ~F.contains(p, F.lit(" ")) & (F.length(p) > 20))


def location(raw: Column, whole_words: bool = False, keep_short: bool = False) -> Column:
    """struct(city, country, display) of a raw place. keep_short keeps a first part of two to four letters."""
    low = F.regexp_replace(F.lower(F.trim(raw)), r"\s*\([^)]*\)\s*", " ")
    low = F.regexp_replace(F.regexp_replace(low, r"\s+(and|&)\s+(online|virtual)\s*$", ""), r"\s+/\s+virtual.*$", "")
    if not keep_short:
        low = F.regexp_replace(low, r"^[a-z]{2,4},\s+", "")
    cut = let(low, lambda x: F.filter(F.transform(F.split(F.when(F.contains(x, F.lit(",")), x).otherwise(F.replace(x, F.lit(" - "), F.lit(", "))), ","), lambda p: F.trim(p)), lambda p: p != ""))
    missing = F.coalesce(raw, F.lit("")).isin("", "unknown", "Unknown")
    place = let(cut, lambda parts: _city_country(parts, whole_words))
    none = F.lit(None).cast("string")
    return let(F.when(missing, F.struct(none.alias("city"), none.alias("country"))).otherwise(place), _shown)


def _city_country(parts: Column, whole_words: bool) -> Column:
    """struct(city, country) in lower case, by the number of parts."""
    n, first, second, last = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.size(parts) - 1)
    none = F.lit(None).cast("string")
    pair = lambda city, country: F.struct(city.alias("city"), country.alias("country"))
    canonical = lambda c: F.coalesce(*[F.when(c == a, F.lit(b)) for a, b in TERRITORY_NAMES.items()], c)
    states, countries = [*US_STATES, *US_STATE_CODES], list(COUNTRIES)
    words = F.split(first, r"\s+")
    tail = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    one = F.when(first.isin(*TERRITORIES), pair(canonical(first), canonical(first))).when(first.isin(*CITY_STATES), pair(first, first))
    for t in TERRITORIES:
        one = one.when(F.contains(first, F.lit(t)), pair(F.lit(TERRITORY_NAMES.get(t, t)), F.lit(TERRITORY_NAMES.get(t, t))))
    for t in CITY_STATES:
        one = one.when(F.contains(first, F.lit(t)), pair(F.lit(t), F.lit(t)))
    one = one.when((F.size(words) >= 2) & tail.isin(*countries), pair(F.get(words, F.lit(0)), tail)).when((F.size(words) == 2) & tail.isin(*states), pair(F.get(words, F.lit(0)), F.lit("us")))
    one = one.when((F.size(words) > 1) | ~first.isin(*KNOWN_COUNTRIES, *countries), pair(none, none)).otherwise(pair(none, first))
    two = F.when(is_venue(first) & ~second.isin(*countries, *US_STATES), pair(second, none)).when(is_venue(first), pair(none, second))
    two = two.when(first.isin(*TERRITORIES), pair(canonical(first), canonical(first))).when(second.isin(*TERRITORIES), pair(first, second)).when(second.isin(*states), pair(first, F.lit("us"))).otherwise(pair(first, second))
    american = (n == 3) & last.isin(*[k for k, v in COUNTRIES.items() if v == "US"]) & second.isin(*states)
    many = F.when(american, pair(first, F.lit("us"))).when(is_venue(first), pair(second, last)).otherwise(pair(first, last))
    bad = (n == 0) | corrupted(parts, whole_words)
    return F.when(bad, pair(none, none)).when(n == 1, one).when(n == 2, two).otherwise(many)


def _shown(got: Column) -> Column:
    """struct(city, country, display) with capitals."""
    states = [*US_STATES, *US_STATE_CODES]
    mapped = F.create_map(*[x for k, v in COUNTRIES.items() for x in (F.lit(k), F.lit(v))])
    country = F.coalesce(F.try_element_at(mapped, got["country"]), F.when(got["country"].isin(*states), "US"), title_case(got["country"]))
    city = title_case(got["city"])
    territory = F.contains(country, F.lit(", China")) & got["city"].isin(*TERRITORIES)
    display = (
        F.when(city.isNull() & country.isNull(), "Unknown").when(city == country, city).when(territory, country).when(city.isNotNull() & country.isNotNull(), F.concat(city, F.lit(", "), country)).otherwise(F.coalesce(city, country))
    )
    return F.struct(city.alias("city"), country.alias("country"), display.alias("display"))


__all__ = ["CLEANERS", "HANDLERS", "cleaned", "full_month", "is_known", "location", "valid_location"]
