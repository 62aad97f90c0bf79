"""Text and address functions, all built-in expressions (but for NFKC, which has no built-in)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.fixed import DROPPED_TAGS, DROPPED_TAGS_FLAT, LINE_TAGS, NEGATIONS
from folioforge.functions.references import decoded


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: expressions that use a long one several times would grow with each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_contains(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def weighted(text: Column, weights: list[tuple[str, int]]) -> Column:
    """Sum of the weights of all words that text contains."""
    out = F.lit(0)
    for word, weight in weights:
        out = out + F.when(F.contains(text, F.lit(word)), F.lit(weight)).otherwise(F.lit(0))
    return out


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences."""
    word = F.lit(word) if isinstance(word, str) else word
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")).otherwise(F.lit(0).cast("long"))


def _without_tags(html: Column, dropped: list[str]) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in dropped:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def html_text(html: Column) -> Column:
    """Text by lines: no scripts, styles, menus, headers and footers; a line for each block; no empty lines."""
    out = F.regexp_replace(_without_tags(html, DROPPED_TAGS), rf"(?i)<({'|'.join(LINE_TAGS)})\b", "\n<$1")
    out = decoded(F.regexp_replace(out, r"(?s)<[^>]*>", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def html_text_flat(html: Column) -> Column:
    """Text on one line, without code and samples either."""
    out = decoded(F.regexp_replace(_without_tags(html, DROPPED_TAGS_FLAT), r"(?s)<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Feed text without zero-width signs, markers and rules; blank runs capped. NFKC beforehand is nfkc()."""
    out = F.regexp_replace(F.translate(text, "​﻿", ""), "[  ]", "\n")
    out = F.regexp_replace(out, r"(?i)\|back to top\|", "")
    out = F.regexp_replace(out, r"(?m)^[=\-]{4,}$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def nfkc(text: Column) -> Column:
    """Unicode NFKC; the one step without a built-in, so an Arrow function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return run(text)


def hash_norm(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " "), 256)


def hash_raw(text: Column) -> Column:
    return F.md5(text)


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda p: p != "")


def url_filename(url: Column) -> Column:
    """Path parts joined by dashes, cleaned; the host for an empty path."""
    path = F.regexp_replace(F.regexp_replace(F.array_join(path_parts(url), "-"), r"[^a-zA-Z0-9-]", "-"), r"-+", "-")
    host = F.translate(url_host(url), ".:", "--")
    return F.concat(F.when(F.size(path_parts(url)) == 0, host).otherwise(F.regexp_replace(path, r"^-+|-+$", "")), F.lit(".txt"))


def trim_path(url: Column) -> Column:
    """More than two path parts: only the first two are kept."""
    short = F.concat(url_scheme(url), F.lit("://"), url_host(url), F.lit("/"), F.array_join(F.slice(path_parts(url), 1, 2), "/"), F.lit("/"))
    return F.when(F.size(path_parts(url)) > 2, short).otherwise(url)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments, as an array fold: .. takes the segment before it away, and a last one leaves a slash."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    def folded(parts: Column) -> Column:
        kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))

    return F.when(path.rlike(r"/\.\.?(/|$)"), let(F.split(path, "/"), folded)).otherwise(path)


def absolute(base: Column, href: Column) -> Column:
    """href against the address of its page, without its fragment; references resolve as RFC 3986 says, addresses of other schemes stay as they are."""
    root = F.concat(url_scheme(base), F.lit("://"), url_host(base))
    folder = F.when(url_path(base) == "", "/").otherwise(F.regexp_replace(url_path(base), r"[^/]*$", ""))

    def resolved(bare: Column) -> Column:
        path, query = F.regexp_extract(bare, r"^[^?]*", 0), F.regexp_extract(bare, r"\?.*$", 0)
        far = F.concat(url_scheme(bare), F.lit("://"), F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1), without_dots(url_path(bare)), query)
        return (
            F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), far)
            .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
            .when(F.startswith(bare, F.lit("//")), F.concat(url_scheme(base), F.lit(":"), F.regexp_extract(bare, r"^//[^/?]*", 0), without_dots(F.regexp_extract(bare, r"^//[^/?]*([^?]*)", 1)), query))
            .when(bare == "", F.regexp_replace(base, r"#.*$", ""))
            .when(path == "", F.concat(root, url_path(base), query))
            .otherwise(F.concat(root, without_dots(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))), query))
        )

    return let(F.regexp_replace(href, r"#.*$", ""), resolved)


def evidence(text: Column, start: Column, stop: Column, most: int = 150, window: int = 200) -> Column:
    """The sentence around text[start, stop) (1-based), or three words on each side of a match in a long one; between dots.

    A neighbour's edge is sought within window signs; without one the match begins or ends the sentence.
    """
    left = F.substring(text, F.greatest(F.lit(1), start - window), start - F.greatest(F.lit(1), start - window))
    right = F.substring(text, stop, F.lit(window))
    matched = F.substring(text, start, stop - start)
    head = F.when(left.rlike(r"[.!?\n]"), F.ltrim(F.regexp_extract(left, r"([^.!?\n]*)\z", 1))).otherwise(F.lit(""))
    tail = F.when(right.rlike(r"[.!?\n]"), F.regexp_extract(right, r"^([^.!?\n]*[.!?\n])", 1)).otherwise(F.lit(""))
    sentence = F.regexp_replace(F.concat(head, matched, tail), r"^\s+|\s+$", "")
    sentence = F.when(F.contains(sentence, F.lit("  ")), F.regexp_replace(sentence, r"\s+", " ")).otherwise(sentence)
    before, after = F.regexp_extract_all(left, F.lit(r"\S+"), 0), F.regexp_extract_all(right, F.lit(r"\S+"), 0)
    few = F.concat_ws(" ", F.array_join(F.slice(before, F.greatest(F.lit(1), F.size(before) - 2), 3), " "), matched, F.array_join(F.slice(after, 1, 3), " "))
    return F.concat(F.lit("..."), F.when(F.length(sentence) <= most, sentence).otherwise(F.trim(few)), F.lit("..."))


def snippets(text: Column, keyword: str, most: int = 3, around: int = 80) -> Column:
    """Up to most places of a keyword with so many signs around it."""
    low, size = F.lower(text), len(keyword)
    pieces = F.split(low, rf"\Q{keyword}\E", -1)
    hits = F.sequence(F.lit(1), F.least(F.lit(most), F.size(pieces) - 1))
    start = lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda s, p: s + F.length(p)) + (k - 1) * size
    one = lambda k: F.concat(
        F.when(start(k) > around, F.lit("...")).otherwise(F.lit("")),
        F.substring(text, F.greatest(F.lit(0), start(k) - around) + 1, start(k) - F.greatest(F.lit(0), start(k) - around) + size + around),
        F.when(start(k) + size + around < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )
    return F.when(F.size(pieces) > 1, F.transform(hits, one)).otherwise(F.array().cast("array<string>"))


def negated(text: Column, keyword: str | Column, window: int = 50) -> Column:
    """Whether a negation stands within window signs before the keyword's first place, or 'no keyword' around it."""
    return let(F.lower(text), lambda low: negated_low(low, keyword, window))


def negated_low(low: Column, keyword: str | Column, window: int = 50) -> Column:
    """negated() of a text in small letters, which is gone through once for each word."""
    word = F.lower(keyword if isinstance(keyword, Column) else F.lit(keyword))
    size = F.length(word)

    def near(at: Column) -> Column:
        begin = F.greatest(F.lit(1), at - window)
        before = lambda context: F.substring(context, F.lit(1), at - begin + size)
        denied = lambda context: before(context).rlike("|".join(NEGATIONS)) | F.regexp_like(context, F.concat(F.lit(r"\bno\s+\Q"), word, F.lit(r"\E")))
        return (at > 0) & let(F.substring(low, begin, at - begin + size + window), denied)

    return F.contains(low, word) & let(F.position(word, low), near)
