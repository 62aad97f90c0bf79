"""Classifiers: text to typed values with confidence, from tables of labelled patterns.

Texts stay in their rows: each classifier tries its patterns (configuration, so few) on a folded text where it stands, and only what they find goes on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import classifier_patterns as c
from folioforge.functions.fixed import NUMBER_WORDS
from folioforge.functions.regex import folded, java_of_folded, literals, sought
from folioforge.functions.text import let
from folioforge.operators.scan import all_matches, scan_with

#: A part of a pattern that takes any signs, as few as it can.
_GAP = re.compile(r"\(\?:\.\*\?\)|\.\*\?")
#: Signs in a piece of a text that is read in many places.
_PIECE = 512


def until(rx: str, flags: int) -> str:
    """For a pattern with a gap that crosses lines: what reaches from the text's start to the last place where the part behind the gap matches; else empty.

    No match ends later. Sought in that much of the text, each beginning finds its end, so that work grows with the text; in the whole
    one, each beginning behind the last end would be tried up to the text's end.
    """
    parts = _GAP.split(rx)
    return java_of_folded(rf"\A.*(?:{parts[-1]})", flags) if flags & re.S and len(parts) > 1 else ""


def _table(groups: dict, flags: int = re.I) -> Column:
    """The patterns of {group: {label: [patterns]}} for folded text as an array of (grp, label, label_no, pattern_no, rx, until, held, sought)."""
    rows = [(str(g), str(label), k, n, rx) for g, labels in groups.items() for k, (label, patterns) in enumerate(labels.items()) for n, rx in enumerate(patterns)]
    one = lambda g, label, k, n, rx: F.struct(
        F.lit(g).alias("grp"), F.lit(label).alias("label"), F.lit(k).alias("label_no"), F.lit(n).alias("pattern_no"), F.lit(java_of_folded(rx, flags)).alias("rx"), F.lit(until(rx, flags)).alias("until"),
        F.array(*map(F.lit, literals(rx))).cast("array<string>").alias("held"), F.array(*map(F.lit, sought(rx, flags))).cast("array<string>").alias("sought"),
    )
    return F.array(*[one(*r) for r in rows])


def _tried(t: Column, table: Column) -> Column:
    """The patterns of a table whose literals the folded text t.low holds, the longest with what must stand around them."""
    return F.filter(table, lambda p: F.forall(p["held"], lambda h: F.contains(t["low"], h)) & F.forall(p["sought"], lambda s: F.regexp_like(t["low"], s)))


def _both(text: Column) -> Column:
    return F.struct(text.alias("text"), folded(text).alias("low"))


def _found(text: Column, groups: dict, around: int, weight, flags: int = re.I) -> Column:
    """array of (grp, label_no, pattern_no, label, score, windows) of the patterns that match: the sum of their matches' weights, and the first two matches with so many signs around."""

    def window(t: Column, start: Column, size: Column) -> Column:
        begin = F.greatest(F.lit(1), start - around)
        return F.regexp_replace(F.substring(t["text"], begin, start - begin + size + around), r"^\s+|\s+$", "")

    def windows(t: Column, seen: Column, rx: Column, ms: Column) -> Column:
        def two(pieces: Column) -> Column:
            first = F.length(F.get(pieces, F.lit(0))) + 1
            second = first + F.length(F.get(ms, F.lit(0))) + F.length(F.get(pieces, F.lit(1)))
            return F.when(F.size(ms) == 1, F.array(window(t, first, F.length(F.get(ms, F.lit(0)))))).otherwise(F.array(window(t, first, F.length(F.get(ms, F.lit(0)))), window(t, second, F.length(F.get(ms, F.lit(1))))))

        return F.when(F.size(ms) == 0, F.array().cast("array<string>")).otherwise(let(F.split(seen, rx, 3), two))

    def one(t: Column, p: Column) -> Column:
        seen = F.when(p["until"] == "", t["low"]).otherwise(F.coalesce(F.get(F.regexp_extract_all(t["low"], p["until"], F.lit(0)), F.lit(0)), F.lit("")))
        return let(seen, lambda s: let(F.regexp_extract_all(s, p["rx"], F.lit(0)), lambda ms: F.struct(p["grp"].alias("grp"), p["label_no"].alias("label_no"), p["pattern_no"].alias("pattern_no"), p["label"].alias("label"), weight(ms).alias("score"), windows(t, s, p["rx"], ms).alias("windows"))))

    hits = let(_both(text), lambda t: F.filter(F.transform(_tried(t, _table(groups, flags)), lambda p: one(t, p)), lambda x: F.size(x["windows"]) > 0))
    return F.coalesce(F.when(text.isNotNull(), hits), F.array().cast("array<struct<grp: string, label_no: int, pattern_no: int, label: string, score: double, windows: array<string>>>"))


def _scores(hits: Column) -> Column:
    """array of (label_no, label, score): the sums of hits by label."""
    labels = F.array_distinct(F.transform(hits, lambda h: F.struct(h["label_no"].alias("label_no"), h["label"].alias("label"))))
    total = lambda k: F.aggregate(F.filter(hits, lambda h: h["label_no"] == k), F.lit(0.0), lambda s, h: s + h["score"])
    return F.transform(labels, lambda x: F.struct(x["label_no"].alias("label_no"), x["label"].alias("label"), total(x["label_no"]).alias("score")))


def _evidence(hits: Column) -> Column:
    """The first two windows of all patterns, by label and pattern."""
    return F.array_join(F.slice(F.flatten(F.transform(hits, lambda x: x["windows"])), 1, 2), "; ")


def _firsts(texts: DataFrame, keys: list[str], groups: dict) -> DataFrame:
    """(keys, field, name, match): for each group the first label with a match."""
    rows = [(str(g), n, label, rx) for g, labels in groups.items() for n, (label, rx) in enumerate((str(label), rx) for label, rxs in labels.items() for rx in rxs)]
    return scan_with(texts, keys, rows)


def page_limit(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, main_limit, evidence, confidence): the best of all page patterns' matches.

    A match weighs 100 among the first seven patterns, 50 near words of the main paper, 25 far from words of side tracks, 20 from
    six pages on; the first of equals by pattern and place. Only a text's best match leaves its row. What stands around a match is cut
    from pieces of the text, as a place far into a whole one takes longer to reach.
    """
    def shown_of(match: Column) -> Column:
        shown = F.when(match.rlike(r"\d"), match)
        for n, word in enumerate(NUMBER_WORDS, 1):
            shown = shown.when(match.rlike(rf"(?i)\b{word}\b"), F.regexp_replace(match, rf"(?i)\b{word}\b", str(n)))
        return shown.otherwise(match)

    def cut(pieces: Column, begin: Column, size: Column) -> Column:
        k = F.floor((begin - 1) / _PIECE).cast("int")
        few = F.slice(pieces, k + 1, F.floor(size / _PIECE).cast("int") + 2)
        return F.substring(F.array_join(few, ""), begin - k * _PIECE, size)

    def judged(pieces: Column, p: Column, m: Column) -> Column:
        begin = F.greatest(F.lit(1), m["start"] - 100)
        around = let(cut(pieces, begin, m["start"] - begin + F.length(m["match"]) + 100), F.lower)
        parts = F.struct(around.alias("around"), shown_of(cut(pieces, m["start"], F.length(m["match"]))).alias("shown"))

        def weighed(x: Column) -> Column:
            numbers = F.regexp_extract_all(x["shown"], F.lit(r"\d+"), 0)
            main = x["around"].rlike("main paper|regular paper|full paper|research paper|submission")
            side = x["around"].rlike("poster|demo|workshop|abstract submission|extended abstract")
            weight = F.when(p["pattern_no"] < 7, 100).otherwise(0) + F.when(main, 50).otherwise(0) + F.when(side, 0).otherwise(25) + F.when(F.get(numbers, F.lit(0)).cast("int") >= 6, 20).otherwise(0)
            return F.when(F.size(numbers) > 0, F.struct((-weight).alias("minus"), p["pattern_no"].alias("idx"), m["start"].alias("start"), x["shown"].alias("shown"), numbers.alias("numbers")))

        return let(parts, weighed)

    def best_of(t: Column, pieces: Column) -> Column:
        one = lambda p: F.array_min(F.transform(all_matches(t["low"], p["rx"]), lambda m: judged(pieces, p, m)))
        return F.array_min(F.transform(_tried(t, _table({"pages": {"pages": c.PAGE}})), one))

    best = let(_both(F.col("text")), lambda t: let(F.regexp_extract_all(t["text"], F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0)), lambda pieces: best_of(t, pieces)))
    found = F.filter(F.array(best), lambda b: b.isNotNull())  # exploded, as a condition on it would compute it twice
    best = texts.where(F.col("text").isNotNull()).select(*keys, F.explode(found).alias("b")).groupBy(*keys).agg(F.min("b").alias("b")).select(*keys, "b.*")
    a, b = F.get("numbers", F.lit(0)), F.get("numbers", F.lit(1))
    low = F.lower("shown")
    is_range = F.regexp_like("shown", F.concat(F.lit(r"between\s+"), a, F.lit(r"\s+and\s+"), b, F.lit("|"), a, F.lit(r"\s+to\s+"), b, F.lit("|"), a, F.lit(r"\s*-\s*"), b))
    both = F.contains(low, F.lit("long papers")) & F.contains(low, F.lit("short papers")) & (F.size("numbers") >= 2)
    limit = F.when(both, F.concat(a, F.lit(" pages (long), "), b, F.lit(" pages (short)"))).when((F.size("numbers") == 2) & is_range, F.concat(a, F.lit("-"), b, F.lit(" pages"))).otherwise(F.concat(a, F.lit(" pages")))
    return best.select(*keys, limit.alias("main_limit"), F.col("shown").alias("evidence"), F.when(F.col("idx") < 7, "high").otherwise("medium").alias("confidence"))


def page_exclusions(limits: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, pages): what doesn't count to the limit, from the best match's words, else from the whole text."""
    ref, app, bound = c.OWN_REFERENCES, c.OWN_APPENDICES, c.OWN_BOUND
    low = F.lower("evidence")
    kind = F.when(F.startswith(F.regexp_extract(low, bound, 2), F.lit("ref")), "references").otherwise("appendices")
    entry = lambda k, p: F.struct(k.alias("kind"), p.alias("pages"))
    pages = F.concat(F.regexp_extract(low, bound, 1), F.lit(" pages"))
    taken = (low.rlike(ref) & (kind == "references")) | (low.rlike(app) & (kind == "appendices"))
    own = F.array_compact(
        F.array(F.when(low.rlike(ref), entry(F.lit("references"), F.lit("unlimited"))), F.when(low.rlike(app), entry(F.lit("appendices"), F.lit("unlimited"))), F.when(low.rlike(bound) & ~taken, entry(kind, pages)))
    )
    hits = _firsts(texts, keys, {kind: {kind: rxs} for kind, rxs in c.EXCLUSIONS.items()}).groupBy(*keys, F.col("field").alias("kind")).agg(F.min(F.struct("pattern_idx", "match"))["match"].alias("span"))
    number = F.regexp_extract("span", r"(?i)plus\s+(?:up\s+to\s+)?(\d+)\s+pages?", 1)
    outside = hits.groupBy(*keys).agg(F.collect_list(entry(F.col("kind"), F.when(number != "", F.concat(number, F.lit(" pages"))).otherwise("unlimited"))).alias("outside"))
    got = limits.select(*keys, own.alias("own")).join(outside, keys, "left")
    return got.select(*keys, F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("outside"))).alias("e")).select(*keys, "e.*")


def review_class(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, score, second, confidence, evidence): weighted matches of three labels; the first label of equals; unknown without a match."""

    def weight(m: Column) -> Column:
        strong = m.rlike(r"(?i)(double|single)[- ]blind\s+(review|process)") | m.rlike(r"(?i)open\s+(?:peer\s+)?review")
        return F.when(strong, 2.0).when(m.rlike("(?i)openreview"), 0.3).otherwise(1.0)

    own = lambda ms: F.aggregate(ms, F.lit(0.0), lambda s, m: s + weight(m))
    hits = texts.select(*keys, _found(F.col("text"), {"review": c.REVIEW}, 50, own).alias("hits")).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    ranked = let(F.col("hits"), lambda h: F.array_sort(F.transform(_scores(h), lambda x: F.struct((-x["score"]).alias("minus"), x["label_no"].alias("label_no"), x["label"].alias("label")))))
    rows = hits.select(*keys, ranked.alias("s"), _evidence(F.col("hits")).alias("evidence"))
    top, next_ = F.coalesce(-F.get("s", F.lit(0))["minus"], F.lit(0.0)), F.coalesce(-F.get("s", F.lit(1))["minus"], F.lit(0.0))
    confidence = F.when(top >= 3, "high").when((top == 2) & (next_ == 0), "medium").otherwise("low")
    label = F.coalesce(F.get("s", F.lit(0))["label"], F.lit("unknown"))
    return rows.select(*keys, label.alias("label"), top.alias("score"), next_.alias("second"), confidence.alias("confidence"), "evidence")


def first_label(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, policy, label): rebuttal, desk rejection and reciprocal review; the first label with any match."""
    hits = _firsts(texts, keys, {"rebuttal": c.REBUTTAL, "desk_rejection": c.DESK_REJECTION, "reciprocal_review": c.RECIPROCAL})
    return hits.groupBy(*keys, F.col("field").alias("policy")).agg(F.lower(F.min(F.struct("pattern_idx", "name"))["name"]).alias("label"))


def policy_class(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, policy, label, score, confidence, evidence): the label with most matches, the first of equals; disclosure wins for the model policy.

    A policy without a match is not_mentioned where that is one of its labels, else unknown.
    """
    policies = F.array(*[F.struct(F.lit(g).alias("policy"), F.lit("not_mentioned" if "not_mentioned" in labels else "unknown").alias("none")) for g, labels in c.POLICIES.items()])
    found = _found(F.col("text"), c.POLICIES, 30, lambda ms: F.size(ms).cast("double"), re.I | re.S)
    each = let(found, lambda hits: F.transform(policies, lambda x: F.struct(x["policy"].alias("policy"), x["none"].alias("none"), F.filter(hits, lambda h: h["grp"] == x["policy"]).alias("hits"))))
    rows = texts.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").groupBy(*keys, "policy", "none").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    wins = lambda x: (F.col("policy") == "llm_policy") & (x["label"] == "required_disclosure")
    best = let(F.col("hits"), lambda h: F.array_min(F.transform(_scores(h), lambda x: F.struct((~wins(x)).alias("w"), (-x["score"]).alias("minus"), x["label_no"].alias("label_no"), x["label"].alias("label"), x["score"].alias("score")))))
    rows = rows.select(*keys, "policy", "none", best.alias("b"), _evidence(F.col("hits")).alias("evidence"))
    score = F.coalesce(F.col("b.score"), F.lit(0)).cast("long")
    confidence = F.when(score == 0, "low").when(score >= 3, "high").otherwise("medium")
    return rows.select(*keys, "policy", F.coalesce("b.label", "none").alias("label"), score.alias("score"), confidence.alias("confidence"), "evidence")


def statements(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, types, confidence): the required statements in their order."""
    order = F.array_position(F.array(*map(F.lit, c.STATEMENTS)), F.col("field")).alias("o")
    hits = _firsts(texts, keys, {label: {label: rxs} for label, rxs in c.STATEMENTS.items()})
    lists = hits.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(order, "field"))).alias("s"))
    return lists.select(*keys, F.array_join(F.transform("s", lambda x: x["field"]), ",").alias("types"), F.when(F.size("s") >= 2, "high").otherwise("medium").alias("confidence"))


def logistics(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, template, supplementary, delivery, aid, workshops): first label of each, null where nothing matches."""
    groups = {"template": c.TEMPLATE, "supplementary": c.SUPPLEMENTARY, "delivery": c.DELIVERY, "aid": {"true": c.AID}, "workshops": {"true": c.WORKSHOPS}}
    hits = _firsts(texts, keys, groups)
    of = lambda g: F.min(F.when(F.col("field") == g, F.struct("pattern_idx", "name")))["name"].alias(g)
    return hits.groupBy(*keys).agg(*[of(g) for g in groups])


def presentation_formats(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, formats): oral, poster, demo, virtual, as the presentation patterns name them."""
    names = ("oral", "poster", "demo", "virtual")
    matches = lambda t: F.flatten(F.transform(_tried(t, _table({"p": {"p": c.PRESENTATION}})), lambda p: F.regexp_extract_all(t["low"], p["rx"], F.lit(0))))
    named = let(let(_both(F.col("text")), matches), lambda ms: F.when(F.size(ms) > 0, F.array(*[F.exists(ms, lambda m: F.contains(m, F.lit(w))) for w in names])))
    found = F.filter(F.array(named), lambda n: n.isNotNull())
    got = texts.where(F.col("text").isNotNull()).select(*keys, F.explode(found).alias("n")).groupBy(*keys).agg(*[F.max(F.get("n", F.lit(k))).alias(w) for k, w in enumerate(names)])
    return got.select(*keys, F.concat_ws(",", *[F.when(F.col(w), F.lit(w)) for w in names]).alias("formats"))


def tracks(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, track, confidence): the tracks that a text names; three make it sure."""
    hits = _firsts(texts, keys, {track: {track: rxs} for track, rxs in c.TRACKS.items()}).select(*keys, F.col("field").alias("track")).distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return hits.withColumn("confidence", F.when(n >= 3, "high").otherwise("medium"))


def legacy_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value): classifier results as rows of the field table; what isn't mentioned gives no row."""
    review = review_class(texts, keys).where("label <> 'unknown'")
    out = review.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("field"), (F.col("label") == x).cast("string").alias("value")) for x in c.REVIEW])).alias("x")).select(*keys, "x.*")
    out = out.union(page_limit(texts, keys).select(*keys, F.lit("page_limit").alias("field"), F.col("main_limit").alias("value")))
    out = out.union(policy_class(texts, keys).where("score > 0").select(*keys, F.col("policy").alias("field"), F.col("label").alias("value")))
    first = first_label(texts, keys)
    named = F.when(F.col("policy") == "rebuttal", "rebuttal_allowed").otherwise(F.col("policy"))
    value = F.when(F.col("policy") == "rebuttal", (F.col("label") == "allowed").cast("string")).when(F.col("policy") == "desk_rejection", (F.col("label") == "yes").cast("string")).otherwise(F.col("label"))
    out = out.union(first.select(*keys, named.alias("field"), value.alias("value")))
    return out.union(tracks(texts, keys).select(*keys, F.col("track").alias("field"), F.lit("true").alias("value")))
