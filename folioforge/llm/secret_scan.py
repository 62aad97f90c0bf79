"""Secret scans through a trigram inverted index; DataFrame functions only.

From each rule's regex a Boolean query of trigrams is derived (all trigrams of one of its mandatory strings). The index has a
posting (trigram, doc_id) for each trigram of the queries that a text holds, in lower case. Postings that meet a rule's query make
its candidates, whose whole texts are then scanned by the regex; rules without a mandatory string scan every text.

Positions come from the pieces between matches: a match starts behind all pieces and matches before it.

Defined cases: null is empty; rows without doc_id are candidates of every rule; rows that share a doc_id share its candidates and
are scanned each; rows repeat as they come; an empty table gives no rows; equal starts go by the order of the rules; texts of any
length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import marked, settle

@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 1  # signs of that group


#: The rules, the base kinds first, in the order of their listing.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = 3


def mandatory(regex: str) -> list[str] | None:
    """Strings in lower case of which every match holds at least one; None if there is no such list of strings of 3 signs or more.

    Each part of the parsed pattern gives the set of all strings that it matches, if there are few, and the sets of strings of which
    each match holds one. In a sequence neighbouring sets are multiplied until they get too large; what stands before the break is a
    mandatory set, and so are those of its parts. A choice needs one of each of its branches; what may be missing gives none.
    """
    from re import _parser as parser

    shortest = lambda strings: min(map(len, strings))

    def sequence(nodes) -> tuple[set[str] | None, list[set[str]]]:
        run, whole, found = {""}, True, []
        for op, arg in nodes:
            own, inner = part(str(op), arg)
            found += inner
            if own is None or len(run) * len(own) > 128:
                found.append(run)
                run, whole = own or {""}, False
            else:
                run = {a + b for a in run for b in own}
        return (run if whole else None), [*found, run]

    def part(op: str, arg) -> tuple[set[str] | None, list[set[str]]]:
        if op == "LITERAL":
            return {chr(arg).lower()}, []
        if op == "IN" and len(arg) <= 6 and all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(c).lower() for _, c in arg}, []
        if op == "SUBPATTERN":
            return sequence(arg[-1])
        if op == "BRANCH":
            branches = [sequence(b) for b in arg[1]]
            exact = None if any(e is None for e, _ in branches) else set().union(*(e for e, _ in branches))
            best = [max(found, key=shortest) for _, found in branches]
            return exact, [set().union(*best)]
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, nodes = arg
            exact, found = sequence(nodes)
            if low == 0:
                return (exact | {""} if exact is not None and high == 1 else None), []
            return (exact if low == high == 1 else None), found
        return ({""}, []) if op in ("AT", "ASSERT", "ASSERT_NOT") else (None, [])

    best = max(sequence(parser.parse(regex))[1], key=shortest)
    return sorted(s for s in best if not any(t != s and t in s for t in best)) if shortest(best) >= 3 else None


def trigrams(s: str) -> list[str]:
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams of the rules' queries."""
    text = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in vocabulary]))
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(held).alias("trigram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, list[str]]) -> DataFrame:
    """(doc_id, rules): postings intersected by document; a rule holds if all trigrams of one of its strings are there."""
    got = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    rules = []
    for kind, strings in queries.items():
        holds = [F.size(F.array_except(F.array(*map(F.lit, trigrams(s))), "held")) == 0 for s in strings]
        either = holds[0]
        for h in holds[1:]:
            either |= h
        rules.append(F.when(either, F.lit(kind)))
    return got.select("doc_id", F.array_compact(F.array(*rules)).alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, use) -> Column:
    """use(value), value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _running(sizes: Column, block: int = 256) -> Column:
    """Sums of an array up to each place, by blocks, so that many matches in a text cost no square."""

    def sums(blocks: Column, before: Column) -> Column:
        inside = lambda a, b: _let(_total(F.slice(before, 1, b)), lambda base: F.transform(a, lambda _, i: base + _total(F.slice(a, 1, i + 1))))
        return F.flatten(F.transform(blocks, inside))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, block))
    return _let(cut, lambda blocks: _let(F.transform(blocks, _total), lambda before: sums(blocks, before)))


def _spans(rule: Rule, number: int) -> Column:
    """Matches of a rule in text as structs (start, kind, stop), failing ones dropped."""
    text, pattern = F.col("text"), F.lit(rule.regex)

    def placed(matches: Column, pieces: Column, judged: Column) -> Column:
        size = lambda i: F.length(F.get(matches, i)).cast("long")
        steps = F.transform(matches, lambda _, i: F.length(F.get(pieces, i)).cast("long") + F.when(i > 0, size(i - 1)).otherwise(F.lit(0)))
        spans = lambda starts: F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.lit(number).alias("kind"), (s + size(i)).alias("stop"), F.length(F.get(judged, i)).alias("own")))
        got = _let(steps, lambda sizes: _let(_running(sizes), spans))
        return F.transform(F.filter(got, lambda s: s["own"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))

    own = lambda m: F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else m
    good = _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: _let(F.split(text, rule.regex, -1), lambda p: _let(own(m), lambda g: placed(m, p, g))))
    none = F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>")
    return F.when(text.rlike(rule.regex), good).otherwise(none)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with _spans: an array of (start, kind number, stop) of all rules, in that order."""
    queries = {r.kind: s for r in rules if (s := mandatory(r.regex))}
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    vocabulary = sorted({t for strings in queries.values() for s in strings for t in trigrams(s)})
    wanted = candidates(index(docs.select("doc_id", "text"), vocabulary), queries).select(F.col("doc_id").alias("_wanted"), F.col("rules").alias("_rules"))
    wanted = settle(wanted)
    # Only texts that may be candidates move to their rules; the others stay where they are.
    rows = marked(docs, wanted.select("_wanted"), "doc_id")
    near = rows.where("_hit").join(wanted, F.col("doc_id") == F.col("_wanted"), "left").drop("_wanted", "_hit")
    far = rows.where("not _hit").drop("_hit").withColumn("_rules", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>")
    found = []
    for number, rule in enumerate(rules):
        spans = _spans(rule, number)
        if rule.kind in queries:
            spans = F.when(F.coalesce(F.array_contains("_rules", rule.kind), F.lit(False)) | F.col("doc_id").isNull(), spans).otherwise(none)
        found.append(spans)
    scan = lambda part: part.withColumn("_spans", F.array_sort(F.concat(*found))).drop("_rules")
    return scan(near).unionByName(scan(far))


def secrets_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans, for each row of docs."""
    got = find_secrets(docs.select("doc_id", "text"), rules).select("doc_id", "_spans")
    names = F.array(*[F.lit(r.kind) for r in rules])
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    base = F.filter("_spans", lambda s: s["kind"] < BASE)
    of = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{rules[k].kind}") for k in range(BASE)]
    return got.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same digest in DuckDB SQL, by a plain scan."""
    parts = []
    for number, r in enumerate(rules):
        q = r.regex.replace("'", "''")
        parts.append(
            f"SELECT rid, {number} AS kind, '{r.kind}' AS name, unnest(range(1, len(m) + 1)) AS i, m, p, g FROM (SELECT rid, regexp_extract_all(text, '{q}', 0) AS m, "
            f"regexp_split_to_array(text, '{q}') AS p, regexp_extract_all(text, '{q}', {r.group}) AS g FROM docs) WHERE len(m) > 0"
        )
    least = "CASE kind " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules)) + " END"
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = {k}), 0)::BIGINT AS n_{rules[k].kind}" for k in range(BASE))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
spans AS (
  SELECT rid, kind, name, length(m[i]) AS size, length(g[i]) AS own,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM hits),
good AS (SELECT rid, kind, start::BIGINT AS start, name || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM spans WHERE own >= {least}),
agg AS (
  SELECT rid, {counts}, string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < {BASE}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM good GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{rules[k].kind}, 0) AS n_{rules[k].kind}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN agg USING (rid)"""
