"""The rule scan: corpora of text against ordered patterns, the first pattern of each field that matches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.regex import FLAGS, folded, java, java_of_folded, literals, sought
from folioforge.functions.text import let

#: Rows of a configuration table that may be broadcast.
MOST_ROWS = 20_000


def small(table: DataFrame) -> DataFrame:
    """A configuration table, broadcast if it is as small as such tables are; else joined as any other."""
    return F.broadcast(table) if table.limit(MOST_ROWS + 1).count() <= MOST_ROWS else table


def corpus(texts: DataFrame, keys: list[str], order: str = "source_key") -> DataFrame:
    """One text for each key: '=== name ===' and the text of each source in order, blank lines between; blank and [Empty] are left out."""
    part = F.concat(F.lit("=== "), F.col("source_key"), F.lit(" ===\n"), F.col("text"))
    full = F.col("text").rlike(r"\S") & ~F.col("text").rlike(r"^\s*\[Empty\]\s*$")  # judged where it is listed, as a filter would make each text once more
    # into a set number of parts: by their size, small when compressed, Spark would join them into few, each with much work for the patterns; each part costs some seconds of its own there
    spark = texts.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    lists = texts.repartition(parts, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(full, F.struct(F.col(order).alias("o"), part.alias("part"))))).alias("parts")).where(F.size("parts") > 0)
    return lists.select(*keys, F.array_join(F.transform("parts", lambda s: s["part"]), "\n\n").alias("text"))


def _compiled(patterns: list) -> dict[str, list[tuple[int, str, str, list[str], bool, list[str]]]]:
    """The patterns (field, number, name, regex) of each field in their order as (number, name, Java regex, literals, whether for folded text, what to seek first).

    They are configuration, MOST_ROWS at most, in Python's dialect; what that doesn't know is taken as Java's own.
    """
    out: dict[str, list] = {}
    for field, idx, name, regex in sorted(patterns, key=lambda r: (r[0], r[1])):
        try:
            low = java_of_folded(regex)
            rx, held, first = low or java(regex), literals(regex), sought(regex)
        except re.error:
            rx, held, low, first = FLAGS + regex, [], None, []
        out.setdefault(field, []).append((idx, name, rx, held, low is not None, first))
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern_scan(corpora: DataFrame, keys: list[str], fields: DataFrame, patterns: DataFrame, around: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(keys, field, pattern_idx, name, start, match): for each text and field the first pattern that matches, at its leftmost place.

    With around, also window: the match with so many signs before and behind it, by field, trimmed.

    Each field is one expression of its patterns, tried in order up to the first that matches; a pattern is tried only where the text
    holds the literals that all its matches hold, the longest with what must stand around them. So texts stay in their rows, and every pattern is compiled once. The expression stands
    in a function of higher order, which Spark interprets: hundreds of patterns don't fit into one generated method. It is written in SQL,
    as building so many columns one by one takes longer than the scan. A match starts behind what a split at its pattern leaves before it.
    """
    known = {r["field"] for r in small(fields).select("field").collect()}
    rows = patterns.select("field", "pattern_idx", "name", "regex").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a table of patterns holds {MOST_ROWS} at most")
    return scan_with(corpora, keys, [r for r in rows if r["field"] in known], around)


def scan_with(corpora: DataFrame, keys: list[str], patterns: list, around: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """pattern_scan() with a list of (field, pattern_idx, name, regex)."""
    tried = [(f, *p) for f, ps in _compiled(patterns).items() for p in ps]
    if not tried:
        return corpora.select(*keys, F.lit("").alias("field"), F.lit(0).alias("pattern_idx"), F.lit("").alias("name"), F.lit(0).alias("start"), F.lit("").alias("match"), *([] if around is None else [F.lit("").alias("window")])).limit(0)
    cases: dict[str, list[str]] = {}
    for n, (field, _, _, rx, held, low, first) in enumerate(tried):
        found = "".join(f"rlike(t.low, {_quoted(x)}) AND " for x in first) + f"rlike(t.{'low' if low else 'text'}, {_quoted(rx)})"
        cases.setdefault(field, []).append(f"WHEN {''.join(f'contains(t.low, {_quoted(x)}) AND ' for x in held)}{found} THEN {n}")
    firsts = ", ".join(f"CASE {' '.join(c)} END" for c in cases.values())
    one = F.array(F.struct(F.col("text").alias("text"), folded(F.col("text")).alias("low")))
    of = lambda k, kind=_quoted: f"element_at(array({', '.join(kind(p[k]) for p in tried)}), n + 1)"
    placed = f"transform(hits, n -> transform(array(struct({of(3)} AS rx, CASE WHEN {of(5, lambda x: str(x).lower())} THEN t.low ELSE t.text END AS seen)), s -> struct(n, char_length(split(s.seen, s.rx, 2)[0]) + 1 AS start, char_length(regexp_substr(s.seen, s.rx)) AS size))[0])"
    window = ""
    if around is not None:
        before, after = (f"element_at(array({', '.join(str(around.get(p[0], (0, 0))[k]) for p in tried)}), h.n + 1)" for k in (0, 1))
        begin = f"greatest(1, h.start - {before})"
        window = f", regexp_replace(substring(t.text, {begin}, h.start - {begin} + h.size + {after}), r'^\\s+|\\s+$', '') AS window"
    whole = f"transform(transform(one, t -> struct(t.text AS text, t.low AS low, array_compact(array({firsts})) AS hits)), t -> transform({placed.replace('(hits', '(t.hits')}, h -> struct(h.n, h.start, substring(t.text, h.start, h.size) AS match{window})))[0]"
    rows = corpora.select(*keys, one.alias("one")).select(*keys, F.explode(F.expr(whole)).alias("h")).select(*keys, "h.*")
    return rows.select(*keys, F.expr(of(0)).alias("field"), F.expr(of(1, str)).alias("pattern_idx"), F.expr(of(2)).alias("name"), "start", "match", *([] if around is None else ["window"]))


def all_matches(text: Column, regex: Column) -> Column:
    """array of (start, match), 1-based, of every non-overlapping match: a match starts behind all pieces and matches before it.

    Running sums go block by block, so that work grows with the matches and their square root, not their square.
    """

    def placed(found: Column) -> Column:
        both = F.zip_with(F.split(text, regex, -1), found, lambda p, m: F.struct(F.coalesce(F.length(p), F.lit(0)).alias("before"), m.alias("match")))
        return let(F.filter(both, lambda x: x["match"].isNotNull()), _placed)

    none = F.array().cast("array<struct<start: int, match: string>>")
    return let(F.regexp_extract_all(text, regex, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).when(found.isNotNull(), none))


def _placed(xs: Column) -> Column:
    """(before, match) in order to (start, match): the sum of all lengths so far, from sums of blocks of about the root of their number."""
    size = lambda x: x["before"] + F.length(x["match"])
    width = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), F.lit(1))

    def in_blocks(w: Column) -> Column:
        count = F.ceil(F.size(xs) / w).cast("int")
        numbers = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(numbers, lambda b: F.slice(xs, b * w + 1, w))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + size(x)))
        return let(sums, lambda t: F.flatten(F.transform(blocks, lambda b, k: _within(b, F.aggregate(F.slice(t, 1, k), F.lit(0), lambda s, x: s + x)))))

    def _within(block: Column, base: Column) -> Column:
        return let(base, lambda z: F.transform(block, lambda x, i: F.struct((z + F.aggregate(F.slice(block, 1, i), F.lit(0), lambda s, y: s + size(y)) + x["before"] + 1).alias("start"), x["match"].alias("match"))))

    return let(width, in_blocks)
