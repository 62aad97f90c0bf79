"""Queries of the rule scan, the classifiers, values and merging, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import classifier_patterns as cp
from folioforge.functions import dates as dt
from folioforge.functions import rules as rv
from folioforge.functions import text as t
from folioforge.functions.patterns import FIELDS, fields_table, patterns_table
from folioforge.functions.text import let
from folioforge.operators import classify, merge, requirements, scan
from folioforge.plans.views import MAPPED, POLICY, RULES, _values
from folioforge.sources.shared import settle
from folioforge.sources.tables import feed, policy_text, second_feed, table

KEYS = ["entity", "year"]


def corpora(spark: SparkSession, d: str) -> DataFrame:
    return scan.corpus(policy_text(spark, d), KEYS)


def scanned(spark: SparkSession, d: str) -> DataFrame:
    return scan.pattern_scan(corpora(spark, d), KEYS, fields_table(spark), patterns_table(spark))


def typed_of(texts: DataFrame, fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """(keys, field, match, value): each field's handler by its type; keywords, labels and cleaners come from the table of fields."""
    m, c = F.col("match"), F.col("cleaner")
    known = fields.select("field", "type", "cleaner", "positive", "negative", "allowed", "is_range", "is_place")
    words = sorted({w for r in scan.small(fields).select("positive").collect() for w in r["positive"] or []})
    denied = let(F.lower("text"), lambda low: F.transform(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.struct(w, t.negated_low(low, w))))
    denials = texts.select(*KEYS, F.map_from_entries(denied).alias("denied"))  # so that no text leaves its row
    found = scan.pattern_scan(texts, KEYS, fields, patterns).join(denials, KEYS).join(scan.small(known), "field")
    place = let(rv.string_value(m), lambda v: F.when(rv.valid_location(v), v).otherwise("unknown"))
    value = (
        F.when(F.col("type") == "boolean", rv.boolean_of(m, F.col("name"), F.col("positive"), F.col("negative"), lambda word: F.col("denied")[word]).cast("string"))
        .when(F.col("type") == "date", rv.date_value(m, c, F.col("is_range"))).when(F.col("type") == "enum", rv.enum_value(m, F.col("allowed"), c))
        .when(F.col("type") == "list", F.array_join(rv.HANDLERS["list"](m), "; ")).when(F.col("type") == "number", rv.number_value(m))
        .when(F.col("is_place"), place).when(c.isNotNull(), rv.cleaned(c, m)).otherwise(rv.string_value(m))
    )
    return found.select(*KEYS, "field", "match", value.alias("value"))


def typed(spark: SparkSession, d: str) -> DataFrame:
    return typed_of(settle(corpora(spark, d)), fields_table(spark), patterns_table(spark))


def rules(spark: SparkSession, d: str, texts: DataFrame | None = None) -> DataFrame:
    """A row for every key and field, from texts if these stand settled already."""
    texts = settle(corpora(spark, d)) if texts is None else texts
    got = merge.default_fill(settle(typed_of(texts, fields_table(spark), patterns_table(spark))), texts.select(*KEYS), fields_table(spark))
    kinds = scan.small(fields_table(spark).select("field", "type"))
    return got.join(kinds, "field").select(*KEYS, "field", "category", "type", "priority", "value", F.coalesce("match", F.lit("")).alias("evidence"))


def feed_rows(spark: SparkSession, d: str, which: int = 1) -> DataFrame:
    """(keys, field, value): the mapped fields of the first or the second feed."""
    rows = feed(spark, d) if which == 1 else second_feed(spark, d)
    pairs = F.explode(F.array(*[F.struct(F.lit(m[0]).alias("field"), F.col(m[which]).alias("value")) for m in MAPPED if m[which]]))
    return rows.select(*KEYS, pairs.alias("p")).select(*KEYS, "p.*").where("value is not null")


def merged(spark: SparkSession, d: str) -> DataFrame:
    base = rules(spark, d)
    feeds = [("feed", feed_rows(spark, d)), ("feed2", feed_rows(spark, d, 2))]
    return merge.with_feeds(base.select(*KEYS, "field", "value"), KEYS, feeds).join(scan.small(fields_table(spark).select("field", "category")), "field")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpora(spark, d)


def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    return scanned(spark, d).select(*KEYS, "field", "pattern_idx", "name", F.col("start").cast("long").alias("start"), "match")


def default_fill(spark: SparkSession, d: str) -> DataFrame:
    return rules(spark, d)


#: The year that stale dates are judged from.
_AS_OF = 1996


def _of_kind(kind: str) -> list[str]:
    return [f for f, _, k, *_ in FIELDS if k == kind]


def rule_number(spark: SparkSession, d: str) -> DataFrame:
    """Page limits as numbers within bounds."""
    return typed(spark, d).where("field = 'page_limit'").select(*KEYS, rv.number_value(F.col("match"), 7, 11).alias("value"))


def stale_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of the rules, unknown where they are long past."""
    return typed(spark, d).where(F.col("field").isin(*_of_kind("date"))).select(*KEYS, "field", rv.not_stale(F.col("value"), _AS_OF).alias("value"))


def locations(spark: SparkSession, d: str) -> DataFrame:
    """The places of the rules, normalised to city and country."""
    places = typed(spark, d).where("field = 'conference_location' and value <> 'unknown'")
    return places.select(*KEYS, rv.location(F.col("value")).alias("l")).select(*KEYS, "l.city", "l.country")


def known_modes(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field count as known, by each meaning of the word."""
    modes = ("quality", "report", "site", "display")
    return rules(spark, d).groupBy("field").agg(*[F.count_if(rv.is_known(F.col("value"), m)).alias(m) for m in modes])


def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of dates in one form, and whether they look like ranges."""
    o = F.col("o_orderdate")
    month, day, year = dt.month_name(F.month(o)), F.dayofmonth(o).cast("string"), F.year(o).cast("string")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(month, F.lit(" "), day, F.lit(" – 31, "), year)).when(k == 1, F.concat(month, F.lit(" "), day, F.lit(" through June 3, "), year))
        .when(k == 2, F.concat(F.lit("available at "), month, F.lit(" "), day, F.lit(", "), year)).otherwise("at the lake")
    )
    return table(spark, d, "orders").select("o_orderkey", rv.date_range(text).alias("range")).select("o_orderkey", "range", rv.valid_date_range(F.col("range")).alias("valid"))


def _typed_of(*fields: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return typed(spark, d).where(F.col("field").isin(*fields)).select(*KEYS, "field", "value")

    return run


def evidence(spark: SparkSession, d: str) -> DataFrame:
    got = scanned(spark, d).join(corpora(spark, d), KEYS)
    return got.select(*KEYS, "field", t.evidence(F.col("text"), F.col("start"), F.col("start") + F.length("match")).alias("evidence"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return corpora(spark, d).select(*KEYS, F.array_join(t.snippets(F.col("text"), "deadline", 3, 20), "~").alias("snippets"))


def negation(spark: SparkSession, d: str) -> DataFrame:
    return policy_text(spark, d).groupBy(t.negated(F.col("text"), "allowed").alias("negated"), t.negated(F.col("text"), "rebuttal").alias("rebuttal_negated")).agg(F.count(F.lit(1)).alias("n"))


def cleaners(spark: SparkSession, d: str) -> DataFrame:
    texts = ["10 megabytes", "eight-page papers", "openreview", "Published in the Proceedings of Machine Learning Research", "submission deadline Feb 14, 2025 AOE", "artifacts must submit", "ChatGPT is not allowed", "between 6 and 9 pages"]
    names = ["file_size", "page_count", "system_name", "venue", "deadline", "artifact", "model_policy", "page_number"]
    k = (F.col("p_partkey") % 8 + 1).cast("int")
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, texts)), k).alias("v"), F.element_at(F.array(*map(F.lit, names)), k).alias("c"))
    return rows.select("p_partkey", "c", rv.cleaned(F.col("c"), F.col("v")).alias("value"))


_DATE = "o_orderdate"


def _six(k):
    o = F.col(_DATE)
    day, year = F.dayofmonth(o).cast("string"), F.year(o).cast("string")
    month = dt.month_name(F.month(o))
    short = F.substring(month, 1, 3)
    return (
        F.when(k == 0, F.concat(short, F.lit(" "), day, F.lit(", "), year, F.lit(" AOE"))).when(k == 1, F.concat(day, F.lit(" "), short, F.lit(" "), year)).when(k == 2, F.date_format(o, "yyyy-MM-dd"))
        .when(k == 3, F.date_format(o, "MM/dd/yyyy")).when(k == 4, F.concat(month, F.lit(" "), day)).otherwise(F.concat(day, F.lit(" "), month))
    )


def date_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", _six(F.col("o_orderkey") % 6).alias("v"), F.year(_DATE).alias("y"))
    return rows.select("o_orderkey", dt.normal_date(F.col("v"), F.col("y")).alias("date"))


def format_deadline(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format(_DATE, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", dt.format_deadline(stamp).alias("deadline"))


def short_date(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", _six(F.col("o_orderkey") % 6).alias("v"))
    return rows.select("o_orderkey", dt.short_date(F.col("v"), F.lit("2025-06-15").cast("date")).alias("shown"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 8
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = (
        F.when(k == 0, F.concat(F.lit("Vancouver Convention Center, Town"), k.cast("string"), F.lit(", "), "n_name")).when(k == 1, "Rome, Italy").when(k == 2, "San Diego, California").when(k == 3, "Austin, TX").when(k == 4, "Singapore")
        .when(k == 5, "Hong Kong SAR").when(k == 6, "Denver, Colorado, USA").otherwise(F.concat(F.lit("City"), F.col("n_nationkey").cast("string"), F.lit(", "), "n_name"))
    )
    return rows.select("c_custkey", raw.alias("raw"), k.alias("k"), "n_name", "n_nationkey")


def location(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("c_custkey", rv.location(F.col("raw")).alias("l")).select("c_custkey", "l.*")


def location_valid(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("c_custkey", rv.valid_location(F.col("raw")).alias("valid"))


def feed_join(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select(*KEYS, "field", "value", "source", "conflict")


def override(spark: SparkSession, d: str) -> DataFrame:
    texts = settle(corpora(spark, d))
    return merge.override(rules(spark, d, texts), classify.legacy_rows(texts, KEYS), KEYS)


def page_limit(spark: SparkSession, d: str) -> DataFrame:
    return classify.page_limit(settle(corpora(spark, d)), KEYS)


def page_exclusions(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(corpora(spark, d))
    return classify.page_exclusions(classify.page_limit(rows, KEYS), rows, KEYS)


def review_class(spark: SparkSession, d: str) -> DataFrame:
    return classify.review_class(policy_text(spark, d), ["source_key"])


def first_label(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("year") % 2 == 0, " Rebuttals are allowed. Papers may be desk rejected.").otherwise(" No rebuttals. Reciprocal reviewing applies.")
    return classify.first_label(corpora(spark, d).withColumn("text", F.concat("text", more)), KEYS)


def policy_class(spark: SparkSession, d: str) -> DataFrame:
    return classify.policy_class(settle(corpora(spark, d)), KEYS)


def _requirements(spark: SparkSession, d: str) -> DataFrame:
    """Corpora with a sentence on statements, template or format for each, so that these classifiers have their words."""
    more = [
        "Papers must include an ethics statement and a broader impact statement is required.", "LaTeX template is required; supplementary material is allowed (50 MB). A hybrid conference.",
        "Oral presentations and poster presentations. Travel grants are available. Co-located workshops.", "Call for demos, call for posters, best paper award.",
    ]
    return corpora(spark, d).withColumn("text", F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, more)), (F.col("year") % 4 + 1).cast("int"))))


def statements(spark: SparkSession, d: str) -> DataFrame:
    return classify.statements(_requirements(spark, d), KEYS)


def logistics(spark: SparkSession, d: str) -> DataFrame:
    return classify.logistics(_requirements(spark, d), KEYS)


def presentation_formats(spark: SparkSession, d: str) -> DataFrame:
    return classify.presentation_formats(_requirements(spark, d), KEYS)


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return classify.tracks(_requirements(spark, d), KEYS)


def extractor_histogram(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.operators.reports import histogram

    return histogram(classify.policy_class(settle(corpora(spark, d)), KEYS), ["policy", "label", "confidence"])


def legacy_rows(spark: SparkSession, d: str) -> DataFrame:
    return classify.legacy_rows(settle(corpora(spark, d)), KEYS)


def batch_pack(spark: SparkSession, d: str) -> DataFrame:
    return merge.pack_batches(table(spark, d, "conversations").where("text is not null"), ["conv_id"], "turn", 2000)


def llm_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    response = F.when(k % 10 == 0, "no json").otherwise(F.concat(F.lit('{"double_blind": "'), F.element_at(F.array(*map(F.lit, ["Yes", "no", "null", "blind"])), (k % 4 + 1).cast("int")), F.lit('", "page_limit": {"value": "'), (k % 9).cast("string"), F.lit(' pages", "evidence": "up to"}}')))
    rows = table(spark, d, "events").select("event_id", (k % 3 + 1).alias("batch"), response.alias("response"))
    return merge.parse_answers(rows, ["event_id"])


#: Answers of every kind for a boolean field: what a model wrote, what it means, and what is refused.
_SAID = [("true", "true", None), ("false", "false", None), ('"Yes"', "true", None), ('"maybe"', None, '"maybe"'), ("1", "true", None), ("null", None, None), ('" NULL "', None, '" NULL "'), ('{"value": "no", "evidence": "a **b**"}', "false", None)]


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer for each event: some no JSON, some no object, some none, others with a boolean, a list, a number and a field that nobody asked for."""
    k = F.col("event_id")
    said = F.element_at(F.array(*[F.lit(x) for x, *_ in _SAID]), (k % len(_SAID) + 1).cast("int"))
    formats = F.when(k % 3 == 0, '["oral", "poster"]').when(k % 3 == 1, '"unknown"').otherwise('{"value": ["demo"], "evidence": null}')
    extra = F.when(k % 5 == 0, ', "weather": "fine"').otherwise("")
    whole = F.concat(F.lit('{"double_blind": '), said, F.lit(', "presentation_formats": '), formats, F.lit(', "page_limit": {"value": '), (k % 9).cast("string"), F.lit(', "evidence": "up to | it"}'), extra, F.lit("}"))
    response = F.when(k % 20 == 0, "no json").when(k % 20 == 1, "[1]").when(k % 20 != 2, whole)
    return table(spark, d, "events").select("event_id", (k % 3 + 1).alias("batch"), response.alias("response"))


def llm_typed(spark: SparkSession, d: str) -> DataFrame:
    return merge.typed_answers(_answers(spark, d), ["event_id"], fields_table(spark))


def llm_rejects(spark: SparkSession, d: str) -> DataFrame:
    return merge.answer_rejects(_answers(spark, d), ["event_id"], fields_table(spark))


def llm_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each user's merged answers."""
    users = table(spark, d, "events").where("user_id is not null").select("event_id", "user_id")
    answers = merge.typed_answers(_answers(spark, d), ["event_id"], fields_table(spark)).join(users, "event_id")
    one = answers.groupBy("user_id", "batch", "field").agg(F.max("value").alias("value"))
    return merge.answer_quality(merge.merge_batches(one, ["user_id"]), ["user_id"], fields_table(spark))


def _answers_sql() -> str:
    """ta: the typed answers; tr: the rejects."""
    quoted = lambda x: "NULL" if x is None else "'" + x + "'"
    pick = lambda n: f"[{', '.join(quoted(x[n]) for x in _SAID)}][event_id % {len(_SAID)} + 1]"
    seen = f"CASE WHEN event_id % {len(_SAID)} = 7 THEN 'a b' ELSE '' END"
    return (
        f"ev AS (SELECT event_id, event_id % 3 + 1 AS batch FROM events), good AS (SELECT * FROM ev WHERE event_id % 20 > 2), ta AS (SELECT * FROM (SELECT event_id, batch, 'double_blind' AS field, {pick(1)} AS value, {seen} AS evidence FROM good "
        "UNION ALL SELECT event_id, batch, 'presentation_formats', CASE event_id % 3 WHEN 0 THEN 'oral; poster' WHEN 2 THEN 'demo' END, '' FROM good UNION ALL SELECT event_id, batch, 'page_limit', (event_id % 9)::VARCHAR, 'up to, it' FROM good) WHERE value IS NOT NULL), "
        "tr AS (SELECT event_id, batch, NULL AS field, CASE event_id % 20 WHEN 0 THEN 'no json' WHEN 1 THEN '[1]' END AS raw, CASE event_id % 20 WHEN 0 THEN 'no JSON' WHEN 1 THEN 'no object' ELSE 'no answer' END AS reason FROM ev WHERE event_id % 20 <= 2 "
        f"UNION ALL SELECT event_id, batch, 'weather', '\"fine\"', 'unknown field' FROM good WHERE event_id % 5 = 0 UNION ALL SELECT event_id, batch, 'double_blind', {pick(2)}, 'no boolean' FROM good WHERE event_id % {len(_SAID)} = 3)"
    ).replace('\\"', '"').replace('\"', '"')


def llm_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, d, "events").where("user_id is not null").select("user_id", (k % 3 + 1).alias("batch"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("field"), F.concat(F.lit("v"), (k % 7).cast("string")).alias("value"))
    one = rows.groupBy("user_id", "batch", "field").agg(F.max("value").alias("value"))
    return merge.merge_batches(one, ["user_id"])


def clean_evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", merge.clean_evidence(F.concat(F.lit("**"), F.regexp_replace("text", r"[^A-Za-z0-9 |]", ""), F.lit("**"))).alias("evidence"))


def feed_text(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).select(*KEYS, merge.feed_text(F.col("entity"), [("deadline", F.col("deadline")), ("place", F.col("place")), ("link", F.lit(None).cast("string"))]).alias("text"))


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    header = "Fields:\n" + "\n".join(f"- {f} ({t_})" for f, _, t_, *_ in FIELDS)
    return corpora(spark, d).select(*KEYS, F.md5(merge.prompt_text(header, F.col("text"))).alias("prompt_md5"))


def clean_feed_nfkc(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # Python's memory then doesn't grow with long texts
    return table(spark, d, "documents").select("doc_id", t.nfkc(F.concat(F.lit("ﬁ"), "text")).alias("text"))


def _labels(groups: dict) -> str:
    rows = [(str(g), str(label), k, n, rx) for g, labels in groups.items() for k, (label, ps) in enumerate(labels.items()) for n, rx in enumerate(ps)]
    return _values(rows, "grp, label, label_no, pattern_no, rx")


_CORP = RULES
_SIX = (
    "CASE o_orderkey % 6 WHEN 0 THEN left(m, 3) || ' ' || dd || ', ' || yy || ' AOE' WHEN 1 THEN dd || ' ' || left(m, 3) || ' ' || yy WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN m || ' ' || dd ELSE dd || ' ' || m END"
)
_ORD = "(SELECT o_orderkey, o_orderdate, day(o_orderdate) AS dd, year(o_orderdate) AS yy, month(o_orderdate) AS mm, ['January','February','March','April','May','June','July','August','September','October','November','December'][month(o_orderdate)] AS m FROM orders)"
_MORE = "['Papers must include an ethics statement and a broader impact statement is required.', 'LaTeX template is required; supplementary material is allowed (50 MB). A hybrid conference.', 'Oral presentations and poster presentations. Travel grants are available. Co-located workshops.', 'Call for demos, call for posters, best paper award.']"
_REQ = _CORP + f", req AS (SELECT entity, year, text || ' ' || {_MORE}[year % 4 + 1] AS text FROM corp)"
_REVIEW_W = "CASE WHEN regexp_matches(m, '(?i)(double|single)[- ]blind\\s+(review|process)') THEN 2.0 WHEN regexp_matches(m, '(?i)open\\s+(?:peer\\s+)?review') THEN 2.0 WHEN contains(lower(m), 'openreview') THEN 0.3 ELSE 1.0 END"
_PLACE = "CASE c_custkey % 8 WHEN 0 THEN 'Vancouver Convention Center, Town0, ' || n_name WHEN 1 THEN 'Rome, Italy' WHEN 2 THEN 'San Diego, California' WHEN 3 THEN 'Austin, TX' WHEN 4 THEN 'Singapore' WHEN 5 THEN 'Hong Kong SAR' WHEN 6 THEN 'Denver, Colorado, USA' ELSE 'City' || n_nationkey || ', ' || n_name END"
_TITLE = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_NATION = f"CASE n_name WHEN 'UNITED STATES' THEN 'US' WHEN 'UNITED KINGDOM' THEN 'UK' ELSE {_TITLE} END"
_WHERE = "contains({0}, 'authors') OR contains({0}, 'for') OR contains({0}, 'the')"


def _windows_sql(around: int) -> str:
    """The first two matches m of text, of which p are the pieces between, with so many signs around them."""
    one = []
    for i in (1, 2):
        start = f"(list_sum(list_transform(p[1:{i}], lambda x: length(x))) + {'length(m[1])' if i == 2 else '0'} + 1)::INT"
        begin = f"greatest(1, {start} - {around})"
        one.append(f"CASE WHEN len(m) >= {i} THEN regexp_replace(substring(text, {begin}, {start} - {begin} + length(m[{i}]) + {around}), '^\\s+|\\s+$', '', 'g') END")
    return f"list_filter([{', '.join(one)}], lambda x: x IS NOT NULL)"


_EVIDENCE = "array_to_string(flatten(list(w ORDER BY label_no, pattern_no))[1:2], '; ')"
_NONE = _values([(g, "not_mentioned" if "not_mentioned" in labels else "unknown") for g, labels in cp.POLICIES.items()], "policy, none")
_POLICY_SCORES = (
    f"pm AS (SELECT entity, year, grp AS policy, label, label_no, pattern_no, text, regexp_extract_all(text, '(?is)' || rx) AS m, regexp_split_to_array(text, '(?is)' || rx) AS p FROM corp, {_labels(cp.POLICIES)} WHERE regexp_matches(text, '(?is)' || rx)), "
    f"pw AS (SELECT *, {_windows_sql(30)} AS w FROM pm), pe AS (SELECT entity, year, policy, {_EVIDENCE} AS evidence FROM pw GROUP BY 1, 2, 3), ps AS (SELECT entity, year, policy, label, label_no, sum(len(m)) AS score FROM pm GROUP BY ALL), "
    "pb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, year, policy ORDER BY (policy = 'llm_policy' AND label = 'required_disclosure') DESC, score DESC, label_no) AS r FROM ps) WHERE r = 1), "
    f"pc AS (SELECT entity, year, policy, coalesce(label, none) AS label, coalesce(score, 0)::BIGINT AS score, CASE WHEN score IS NULL THEN 'low' WHEN score >= 3 THEN 'high' ELSE 'medium' END AS confidence, coalesce(evidence, '') AS evidence FROM corp CROSS JOIN {_NONE} LEFT JOIN pb USING (entity, year, policy) LEFT JOIN pe USING (entity, year, policy))"
)
_FIRST = f"fl AS (SELECT entity, year, grp AS policy, lower(arg_min(label, label_no)) AS label FROM (SELECT entity, year, text || CASE WHEN year % 2 = 0 THEN ' Rebuttals are allowed. Papers may be desk rejected.' ELSE ' No rebuttals. Reciprocal reviewing applies.' END AS text FROM corp), {_labels({'rebuttal': cp.REBUTTAL, 'desk_rejection': cp.DESK_REJECTION, 'reciprocal_review': cp.RECIPROCAL})} WHERE regexp_matches(text, '(?i)' || rx) GROUP BY 1, 2, 3)"
def _typed_sql(*fields: str) -> str:
    return RULES + f" SELECT entity, year, field, value FROM typed WHERE field IN ({', '.join(map(repr, fields))})"


def requirement_struct(spark: SparkSession, d: str) -> DataFrame:
    """The typed row of each text, flattened."""
    got = requirements.requirements(_requirements(spark, d), KEYS)
    s, g = F.col("r.submission"), F.col("r.logistics")
    return got.select(
        *KEYS, s["template"].alias("template"), s["details"].alias("details"), s["supplementary"].alias("supplementary"), s["limits"].alias("limits"), s["evidence"].alias("submission_evidence"), s["confidence"].alias("submission_confidence"),
        F.array_join(g["formats"], ",").alias("formats"), g["aid"].alias("aid"), g["workshops"].alias("workshops"), g["delivery"].alias("delivery"), g["evidence"].alias("logistics_evidence"), g["confidence"].alias("logistics_confidence"),
        F.array_join("r.tracks.names", ",").alias("tracks"), F.col("r.tracks.confidence").alias("tracks_confidence"), F.array_join("r.statements.types", ",").alias("statements"), F.col("r.statements.confidence").alias("statements_confidence"),
    )


def requirement_rows(spark: SparkSession, d: str) -> DataFrame:
    texts = settle(_requirements(spark, d))
    excluded = classify.page_exclusions(classify.page_limit(texts, KEYS), texts, KEYS)
    return requirements.requirement_rows(requirements.requirements(texts, KEYS), KEYS, excluded)


def extractor_distributions(spark: SparkSession, d: str) -> DataFrame:
    return requirements.distributions(requirements.extractor_results(settle(_requirements(spark, d)), KEYS), KEYS)


def _distributions_sql() -> str:
    over = lambda sql: sql.replace("FROM corp", "FROM req").replace(" corp,", " req,").replace("corp USING", "req USING")
    known = lambda v: f"coalesce({v}::VARCHAR, 'unknown')"
    some = [
        ("submission", "template", known("template"), "se", 1, 99), ("submission", "supplementary", known("supplementary"), "se", 1, 99), ("logistics", "formats", "CASE WHEN len(formats) > 0 THEN array_to_string(formats, ',') ELSE 'unknown' END", "ge", 1, 99),
        ("logistics", "aid", "CASE WHEN aid THEN 'true' ELSE 'unknown' END", "ge", 1, 99), ("logistics", "workshops", "CASE WHEN workshops THEN 'true' ELSE 'unknown' END", "ge", 1, 99), ("logistics", "delivery", known("delivery"), "ge", 1, 99),
        ("statements", "statements", "CASE WHEN len(types) > 0 THEN array_to_string(types, ',') ELSE 'unknown' END", "types", 1, 2), *[("tracks", t_, f"CASE WHEN list_contains(tracks, '{t_}') THEN 'true' ELSE 'unknown' END", "tracks", 1, 3) for t_ in cp.TRACKS],
    ]
    rest = " UNION ALL ".join(f"SELECT entity, year, '{e}', '{f}', {v}, CASE WHEN len({x}) >= {high} THEN 'high' WHEN len({x}) >= {least} THEN 'medium' ELSE 'low' END FROM rq JOIN ff USING (entity, year)" for e, f, v, x, least, high in some)
    review = _review_sql("req", "entity, year").replace("rq AS", "rvq AS").replace("FROM rq", "FROM rvq")
    return (
        f"{_REQ}, {_requirements_sql()}, {over(_LIMITS).replace('pm AS', 'pgm AS').replace('FROM pm)', 'FROM pgm)').replace('pi AS', 'pgi AS').replace('FROM pi)', 'FROM pgi)').replace('pw AS', 'pgw AS').replace('FROM pw)', 'FROM pgw)')}, {over(_POLICY_SCORES)}, {review}, "
        "sr AS (SELECT entity, year, list(score ORDER BY score DESC) AS s FROM rs GROUP BY 1, 2), "
        "results(entity, year, extractor, field, value, confidence) AS (SELECT entity, year, 'review', 'review', coalesce(label, 'unknown'), CASE WHEN s[1] >= 3 THEN 'high' WHEN s[1] = 2 AND coalesce(s[2], 0) = 0 THEN 'medium' ELSE 'low' END FROM req LEFT JOIN rr USING (entity, year) LEFT JOIN sr USING (entity, year) "
        "UNION ALL SELECT entity, year, 'pages', 'page_limit', coalesce(main_limit, 'unknown'), coalesce(confidence, 'low') FROM req LEFT JOIN pl USING (entity, year) UNION ALL SELECT entity, year, 'policies', policy, label, confidence FROM pc "
        f"UNION ALL {rest}), marked AS (SELECT *, value NOT IN ('unknown', '', 'not_mentioned') AS known FROM results) "
        "SELECT extractor, CASE grouping_id(extractor, field, value, confidence) WHEN 1 THEN 'value' WHEN 6 THEN 'confidence' WHEN 3 THEN 'field' ELSE 'extractor' END AS level, field, value, confidence, count(*) AS n, count(*) FILTER (WHERE known) AS known, count(DISTINCT CASE WHEN known THEN entity || '/' || year END) AS texts "
        "FROM marked GROUP BY GROUPING SETS ((extractor, field, value), (extractor, confidence), (extractor, field), (extractor))"
    )


def _requirements_sql() -> str:
    """fh: each group's first hit with its window; rq: the typed row of each text."""
    window = requirements._windows()
    table = _values([(g, n, label, f"(?i){rx}", *window[g]) for g, n, label, rx in requirements.groups()], "grp, n, label, rx, before, after")
    of = lambda g, col="win": f"max(CASE WHEN grp = '{g}' THEN {col} END)"
    listed = lambda gs, col="win": f"list_filter([{', '.join(of(g, col) for g in gs)}], lambda x: x IS NOT NULL)"
    statements = {s: [requirements._statement(s, k) for k in range(len(rxs))] for s, rxs in cp.STATEMENTS.items()}
    types = ", ".join(f"CASE WHEN count(*) FILTER (WHERE grp IN ({', '.join(map(repr, gs))})) > 0 THEN '{s}' END" for s, gs in statements.items())
    formats = " || ".join(f"regexp_extract_all(lower(text), '{rx}')" for rx in cp.PRESENTATION)
    at = lambda w, k: f"list_min(list_transform(range(len(fm)), lambda i: CASE WHEN contains(fm[i + 1], '{w}') THEN i * 4 + {k} END))"
    named = ", ".join(f"{{'at': {at(w, k)}, 'name': '{w}'}}" for k, w in enumerate(("oral", "poster", "demo", "virtual")))
    return (
        f"groups AS (SELECT * FROM {table}), "
        "fg AS (SELECT entity, year, grp, text, arg_min(label, n) AS label, arg_min(rx, n) AS rx, any_value(before) AS before, any_value(after) AS after FROM req, groups WHERE regexp_matches(text, rx) GROUP BY ALL), "
        "fp2 AS (SELECT *, regexp_extract(text, rx) AS match, length(string_split_regex(text, rx)[1]) + 1 AS start FROM fg), "
        r"fh AS (SELECT *, regexp_replace(substring(text, greatest(1, start - before), start - greatest(1, start - before) + length(match) + after), '^\s+|\s+$', '', 'g') AS win FROM fp2), "
        f"ff AS (SELECT entity, year, list_transform(list_sort(list_filter([{named}], lambda x: x.at IS NOT NULL)), lambda x: x.name) AS formats FROM (SELECT entity, year, {formats} AS fm FROM req)), "
        f"rq AS (SELECT entity, year, {of('template', 'label')} = 'required' AS template, {of('template', 'match')} AS details, {of('supplementary', 'label')} = 'allowed' AS supplementary, "
        rf"nullif(regexp_extract({of('supplementary')}, '(?i)(\d+)\s*(?:MB|GB|pages?)'), '') AS limits, {listed(['template', 'supplementary'])} AS se, {of('aid', 'label')} IS NOT NULL AS aid, {of('workshops', 'label')} IS NOT NULL AS workshops, {of('delivery', 'label')} AS delivery, "
        f"{listed(['aid', 'delivery'])} AS ge, {listed(cp.TRACKS, 'label')} AS tracks, {listed(cp.TRACKS)} AS te, list_filter([{types}], lambda x: x IS NOT NULL) AS types, {listed([g for gs in statements.values() for g in gs])} AS me FROM req LEFT JOIN fh USING (entity, year) GROUP BY 1, 2)"
    )


_CONFIDENT = "CASE WHEN len({0}) >= {1} THEN 'high' WHEN len({0}) >= 1 THEN 'medium' ELSE 'low' END"


def _requirement_rows_sql() -> str:
    joined = lambda x, n: f"array_to_string({x}[1:{n}], '; ')"
    values = {
        "template_required": ("template::VARCHAR", f"coalesce(details, {joined('se', 2)})"), "supplementary_material": ("supplementary::VARCHAR", f"concat_ws('. ', limits, nullif({joined('se', 2)}, ''))"),
        "presentation_format": ("CASE WHEN len(formats) > 0 THEN array_to_string(formats, ', ') END", joined("ge", 2)), "financial_aid": ("CASE WHEN aid THEN 'true' END", joined("ge", 2)), "workshops": ("CASE WHEN workshops THEN 'true' END", joined("ge", 2)),
        "conference_format": ("delivery", joined("ge", 2)), "statements": ("CASE WHEN len(types) > 0 THEN 'true' END", f"'Required statements: ' || array_to_string(types, ', ') || '. ' || CASE WHEN len(types) >= 2 THEN {joined('me', 3)} ELSE me[1] END"),
    } | {t: (f"CASE WHEN list_contains(tracks, '{t}') THEN 'true' END", joined("te", 3)) for t in cp.TRACKS}
    own = " UNION ALL ".join(f"SELECT entity, year, '{f}' AS field, {values[f][0]} AS value, {values[f][1]} AS evidence, '{category}' AS category, '{priority}' AS priority FROM rq JOIN ff USING (entity, year)" for f, category, priority in requirements.ROWS)
    kinds = "[" + ", ".join(f"'{k}'" for k in cp.EXCLUSIONS) + "]"
    limits, excluded = (x.replace("FROM corp", "FROM req") for x in (_LIMITS, _EXCLUDED))
    return (
        f"{_REQ}, {_requirements_sql()}, {limits}, {excluded}, el AS (SELECT entity, year, list(kind ORDER BY list_position({kinds}, kind)) AS k FROM ex GROUP BY 1, 2) SELECT * FROM ({own}) WHERE value IS NOT NULL UNION ALL "
        "SELECT entity, year, 'page_limit_exclusions', 'true', CASE len(k) WHEN 1 THEN k[1] WHEN 2 THEN k[1] || ' and ' || k[2] ELSE array_to_string(k[1:len(k) - 1], ', ') || ', and ' || k[len(k)] END || ' do not count toward page limit', 'submission_requirements', 'high' FROM el"
    )


_PAGES = _values(list(enumerate(cp.PAGE)), "idx, rx")
_LIMITS = (
    f"pm AS (SELECT entity, year, text, idx, regexp_extract_all(text, '(?i)' || rx) AS m, regexp_split_to_array(text, '(?i)' || rx) AS p FROM corp, {_PAGES} WHERE regexp_matches(text, '(?i)' || rx)), "
    "pi AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM pm), pp AS (SELECT entity, year, text, idx, m[i] AS match, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + 1)::INT AS start FROM pi), "
    r"pa AS (SELECT *, lower(substring(text, greatest(1, start - 100), start - greatest(1, start - 100) + length(match) + 100)) AS around, regexp_extract_all(match, '\d+') AS numbers FROM pp WHERE regexp_matches(match, '\d')), "
    "pw AS (SELECT *, CASE WHEN idx < 7 THEN 100 ELSE 0 END + CASE WHEN regexp_matches(around, 'main paper|regular paper|full paper|research paper|submission') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(around, 'poster|demo|workshop|abstract submission|extended abstract') THEN 0 ELSE 25 END + CASE WHEN numbers[1]::INT >= 6 THEN 20 ELSE 0 END AS weight FROM pa), "
    "pl AS (SELECT entity, year, numbers[1] || ' pages' AS main_limit, match AS evidence, CASE WHEN idx < 7 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY weight DESC, idx, start) AS r FROM pw) WHERE r = 1)"
)
#: What the whole texts exclude; no limit's own words name any here.
_EXCLUDED = f"ex AS (SELECT entity, year, label AS kind, 'unlimited' AS pages FROM (SELECT DISTINCT entity, year, label FROM corp SEMI JOIN pl USING (entity, year), {_labels({'x': cp.EXCLUSIONS})} WHERE regexp_matches(text, '(?i)' || rx)))"
_SENTENCES = (
    "ev AS (SELECT s.*, text, substring(text, greatest(1, start - 200), start - greatest(1, start - 200)) AS lft, substring(text, start + length(match), 200) AS rgt FROM scan s JOIN corp USING (entity, year)), "
    r"es AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(lft, '[.!?\n]') THEN ltrim(regexp_extract(lft, '([^.!?\n]*)$', 1)) ELSE '' END || match || CASE WHEN regexp_matches(rgt, '[.!?\n]') THEN regexp_extract(rgt, '^([^.!?\n]*[.!?\n])', 1) ELSE '' END, '^\s+|\s+$', '', 'g') AS sentence FROM ev), "
    r"ef AS (SELECT *, CASE WHEN contains(sentence, '  ') THEN regexp_replace(sentence, '\s+', ' ', 'g') ELSE sentence END AS shown, regexp_extract_all(lft, '\S+') AS before, regexp_extract_all(rgt, '\S+') AS after FROM es)"
)


def _review_sql(source: str, key: str) -> str:
    """The review classifier over a table of texts: rr has the best label of each key that has one."""
    return (
        f"rq AS (SELECT {key}, text, label, label_no, pattern_no, regexp_extract_all(text, '(?i)' || rx) AS m FROM {source}, {_labels({'review': cp.REVIEW})} WHERE regexp_matches(text, '(?i)' || rx)), rh AS (SELECT {key}, label, label_no, unnest(m) AS m FROM rq), "
        f"rs AS (SELECT {key}, label, label_no, sum({_REVIEW_W})::DOUBLE AS score FROM rh GROUP BY ALL), rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, label_no) AS r FROM rs) WHERE r = 1)"
    )


_FIRST_PLAIN = f"fp AS (SELECT entity, year, grp AS policy, lower(arg_min(label, label_no)) AS label FROM corp, {_labels({'rebuttal': cp.REBUTTAL, 'desk_rejection': cp.DESK_REJECTION, 'reciprocal_review': cp.RECIPROCAL})} WHERE regexp_matches(text, '(?i)' || rx) GROUP BY 1, 2, 3)"
_LEGACY = (
    f"{_review_sql('corp', 'entity, year')}, {_LIMITS.replace('pm AS', 'pgm AS').replace('FROM pm)', 'FROM pgm)').replace('pi AS', 'pgi AS').replace('FROM pi)', 'FROM pgi)').replace('pw AS', 'pgw AS').replace('FROM pw)', 'FROM pgw)')}, {_POLICY_SCORES}, {_FIRST_PLAIN}, "
    "legacy AS (" + " UNION ALL ".join(f"SELECT entity, year, '{f}' AS field, CASE WHEN label = '{f}' THEN 'true' ELSE 'false' END AS value FROM rr" for f in ("double_blind", "single_blind", "open_review")) + " "
    "UNION ALL SELECT entity, year, 'page_limit', main_limit FROM pl UNION ALL SELECT entity, year, policy, label FROM pc WHERE score > 0 "
    "UNION ALL SELECT entity, year, CASE policy WHEN 'rebuttal' THEN 'rebuttal_allowed' ELSE policy END, CASE policy WHEN 'rebuttal' THEN (label = 'allowed')::VARCHAR WHEN 'desk_rejection' THEN (label = 'yes')::VARCHAR ELSE label END FROM fp "
    f"UNION ALL SELECT DISTINCT entity, year, label, 'true' FROM corp, {_labels({'t': cp.TRACKS})} WHERE regexp_matches(text, '(?i)' || rx))"
)



QUERIES = {
    "corpus": (corpus, RULES + " SELECT entity, year, text FROM corp"),
    "pattern_scan": (pattern_scan, RULES + " SELECT entity, year, field, pattern_idx, name, start, match FROM scan"),
    "default_fill": (default_fill, RULES + " SELECT entity, year, field, category, type, priority, value, evidence FROM rules"),
    **{f"rule_{kind}": (_typed_of(*_of_kind(kind)), _typed_sql(*_of_kind(kind))) for kind in ("boolean", "enum", "date", "list")},
    "rule_string": (_typed_of("conference_location", "publication_venue"), _typed_sql("conference_location", "publication_venue")),
    "rule_pages": (_typed_of("page_limit"), _typed_sql("page_limit")),
    "rule_number": (rule_number, RULES + " SELECT entity, year, CASE WHEN regexp_extract(match, '\\d+')::BIGINT BETWEEN 7 AND 11 THEN regexp_extract(match, '\\d+') ELSE 'unknown' END AS value FROM typed WHERE field = 'page_limit'"),
    "stale_dates": (stale_dates, RULES + f" SELECT entity, year, field, CASE WHEN regexp_extract(value, '\\b(\\d{{4}})\\b', 1) <> '' AND nullif(regexp_extract(value, '\\b(\\d{{4}})\\b', 1), '')::INT < {_AS_OF - 2} THEN 'unknown' ELSE value END AS value FROM typed WHERE field IN ({', '.join(map(repr, _of_kind('date')))})"),
    "locations": (locations, RULES + " SELECT entity, year, string_split(value, ', ')[1] AS city, CASE string_split(value, ', ')[2] WHEN 'United States' THEN 'US' WHEN 'United Kingdom' THEN 'UK' ELSE string_split(value, ', ')[2] END AS country FROM typed WHERE field = 'conference_location' AND value <> 'unknown'"),
    "known_modes": (
        known_modes,
        RULES + " SELECT field, count(*) FILTER (WHERE value <> 'unknown') AS quality, count(*) FILTER (WHERE value NOT IN ('unknown', '')) AS report, count(*) FILTER (WHERE value NOT IN ('unknown', '', 'not_mentioned')) AS site, count(*) FILTER (WHERE lower(value) NOT IN ('unknown', '', 'not_mentioned', 'none')) AS display FROM rules GROUP BY 1",
    ),
    "date_ranges": (
        date_ranges,
        f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN m || ' ' || dd || ' - 31, ' || yy WHEN 1 THEN m || ' ' || dd || CASE WHEN mm = 6 THEN ' - 3, ' ELSE ' - June 3, ' END || yy WHEN 2 THEN 'available at ' || m || ' ' || dd || ', ' || yy ELSE 'at the lake' END AS range, o_orderkey % 4 < 2 AS valid FROM {_ORD}",
    ),
    "evidence": (
        evidence,
        RULES + f", {_SENTENCES} SELECT entity, year, field, '...' || CASE WHEN length(shown) <= 150 THEN shown ELSE trim(concat_ws(' ', array_to_string(before[greatest(1, len(before) - 2):], ' '), match, array_to_string(after[1:3], ' '))) END || '...' AS evidence FROM ef",
    ),
    "snippets": (
        snippets,
        RULES
        + ", cut AS (SELECT entity, year, text, string_split(lower(text), 'deadline') AS p FROM corp), pos AS (SELECT *, list_transform(range(1, least(3, len(p) - 1) + 1), lambda k: (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * 8)::INT) AS s FROM cut) "
        "SELECT entity, year, array_to_string(list_transform(s, lambda x: CASE WHEN x > 20 THEN '...' ELSE '' END || substring(text, greatest(0, x - 20) + 1, x - greatest(0, x - 20) + 28) || CASE WHEN x + 28 < length(text) THEN '...' ELSE '' END), '~') AS snippets FROM pos",
    ),
    "negation": (
        negation,
        POLICY + " SELECT contains(text, 'not allowed') AS negated, starts_with(text, 'No rebuttals') AS rebuttal_negated, count(*) AS n FROM policy GROUP BY 1, 2",
    ),
    "cleaners": (
        cleaners,
        "SELECT p_partkey, ['file_size', 'page_count', 'system_name', 'venue', 'deadline', 'artifact', 'model_policy', 'page_number'][p_partkey % 8 + 1] AS c, ['10MB', '8 pages papers', 'OpenReview', 'PMLR', 'February 14, 2025', 'required', 'prohibited', '6-9 pages'][p_partkey % 8 + 1] AS value FROM part",
    ),
    "date_norm": (date_norm, f"SELECT o_orderkey, m || ' ' || dd || ', ' || yy AS date FROM {_ORD}"),
    "format_deadline": (format_deadline, f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE m || ' ' || dd || ', ' || yy END AS deadline FROM {_ORD}"),
    "short_date": (
        short_date,
        f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN left(m, 3) || ' ' || dd || ', ' || yy WHEN 1 THEN left(m, 3) || ' ' || CASE WHEN yy >= 1000 THEN substring(yy::VARCHAR, 1, 4) END || ', ' || CASE WHEN mm < 6 THEN 2026 ELSE 2025 END WHEN 2 THEN left(m, 3) || ' ' || dd || ', ' || yy "
        f"WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 4 THEN left(m, 3) || ' ' || dd || ', ' || CASE WHEN mm < 6 THEN 2026 ELSE 2025 END ELSE dd || ' ' || m END AS shown FROM {_ORD}",
    ),
    "location": (
        location,
        f"SELECT c_custkey, CASE k WHEN 0 THEN 'Town0' WHEN 3 THEN 'Austin' WHEN 4 THEN 'Singapore' WHEN 5 THEN 'Hong Kong' WHEN 6 THEN 'Denver' WHEN 7 THEN 'City' || n_nationkey END AS city, "
        f"CASE k WHEN 0 THEN {_NATION} WHEN 1 THEN 'Italy' WHEN 3 THEN 'US' WHEN 4 THEN 'Singapore' WHEN 5 THEN 'Hong Kong, China' WHEN 6 THEN 'US' WHEN 7 THEN {_NATION} END AS country, "
        f"CASE k WHEN 0 THEN 'Town0, ' || {_NATION} WHEN 1 THEN 'Italy' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Austin, US' WHEN 4 THEN 'Singapore' WHEN 5 THEN 'Hong Kong, China' WHEN 6 THEN 'Denver, US' ELSE 'City' || n_nationkey || ', ' || {_NATION} END AS display "
        "FROM (SELECT *, c_custkey % 8 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    ),
    "location_valid": (
        location_valid,
        f"SELECT c_custkey, length(raw) BETWEEN 5 AND 100 AND contains(raw, ',') AND len(string_split(raw, ' ')) BETWEEN 2 AND 5 AS valid FROM (SELECT c_custkey, {_PLACE} AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    ),
    "feed_join": (feed_join, RULES + " SELECT entity, year, field, value, source, conflict FROM merged"),
    "page_limit": (page_limit, RULES + f", {_LIMITS} SELECT entity, year, main_limit, evidence, confidence FROM pl"),
    "page_exclusions": (page_exclusions, RULES + f", {_LIMITS}, {_EXCLUDED} SELECT entity, year, kind, pages FROM ex"),
    "override": (
        override,
        RULES + f", {_LEGACY}, known AS (SELECT * FROM legacy WHERE coalesce(value, 'unknown') NOT IN ('unknown', '', 'false', 'not_mentioned')) SELECT entity, year, field, coalesce(k.value, r.value) AS value, CASE WHEN k.value IS NOT NULL THEN 'classifier' ELSE 'regex' END AS origin FROM rules r FULL JOIN known k USING (entity, year, field)",
    ),
    "review_class": (
        review_class,
        POLICY
        + f", rm AS (SELECT source_key, text, label, label_no, pattern_no, regexp_extract_all(text, '(?i)' || rx) AS m, regexp_split_to_array(text, '(?i)' || rx) AS p FROM policy, {_labels({'review': cp.REVIEW})} WHERE regexp_matches(text, '(?i)' || rx)), "
        f"e AS (SELECT source_key, {_EVIDENCE} AS evidence FROM (SELECT *, {_windows_sql(50)} AS w FROM rm) GROUP BY 1), h AS (SELECT source_key, label, label_no, unnest(m) AS m FROM rm), s AS (SELECT source_key, label, label_no, sum({_REVIEW_W})::DOUBLE AS score FROM h GROUP BY 1, 2, 3), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY score DESC, label_no) AS r, coalesce(lead(score) OVER (PARTITION BY source_key ORDER BY score DESC, label_no), 0.0::DOUBLE) AS second FROM s) "
        "SELECT p.source_key, coalesce(label, 'unknown') AS label, coalesce(score, 0.0)::DOUBLE AS score, coalesce(second, 0.0)::DOUBLE AS second, CASE WHEN score >= 3 THEN 'high' WHEN score = 2 AND second = 0 THEN 'medium' ELSE 'low' END AS confidence, coalesce(evidence, '') AS evidence "
        "FROM policy p LEFT JOIN (SELECT * FROM r WHERE r = 1) r USING (source_key) LEFT JOIN e USING (source_key)",
    ),
    "first_label": (first_label, RULES + f", {_FIRST} SELECT entity, year, policy, label FROM fl"),
    "policy_class": (policy_class, RULES + f", {_POLICY_SCORES} SELECT entity, year, policy, label, score, confidence, evidence FROM pc"),
    "statements": (
        statements,
        _REQ + f", s AS (SELECT DISTINCT entity, year, label, label_no FROM req, {_labels({'s': cp.STATEMENTS})} WHERE regexp_matches(text, '(?i)' || rx)) SELECT entity, year, string_agg(label, ',' ORDER BY label_no) AS types, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM s GROUP BY 1, 2",
    ),
    "logistics": (
        logistics,
        _REQ
        + f", s AS (SELECT entity, year, grp, arg_min(label, label_no) AS label FROM req, {_labels({'template': cp.TEMPLATE, 'supplementary': cp.SUPPLEMENTARY, 'delivery': cp.DELIVERY, 'aid': {'true': cp.AID}, 'workshops': {'true': cp.WORKSHOPS}})} WHERE regexp_matches(text, '(?i)' || rx) GROUP BY 1, 2, 3) "
        "SELECT entity, year, " + ", ".join(f"max(CASE WHEN grp = '{g}' THEN label END) AS {g}" for g in ("template", "supplementary", "delivery", "aid", "workshops")) + " FROM s GROUP BY 1, 2",
    ),
    "presentation_formats": (
        presentation_formats,
        _REQ + f", m AS (SELECT entity, year, lower(unnest(regexp_extract_all(text, '(?i)' || rx))) AS m FROM req, {_labels({'p': {'p': cp.PRESENTATION}})} WHERE regexp_matches(text, '(?i)' || rx)), f AS (SELECT entity, year, bool_or(contains(m, 'oral')) AS o, bool_or(contains(m, 'poster')) AS p, bool_or(contains(m, 'demo')) AS d, bool_or(contains(m, 'virtual')) AS v FROM m GROUP BY 1, 2) "
        "SELECT entity, year, concat_ws(',', CASE WHEN o THEN 'oral' END, CASE WHEN p THEN 'poster' END, CASE WHEN d THEN 'demo' END, CASE WHEN v THEN 'virtual' END) AS formats FROM f",
    ),
    "tracks": (
        tracks,
        _REQ + f", s AS (SELECT DISTINCT entity, year, label AS track FROM req, {_labels({'t': cp.TRACKS})} WHERE regexp_matches(text, '(?i)' || rx)) SELECT entity, year, track, CASE WHEN count(*) OVER (PARTITION BY entity, year) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM s",
    ),
    "extractor_histogram": (extractor_histogram, RULES + f", {_POLICY_SCORES} SELECT policy, label, confidence, count(*) AS n FROM pc GROUP BY 1, 2, 3"),
    "requirement_struct": (
        requirement_struct,
        f"{_REQ}, {_requirements_sql()} SELECT entity, year, template, details, supplementary, limits, array_to_string(se[1:2], '; ') AS submission_evidence, CASE WHEN len(se) > 0 THEN 'medium' ELSE 'low' END AS submission_confidence, array_to_string(formats, ',') AS formats, aid, workshops, delivery, "
        f"array_to_string(ge[1:2], '; ') AS logistics_evidence, CASE WHEN len(ge) > 0 THEN 'medium' ELSE 'low' END AS logistics_confidence, array_to_string(tracks, ',') AS tracks, {_CONFIDENT.format('tracks', 3)} AS tracks_confidence, array_to_string(types, ',') AS statements, {_CONFIDENT.format('types', 2)} AS statements_confidence FROM rq JOIN ff USING (entity, year)",
    ),
    "requirement_rows": (requirement_rows, _requirement_rows_sql()),
    "extractor_distributions": (extractor_distributions, _distributions_sql()),
    "legacy_rows": (legacy_rows, RULES + f", {_LEGACY} SELECT entity, year, field, value FROM legacy"),
    "batch_pack": (
        batch_pack,
        "WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations WHERE text IS NOT NULL), "
        "f AS (SELECT conv_id, turn, i, n AS used, 1 AS batch FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN f.used = 0 OR f.used + s.n <= 2000 THEN f.used + s.n ELSE s.n END, CASE WHEN f.used = 0 OR f.used + s.n <= 2000 THEN f.batch ELSE f.batch + 1 END FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1) "
        "SELECT conv_id, turn, batch FROM f",
    ),
    "llm_parse": (
        llm_parse,
        "SELECT event_id, event_id % 3 + 1 AS batch, unnest(['double_blind', 'page_limit']) AS field, unnest([['true', 'false', 'unknown', 'blind'][event_id % 4 + 1], (event_id % 9) || ' pages']) AS value, unnest([NULL, 'up to']) AS evidence FROM events WHERE event_id % 10 <> 0",
    ),
    "llm_typed": (llm_typed, f"WITH {_answers_sql()} SELECT event_id, batch, field, value, evidence FROM ta"),
    "llm_rejects": (llm_rejects, f"WITH {_answers_sql()} SELECT event_id, batch, field, raw, reason FROM tr"),
    "llm_quality": (
        llm_quality,
        f"WITH {_answers_sql()}, one AS (SELECT user_id, batch, field, max(value) AS value FROM ta JOIN (SELECT event_id, user_id FROM events WHERE user_id IS NOT NULL) USING (event_id) GROUP BY 1, 2, 3), "
        "m AS (SELECT user_id, field, count(DISTINCT trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) > 1 AS conflict FROM one GROUP BY 1, 2) "
        "SELECT user_id, count(*) AS known, 40::BIGINT AS total, round(count(*) * 100 / 40.0, 1)::DOUBLE AS percentage, count(*) FILTER (WHERE conflict) AS conflicts, count(*) AS answered FROM m GROUP BY 1",
    ),
    "llm_merge": (
        llm_merge,
        "WITH a AS (SELECT user_id, event_id % 3 + 1 AS batch, 'f' || (event_id % 5) AS field, max('v' || (event_id % 7)) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2, 3) "
        "SELECT user_id, field, arg_max(value, batch) AS value, CASE WHEN max(batch) = 1 THEN 'llm' ELSE 'llm_batch' || max(batch) END AS source, count(DISTINCT value) > 1 AS conflict FROM a GROUP BY 1, 2",
    ),
    "clean_evidence": (
        clean_evidence,
        r"SELECT doc_id, CASE WHEN length(v) > 150 THEN regexp_replace(left(v, 150), '\s+\S*$', '') || '...' ELSE v END AS evidence FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('**' || regexp_replace(text, '[^A-Za-z0-9 |]', '', 'g') || '**', '[*_`#>]+', '', 'g'), '\s*\|\s*', ', ', 'g'), '\s+', ' ', 'g')) AS v FROM documents)",
    ),
    "feed_text": (feed_text, POLICY + " SELECT entity, year, 'conference: ' || entity || chr(10) || 'deadline: ' || deadline || chr(10) || 'place: ' || place AS text FROM feed"),
    "prompt_text": (
        prompt_text,
        RULES + " SELECT entity, year, md5('Fields:' || chr(10) || '" + "' || chr(10) || '".join(f"- {f} ({t_})" for f, _, t_, *_ in FIELDS) + "' || chr(10) || chr(10) || text) AS prompt_md5 FROM corp",
    ),
    "clean_feed_nfkc": (clean_feed_nfkc, None),
}
