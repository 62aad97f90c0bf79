"""Queries of the reports over long rules, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.rules import is_known
from folioforge.operators import reports as r
from folioforge.plans.rules import KEYS, corpora, feed_rows, merged, rules
from folioforge.plans.views import RULES, _values
from folioforge.sources.shared import settle
from folioforge.sources.tables import table

_KEYWORDS = [("submission_deadline", ["deadline"]), ("page_limit", ["pages"]), ("double_blind", ["blind"]), ("notification_date", ["authors"]), ("has_tutorials", ["tutorial"])]
_AS_OF = 1997


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_KEYWORDS, "field string, keywords array<string>")


def _valued(own: DataFrame, fed: DataFrame) -> DataFrame:
    """(keys, field, source, value) of each source."""
    return own.select(*KEYS, "field", F.lit("regex").alias("source"), "value").union(fed.select(*KEYS, "field", F.lit("feed").alias("source"), "value"))


def valued(spark: SparkSession, d: str) -> DataFrame:
    return _valued(rules(spark, d), feed_rows(spark, d))


def completeness(spark: SparkSession, d: str) -> DataFrame:
    return r.completeness(rules(spark, d), KEYS)


def coverage_by_field(spark: SparkSession, d: str) -> DataFrame:
    return r.coverage_by_field(rules(spark, d))


def coverage_by_category(spark: SparkSession, d: str) -> DataFrame:
    return r.coverage_by_category(coverage_by_field(spark, d))


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return r.coverage_summary(coverage_by_field(spark, d))


def coverage_json(spark: SparkSession, d: str) -> DataFrame:
    return r.coverage_json(coverage_by_field(spark, d))


def conf_health(spark: SparkSession, d: str) -> DataFrame:
    return r.health(rules(spark, d), ["entity"], 75.0)


def gap_analysis(spark: SparkSession, d: str) -> DataFrame:
    texts = settle(corpora(spark, d))
    return r.gaps(settle(rules(spark, d, texts)), texts, KEYS, keywords(spark))


def gap_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Gaps by keyword or by any pattern hit of the field."""
    texts = settle(corpora(spark, d))
    words = texts.withColumn("low", F.lower("text")).join(F.broadcast(keywords(spark)), F.exists("keywords", lambda w: F.contains(F.col("low"), w))).select(*KEYS, "field")
    own = settle(rules(spark, d, texts))
    hit = own.where("evidence <> ''").select(*KEYS, "field")  # no pattern matches nothing, so evidence stands for a hit
    got = words.union(hit).distinct().join(own.select(*KEYS, "field", is_known(F.col("value")).alias("known")), [*KEYS, "field"])
    return got.groupBy("field").agg(F.count(F.lit(1)).alias("in_text"), F.count_if("known").alias("extracted"), F.count_if(~F.col("known")).alias("gap"))


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).where("conflict").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return r.source_coverage(merged(spark, d))


def conflict_list(spark: SparkSession, d: str) -> DataFrame:
    return r.conflict_list(merged(spark, d), KEYS)


def agreement(spark: SparkSession, d: str) -> DataFrame:
    return r.agreement(valued(spark, d), KEYS)


def value_issues(spark: SparkSession, d: str) -> DataFrame:
    return r.value_issues(rules(spark, d), _AS_OF)


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, gaps, agreement and issues side by side, all from one settled table of rules."""
    texts = settle(corpora(spark, d))
    own = settle(rules(spark, d, texts))
    return r.dashboard(r.coverage_by_field(own), r.gaps(own, texts, KEYS, keywords(spark)), r.agreement(_valued(own, feed_rows(spark, d)), KEYS), r.value_issues(own, _AS_OF))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    got = r.run_report(settle(merged(spark, d)), KEYS, most=2)
    return got.withColumn("sources", F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


def report_order(spark: SparkSession, d: str) -> DataFrame:
    """The ten fields with the best coverage, with their places: a top-k report."""
    order = Window.orderBy(F.desc("percentage"), "field")
    return coverage_by_field(spark, d).orderBy(F.desc("percentage"), "field").limit(10).withColumn("place", F.row_number().over(order)).select("place", "field", "percentage")


def valid_results(spark: SparkSession, d: str) -> DataFrame:
    got = rules(spark, d).groupBy(*KEYS).agg(F.bool_or(is_known(F.col("value"), "site")).alias("any"))
    return got.where("any").select(*KEYS)


def run_tally(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 11 == 0, "failed").when(k % 13 == 0, "skipped").otherwise("success")
    rows = table(spark, d, "orders").select(F.element_at(F.array(*map(F.lit, ["collect", "extract", "serve"])), (k % 3 + 1).cast("int")).alias("stage"), status.alias("status"), (k % 41).alias("known"))
    return r.tally(rows)


_COV = RULES + ", cov AS (SELECT field, any_value(category) AS category, count(*) FILTER (WHERE value NOT IN ('unknown', '')) AS extracted, count(*) AS total, round_even(100 * count(*) FILTER (WHERE value NOT IN ('unknown', ''))::DECIMAL(18,6) / count(*), 1)::DOUBLE AS percentage FROM rules GROUP BY 1)"
_KW = _values([(f, w) for f, ws in _KEYWORDS for w in ws], "field, word")
_GAP = f", held AS (SELECT DISTINCT c.entity, c.year, v.field FROM corp c, {_KW} WHERE contains(lower(c.text), v.word)), gapped AS (SELECT r.field, r.entity || '/' || r.year AS name, r.value NOT IN ('unknown', '') AS known FROM held h JOIN rules r USING (entity, year, field))"
_GAPS = ", gaps AS (SELECT field, count(*) AS in_text, count(*) FILTER (WHERE known) AS extracted, count(*) FILTER (WHERE NOT known) AS gap, coalesce(array_to_string(list_sort(list(name) FILTER (WHERE NOT known))[1:10], ', '), '') AS names FROM gapped GROUP BY 1)"
_AGREE = (
    ", vals AS (SELECT entity, year, field, 'regex' AS source, value FROM rules UNION ALL SELECT entity, year, field, 'feed', value FROM feedlong), two AS (SELECT entity, year, field, count(DISTINCT source) AS s, count(DISTINCT lower(trim(value))) AS k FROM vals WHERE value NOT IN ('unknown', '') GROUP BY 1, 2, 3), "
    "agr AS (SELECT field, count(*) FILTER (WHERE k = 1) AS agree, count(*) FILTER (WHERE k > 1) AS disagree, round_even(100 * count(*) FILTER (WHERE k = 1)::DECIMAL(18,6) / count(*), 1)::DOUBLE AS percentage FROM two WHERE s >= 2 GROUP BY 1)"
)
_ISSUES = (
    rf", iss AS (SELECT field, unnest(list_filter([CASE WHEN regexp_matches(field, 'deadline|date') AND try_cast(nullif(regexp_extract(value, '\b(\d{{4}})\b', 1), '') AS INT) < {_AS_OF} THEN 'stale_date' END, CASE WHEN field = 'conference_location' AND value NOT IN ('unknown', '') AND length(value) < 5 THEN 'location_too_short' END, "
    r"CASE WHEN field = 'conference_location' AND (contains(lower(value), 'will be') OR contains(lower(value), 'held') OR contains(lower(value), 'venue')) THEN 'location_boilerplate' END, CASE WHEN value = 'true' AND regexp_matches(lower(evidence), '\bnot\b|\bno\b|\bwithout\b') THEN 'boolean_evidence_conflict' END], lambda x: x IS NOT NULL)) AS issue FROM rules), "
    "issues AS (SELECT field, issue, count(*) AS n FROM iss GROUP BY 1, 2)"
)
_HITS = ", anyhit AS (SELECT entity, year, field FROM held UNION SELECT entity, year, field FROM scan), g2 AS (SELECT r.field, r.value NOT IN ('unknown', '') AS known FROM anyhit h JOIN rules r USING (entity, year, field))"

QUERIES = {
    "completeness": (completeness, RULES + " SELECT entity, year, count(*) FILTER (WHERE value <> 'unknown') AS known, count(*) AS total, round_even(100 * count(*) FILTER (WHERE value <> 'unknown')::DECIMAL(18,6) / count(*), 1)::DOUBLE AS percentage FROM rules GROUP BY 1, 2"),
    "coverage_by_field": (coverage_by_field, _COV + " SELECT field, category, extracted, total, percentage FROM cov"),
    "coverage_by_category": (coverage_by_category, _COV + " SELECT category, round(avg(percentage), 3) AS mean_percentage, count(*) AS fields FROM cov GROUP BY 1"),
    "coverage_summary": (coverage_summary, _COV + " SELECT count(*) AS fields, count(*) FILTER (WHERE extracted = 0) AS empty_fields, sum(extracted)::BIGINT AS extracted, sum(total)::BIGINT AS total, round(avg(percentage), 3) AS mean_percentage FROM cov"),
    "coverage_json": (coverage_json, _COV + """ SELECT field, '{"field":"' || field || '","extracted":' || extracted || ',"total":' || total || '}' AS json FROM cov"""),
    "conf_health": (
        conf_health,
        RULES + ", c AS (SELECT entity, count(*) FILTER (WHERE value NOT IN ('unknown', '')) AS known, count(*) AS total, round_even(100 * count(*) FILTER (WHERE value NOT IN ('unknown', ''))::DECIMAL(18,6) / count(*), 1)::DOUBLE AS percentage FROM rules GROUP BY 1) SELECT *, percentage < 75 AS low FROM c",
    ),
    "gap_analysis": (gap_analysis, RULES + _GAP + _GAPS + " SELECT field, in_text, extracted, gap, names FROM gaps"),
    "gap_patterns": (gap_patterns, RULES + _GAP + _HITS + " SELECT field, count(*) AS in_text, count(*) FILTER (WHERE known) AS extracted, count(*) FILTER (WHERE NOT known) AS gap FROM g2 GROUP BY 1"),
    "conflicts": (conflicts, RULES + " SELECT field, count(*) AS n FROM merged WHERE conflict GROUP BY 1"),
    "source_coverage": (source_coverage, RULES + " SELECT source, count(*) AS fields FROM merged WHERE source IS NOT NULL GROUP BY 1"),
    "conflict_list": (conflict_list, RULES + " SELECT entity, year, count(*) AS n, string_agg(field || ': ' || candidates, ' | ' ORDER BY field) AS conflicts FROM merged WHERE conflict GROUP BY 1, 2"),
    "run_report": (
        run_report,
        RULES + ", c AS (SELECT entity, year, count(*) AS conflict_count, array_to_string(list(field || ': ' || candidates ORDER BY field)[1:2], ' | ') AS conflicts FROM merged WHERE conflict GROUP BY 1, 2), "
        "s AS (SELECT entity, year, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM (SELECT entity, year, source, count(*) AS n FROM merged WHERE source IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) "
        "SELECT entity, year, count(*) FILTER (WHERE value <> 'unknown') AS known, count(*) AS total, round_even(100 * count(*) FILTER (WHERE value <> 'unknown')::DECIMAL(18,6) / count(*), 1)::DOUBLE AS percentage, coalesce(any_value(conflict_count), 0) AS conflict_count, coalesce(any_value(conflicts), '') AS conflicts, any_value(sources) AS sources "
        "FROM merged LEFT JOIN c USING (entity, year) LEFT JOIN s USING (entity, year) GROUP BY 1, 2",
    ),
    "agreement": (agreement, RULES + _AGREE + " SELECT field, agree, disagree, percentage FROM agr"),
    "value_issues": (value_issues, RULES + _ISSUES + " SELECT field, issue, n FROM issues"),
    "dashboard": (
        dashboard,
        _COV + _GAP + _GAPS + _AGREE + _ISSUES + " SELECT c.field, c.percentage AS coverage, coalesce(g.gap, 0) AS gap, a.percentage AS agreement, coalesce(i.issues, 0)::BIGINT AS issues FROM cov c LEFT JOIN gaps g USING (field) LEFT JOIN agr a USING (field) LEFT JOIN (SELECT field, sum(n) AS issues FROM issues GROUP BY 1) i USING (field)",
    ),
    "report_order": (report_order, _COV + " SELECT row_number() OVER (ORDER BY percentage DESC, field)::INT AS place, field, percentage FROM cov ORDER BY percentage DESC, field LIMIT 10"),
    "valid_results": (valid_results, RULES + " SELECT DISTINCT entity, year FROM rules WHERE value NOT IN ('unknown', '', 'not_mentioned')"),
    "run_tally": (
        run_tally,
        "SELECT stage, status, count(*) AS n, round(avg(CASE WHEN status = 'success' THEN known END), 3) AS mean_known FROM (SELECT ['collect', 'extract', 'serve'][o_orderkey % 3 + 1] AS stage, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'skipped' ELSE 'success' END AS status, o_orderkey % 41 AS known FROM orders) GROUP BY 1, 2",
    ),
}
