"""Reports over long rules: completeness, coverage, gaps, agreement, issues, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.rules import is_known
from folioforge.functions.text import any_contains


def percent(part: Column, whole: Column) -> Column:
    """One decimal, half to even."""
    return F.when(whole > 0, F.bround((part * 100).cast("decimal(20,6)") / whole.cast("decimal(18,0)"), 1).cast("double")).otherwise(0.0)


def completeness(rules: DataFrame, keys: list[str], mode: str = "quality") -> DataFrame:
    got = rules.groupBy(*keys).agg(F.count_if(is_known(F.col("value"), mode)).alias("known"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("percentage", percent(F.col("known"), F.col("total")))


def coverage_by_field(rules: DataFrame) -> DataFrame:
    got = rules.groupBy("field").agg(F.first("category").alias("category"), F.count_if(is_known(F.col("value"))).alias("extracted"), F.count(F.lit(1)).alias("total"))
    return got.withColumn("percentage", percent(F.col("extracted"), F.col("total")))


def coverage_by_category(coverage: DataFrame) -> DataFrame:
    """Mean of the rounded percentages of a category's fields."""
    return coverage.groupBy("category").agg(F.round(F.avg("percentage"), 3).alias("mean_percentage"), F.count(F.lit(1)).alias("fields"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("extracted") == 0).alias("empty_fields"), F.sum("extracted").alias("extracted"), F.sum("total").alias("total"), F.round(F.avg("percentage"), 3).alias("mean_percentage")
    )


def health(rules: DataFrame, keys: list[str], low: float = 20.0) -> DataFrame:
    got = completeness(rules, keys, "report")
    return got.withColumn("low", F.col("percentage") < low)


def gaps(rules: DataFrame, corpora: DataFrame, keys: list[str], keywords: DataFrame) -> DataFrame:
    """(field, in_text, extracted, gap, names): texts that hold a field's keyword, those with a value, and ten that lack one."""
    from folioforge.operators.scan import small
    from folioforge.sources.shared import settle

    words = small(keywords.select("field", "keywords"))
    held = settle(corpora.withColumn("low", F.lower("text")).join(words, F.exists("keywords", lambda w: F.contains(F.col("low"), w))).select(*keys, "field"))  # counted and named below
    got = held.join(rules.select(*keys, "field", is_known(F.col("value")).alias("known")), [*keys, "field"])
    name = F.concat_ws("/", *keys)
    # ten names a field: the smallest, kept by rank before they are listed
    agg = got.groupBy("field").agg(F.count(F.lit(1)).alias("in_text"), F.count_if("known").alias("extracted"), F.count_if(~F.col("known")).alias("gap"))
    from pyspark.sql import Window

    missed = got.where(~F.col("known")).select("field", name.alias("name")).withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("name"))).where("r <= 10")
    names = missed.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return agg.join(names, "field", "left").withColumn("names", F.coalesce("names", F.lit("")))


def source_coverage(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("fields"))


def conflict_list(merged: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, n, conflicts): each key's number of conflicting fields, and these with all candidates in order of field; with most, only the first so many are listed, by rank before they are collected."""
    from pyspark.sql import Window

    rows = merged.where("conflict").select(*keys, F.concat(F.col("field"), F.lit(": "), F.col("candidates")).alias("c"), "field")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("field")))
    listed = F.collect_list(F.when(F.lit(True) if most is None else F.col("r") <= most, F.col("c")))
    got = rows.groupBy(*keys).agg(F.sort_array(listed).alias("c"), F.count(F.lit(1)).alias("n"))
    return got.select(*keys, "n", F.array_join("c", " | ").alias("conflicts"))


def run_report(merged: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, known, total, percentage, conflict_count, conflicts, sources): a run's record for each key: completeness, the first conflicts, and how many fields each source gave."""
    base = completeness(merged, keys)
    sources = merged.where(F.col("source").isNotNull()).groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))
    sources = sources.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("sources"))
    got = base.join(conflict_list(merged, keys, most).withColumnRenamed("n", "conflict_count"), keys, "left").join(sources, keys, "left")
    return got.select(*keys, "known", "total", "percentage", F.coalesce("conflict_count", F.lit(0)).alias("conflict_count"), F.coalesce("conflicts", F.lit("")).alias("conflicts"), "sources")


def agreement(values: DataFrame, keys: list[str]) -> DataFrame:
    """values (keys, field, source, value): fields with two known sources or more that agree or not, compared in lower case and trimmed."""
    known = values.where(is_known(F.col("value"))).groupBy(*keys, "field").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.lower(F.trim("value"))).alias("kinds")).where("sources >= 2")
    got = known.groupBy("field").agg(F.count_if(F.col("kinds") == 1).alias("agree"), F.count_if(F.col("kinds") > 1).alias("disagree"))
    return got.withColumn("percentage", percent(F.col("agree"), F.col("agree") + F.col("disagree")))


def value_issues(rules: DataFrame, as_of_year: int) -> DataFrame:
    """(field, issue, n): stale dates, places too short or with boilerplate, values that their evidence denies."""
    v, f = F.col("value"), F.col("field")
    year = F.nullif(F.regexp_extract(v, r"\b(\d{4})\b", 1), F.lit("")).cast("int")
    dates = f.rlike("deadline|date")
    negation = F.lower(F.coalesce("evidence", F.lit(""))).rlike(r"\bnot\b|\bno\b|\bwithout\b")
    issues = F.array_compact(
        F.array(
            F.when(dates & (year < as_of_year), F.lit("stale_date")),
            F.when((f == "conference_location") & is_known(v) & (F.length(v) < 5), F.lit("location_too_short")),
            F.when((f == "conference_location") & any_contains(F.lower(v), ["will be", "held", "venue"]), F.lit("location_boilerplate")),
            F.when((v == "true") & negation, F.lit("boolean_evidence_conflict")),
        )
    )
    return rules.select("field", F.explode(issues).alias("issue")).groupBy("field", "issue").agg(F.count(F.lit(1)).alias("n"))


def dashboard(coverage: DataFrame, gap: DataFrame, agreed: DataFrame, issues: DataFrame) -> DataFrame:
    n = issues.groupBy("field").agg(F.sum("n").alias("issues"))
    got = coverage.select("field", F.col("percentage").alias("coverage")).join(gap.select("field", "gap"), "field", "left").join(agreed.select("field", F.col("percentage").alias("agreement")), "field", "left").join(n, "field", "left")
    return got.select("field", "coverage", F.coalesce("gap", F.lit(0)).alias("gap"), "agreement", F.coalesce("issues", F.lit(0)).alias("issues"))


def coverage_json(coverage: DataFrame) -> DataFrame:
    return coverage.select("field", F.to_json(F.struct("field", "extracted", "total")).alias("json"))


def tally(runs: DataFrame) -> DataFrame:
    """runs (stage, status, known): counts by stage and status, mean of known over the successes."""
    return runs.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("status") == "success", F.col("known"))), 3).alias("mean_known"))


def histogram(values: DataFrame, by: list[str]) -> DataFrame:
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
