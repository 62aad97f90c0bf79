"""Readers of the stored tables, and views that stand for crawled policy text and its structured feed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.dates import month_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    date = F.col("o_orderdate")
    return orders.withColumn("entity", F.concat(F.lit("CONF"), (F.col("o_custkey") % 50).cast("string"))).withColumn("year", F.year(date)).withColumn(
        "shown", F.concat(month_name(F.month(date)), F.lit(" "), F.dayofmonth(date).cast("string"), F.lit(", "), F.year(date).cast("string"))
    )


#: Sentences of policy; {date}, {month} and {range} stand for dates, {n} for a number, {place} for a city and its country.
SENTENCES = [
    "Submission deadline: {date}.",
    "Submissions are limited to {n} pages, excluding references.",
    "The review process is double-blind.",
    "Reviewers remain anonymous; single-blind review.",
    "Concurrent submissions are not allowed.",
    "The event will be held in {place}.",
    "Authors may submit a rebuttal. Call for tutorials.",
    "Abstract deadline: {date}.",
    "Notification date: {date}.",
    "Camera-ready deadline: {date}.",
    "Conference dates: {range}.",
    "Rebuttal deadline: {month}.",
    "Withdrawal deadline: TBA.",
    "Registration deadline: {date}.",
    "Open peer review on OpenReview.",
    "Papers out of scope may be desk rejected; reciprocal reviewing applies.",
    "The LaTeX template is required.",
    "Supplementary material is allowed.",
    "ArXiv preprints are allowed.",
    "Papers appear in the Proceedings of Machine Learning Research.",
    "An ethics statement is required.",
    "Artifact evaluation is mandatory.",
    "Use of ChatGPT must be disclosed.",
    "A hybrid conference with oral presentations and poster presentations.",
    "Travel grants are available. Co-located workshops.",
    "Submit through EasyChair.",
    "Call for workshop proposals, call for demos, call for posters.",
    "An industry track, position papers and a student research competition.",
    "A doctoral consortium, findings papers and a best paper award.",
    "No rebuttals this year, and no supplementary material.",
]


def policy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, year, source_key, k, text): a sentence of policy for each order."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("title"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = _dated(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    month, day, year = month_name(F.month(date)), F.dayofmonth(date) % 20 + 1, F.year(date).cast("string")
    values = {
        "date": F.col("shown"), "month": F.concat(month, F.lit(" "), year), "n": (6 + k % 7).cast("string"), "place": F.concat(F.lit("City"), F.col("n_nationkey").cast("string"), F.lit(", "), F.col("title")),
        "range": F.concat(month, F.lit(" "), day.cast("string"), F.lit(" - "), (day + 3).cast("string"), F.lit(", "), year),
    }
    made = lambda s: F.concat(*[values[x] if n % 2 else F.lit(x) for n, x in enumerate(re.split(r"\{(\w+)\}", s)) if x])
    number = k % len(SENTENCES)
    text = F.when(number == 0, made(SENTENCES[0]))
    for n, sentence in enumerate(SENTENCES[1:], 1):  # by cases, so that each row computes its own sentence's values only
        text = text.when(number == n, made(sentence))
    text = F.when(date.isNotNull() & F.col("title").isNotNull(), text)
    return rows.select("entity", "year", F.concat(F.lit("raw/"), k.cast("string")).alias("source_key"), k.alias("k"), text.alias("text"))


def _first_of(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    """(entity, year, k, shown): the first order of each key among those whose key leaves this rest of 7."""
    rows = _dated(spark, sf_dir).where(F.col("o_orderkey") % 7 == rest)
    return rows.groupBy("entity", "year").agg(F.min(F.struct("o_orderkey", "shown")).alias("f")).select("entity", "year", F.col("f.o_orderkey").alias("k"), F.col("f.shown").alias("shown"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, year, deadline, place, abstract, system): the more trusted feed; deadlines agree with the text for even keys."""
    first = _first_of(spark, sf_dir, 0)
    january = F.concat(F.lit("January 1, "), F.col("year").cast("string"))
    return first.select(
        "entity", "year", F.when(F.col("k") % 2 == 0, F.col("shown")).otherwise(january).alias("deadline"), F.concat(F.lit("Town"), (F.col("k") % 9).cast("string")).alias("place"), F.when(F.col("k") % 3 == 0, january).alias("abstract"),
        F.element_at(F.array(F.lit("EasyChair"), F.lit("CMT")), (F.col("k") % 2 + 1).cast("int")).alias("system"),
    )


def second_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, year, deadline, place, notification, camera, dates): a feed that counts where the first one is silent."""
    first = _first_of(spark, sf_dir, 1)
    june = F.concat(F.lit("June 2, "), F.col("year").cast("string"))
    return first.select(
        "entity", "year", F.col("shown").alias("deadline"), F.concat(F.lit("Town"), (F.col("k") % 5).cast("string")).alias("place"), F.when(F.col("k") % 2 == 0, F.col("shown")).otherwise(june).alias("notification"), june.alias("camera"),
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("June 2 - 5, "), F.col("year").cast("string"))).alias("dates"),
    )
