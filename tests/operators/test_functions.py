"""Column functions and operators against fixtures worked out by hand."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import dates, rules, text
from folioforge.functions.patterns import FIELDS, fields_table, patterns_table
from folioforge.operators import catalogue, classify, merge, pages, reports, scan
from folioforge.streaming import arrivals


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("v"))).collect()]


def test_dates(spark):
    got = values(spark, lambda v: dates.normal_date(v, F.lit(2025)), "Feb 14, 2025", "14 Feb 2025", "2025-02-14", "02/14/2025", "February 14", "Feb 14, 2025 AOE", "", "soon")
    assert got == ["February 14, 2025"] * 6 + ["unknown", "soon"]
    assert values(spark, rules.date_range, "January 20 – January 27, 2026", "July 13 through July 19, 2025", "May 30 to June 2, 2025", "x") == ["January 20 - 27, 2026", "July 13 - 19, 2025", "May 30 - June 2, 2025", "x"]
    assert values(spark, rules.date_value, "Submission Deadline: Tue Jan 30th, 2025", "to be announced", "Fall 2025") == ["January 30, 2025", "TBD", "September-November 2025"]
    assert values(spark, lambda v: dates.short_date(v, F.lit("2025-06-15").cast("date")), "July 13-19", "March 2", "2025-02-14", "unknown") == ["Jul 13-19, 2025", "Mar 2, 2026", "Feb 14, 2025", "Unknown"]


def test_places(spark):
    raw = ["Vancouver Convention Center, Vancouver, Canada", "Limassol, Cyprus", "Rome, Italy", "San Diego, California", "Rotterdam, Netherlands", "Hong Kong SAR", "Denver, Colorado, USA", "unknown"]
    shown = values(spark, lambda v: rules.location(v)["display"], *raw)
    assert shown == ["Vancouver, Canada", "Limassol, Cyprus", "Italy", "Unknown", "Unknown", "Hong Kong, China", "Denver, US", "Unknown"]
    assert values(spark, lambda v: rules.location(v, whole_words=True, keep_short=True)["display"], "Rome, Italy", "Rotterdam, Netherlands", "San Diego, California") == ["Rome, Italy", "Rotterdam, Netherlands", "San Diego, US"]
    assert values(spark, rules.valid_location, "Vienna, Austria", "However, you", "January, 2026", "vienna, Austria") == [True, False, False, False]
    assert values(spark, rules.title_case, "saint-denis o'hara 5th") == ["Saint-Denis O'Hara 5Th"]


def test_addresses_and_text(spark):
    assert values(spark, text.url_filename, "https://icml.cc/Conferences/2025/CallForPapers", "https://neurips.cc/") == ["Conferences-2025-CallForPapers.txt", "neurips-cc.txt"]
    assert values(spark, text.trim_path, "http://a.org/x/y/z", "http://a.org/x") == ["http://a.org/x/y/", "http://a.org/x"]
    assert values(spark, lambda v: text.absolute(F.lit("http://a.org/d/p?q"), v), "/x#f", "y", "//b.org/z", "https://c.org", "?n") == ["http://a.org/x", "http://a.org/d/y", "http://b.org/z", "https://c.org", "http://a.org/d/p?n"]
    assert values(spark, lambda v: text.negated(v, "allowed"), "this is not allowed", "it is allowed") == [True, False]
    assert values(spark, lambda v: text.evidence(v, F.lit(8), F.lit(13)), "Before. Match here. After.") == ["...Match here...."]
    assert values(spark, text.nfkc, "ﬁn") == ["fin"]
    assert values(spark, pages.non_content, "short", "x" * 60, "page not found " + "x" * 60) == [True, False, True]


def test_cleaners_and_handlers(spark):
    assert values(spark, rules.page_number, "between 8 and 12 pages", "8-12 pages", "nine content pages", "none") == ["8-12 pages", "8-12 pages", "9 pages", "1 pages"]
    assert values(spark, rules.string_value, "will be held in Tangier, Morocco AISTATS", "Venue: Hong Kong, China The") == ["Tangier, Morocco", "Hong Kong, China"]
    assert values(spark, lambda v: rules.number_value(v, 1, 20), "at most 12 pages", "99", "none") == ["12", "unknown", "unknown"]
    assert values(spark, lambda v: rules.enum_value(v, ["required", "optional"], "artifact"), "artifacts must submit", "a badge") == ["required", "optional"]
    assert values(spark, lambda v: rules.not_stale(v, 2025), "May 1, 2020", "May 1, 2024") == ["unknown", "May 1, 2024"]
    assert values(spark, lambda v: rules.is_known(v, "site"), "not_mentioned", "x", None) == [False, True, False]


@pytest.mark.parametrize("parts", [4])
def test_anchors_leave_no_match_out(spark, parts):
    """The scan with anchors finds what a scan of every text with every pattern finds."""
    lines = ["Submission deadline: May 4, 2025.", "Papers due May 4, 2025", "not double-blind", "Reviewers remain anonymous", "no rebuttal", "held in Rome, Italy", "call for tutorials", "8 pages", "arXiv preprints are allowed", "author response period"]
    rows = spark.createDataFrame([(k, " ".join(lines[k % 10 :: parts])) for k in range(20)], "k int, text string")
    loose = fields_table(spark).withColumn("anchors", F.array(F.lit("")))
    got = scan.pattern_scan(rows, ["k"], fields_table(spark), patterns_table(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, scan.pattern_scan(rows, ["k"], loose, patterns_table(spark)).collect())) and got
    assert len(FIELDS) == len({f[0] for f in FIELDS})


def test_page_limits(spark):
    texts = ["main content 8 pages plus unlimited references and appendices", "should not exceed 8 pages, excluding references", "beyond the first 12 pages (not including references)", "limited to nine content pages, unlimited additional pages for references", "7 pages plus up to 2 pages for references"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    limits = classify.page_limit(rows, ["k"])
    assert [r["main_limit"] for r in limits.orderBy("k").collect()] == ["8 pages", "8 pages", "12 pages", "9 pages", "7 pages"]
    out = {(r["k"], r["kind"], r["pages"]) for r in classify.page_exclusions(limits, rows, ["k"]).collect()}
    assert {(0, "references", "unlimited"), (1, "references", "unlimited"), (2, "references", "unlimited"), (4, "references", "2 pages")} <= out


def test_merging_and_catalogue(spark):
    base = spark.createDataFrame([("A", 2025, "d", "Jan 30, 2025"), ("B", 2025, "d", "January 1, 2025")], "entity string, year int, field string, value string")
    fed = spark.createDataFrame([("A", 2025, "d", "January 30 2025"), ("B", 2025, "d", "May 2, 2025")], base.schema)
    got = {r["entity"]: (r["value"], r["source"], r["conflict"]) for r in merge.with_feeds(base, ["entity", "year"], [("feed", fed)]).collect()}
    assert got == {"A": ("January 30 2025", "feed", False), "B": ("May 2, 2025", "feed", True)}
    answers = spark.createDataFrame([("A", 1, '{"x": "yes", "y": {"value": "3", "evidence": "e"}}'), ("A", 2, '{"x": "no"}'), ("A", 3, "junk")], "entity string, batch int, response string")
    merged = {r["field"]: (r["value"], r["source"], r["conflict"]) for r in merge.merge_batches(merge.parse_answers(answers, ["entity"]), ["entity"]).collect()}
    assert merged == {"x": ("false", "llm_batch2", True), "y": ("3", "llm", False)} and merge.unparsed(answers).count() == 1
    rows = spark.createDataFrame([("A", 1, 10, None), ("B", 1, 30, "A")], "entity string, year int, completeness int, ccf string")
    assert [r["entity"] for r in catalogue.page(rows, "rank", 1).collect()] == ["B", "A"]
    assert reports.completeness(base, ["year"]).collect()[0]["percentage"] == 100.0


def test_streams(spark, tmp_path):
    schema = "filename string, text string, arrived timestamp"
    day = lambda s: spark.sql(f"select timestamp '{s}' t").first()["t"]
    spark.createDataFrame([("a", "One", day("2025-01-01")), ("b", "one ", day("2025-01-02"))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = arrivals.read_arrivals(spark, f"{tmp_path}/in/*", schema)
    arrivals.first_contents(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 1
    arrivals.write_upserts(stream, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    spark.createDataFrame([("a", "Two", day("2025-01-03")), ("b", "ONE", day("2025-01-03"))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    arrivals.write_upserts(arrivals.read_arrivals(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert sorted((r["filename"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "changed"), ("a", "new"), ("b", "new")]
