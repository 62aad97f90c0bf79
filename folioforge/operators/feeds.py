"""Structured feeds: labelled rows, result lists, nested timelines, home page back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Submission systems in the order in which they are looked for.
SYSTEMS = ["OpenReview", "EasyChair", "CMT", "HotCRP", "SoftConf"]
_ROW = r"<tr><th>([^<]*)</th><td>([^<]*)</td></tr>"


def event_fields(pages: DataFrame) -> DataFrame:
    """(page_id, dates, location, submission_deadline, notification) from rows of a heading and a value."""
    rows = F.arrays_zip(F.regexp_extract_all("html", F.lit(_ROW), F.lit(1)).alias("label"), F.regexp_extract_all("html", F.lit(_ROW), F.lit(2)).alias("value"))
    own = pages.select("page_id", F.explode(rows).alias("r")).select("page_id", F.lower("r.label").alias("label"), "r.value")
    of = lambda c, name: F.max(F.when(c, F.col("value"))).alias(name)
    label = F.col("label")
    return own.groupBy("page_id").agg(
        of(label == "when", "dates"), of(label == "where", "location"), of(label.contains("submission"), "submission_deadline"), of(label.contains("notification"), "notification")
    )


def paired_rows(pages: DataFrame, short: str) -> DataFrame:
    """(page_id, place, title, dates, location): each result row with the row behind it, titles that are short without their year."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1))).alias("place", "row"))
    cells = F.regexp_extract_all("row", F.lit("<td>([^<]*)</td>"), F.lit(1))
    behind = F.lead(cells).over(Window.partitionBy("page_id").orderBy("place"))
    got = rows.withColumn("cells", cells).withColumn("next", behind)
    title = F.get("cells", F.lit(0))
    same = F.lower(F.trim(F.regexp_replace(title, r"\b(19|20)\d\d\b", ""))) == short.lower()
    return got.where(same & (F.size("next") >= 2)).select("page_id", "place", title.alias("title"), F.get("next", F.lit(0)).alias("dates"), F.get("next", F.lit(1)).alias("location"))


def year_entry(feeds: DataFrame, year: Column) -> DataFrame:
    """feeds (conf, confs array of structs with year) to the first entry of the year, flattened."""
    rows = feeds.select("conf", F.posexplode("confs").alias("place", "c")).where(F.col("c.year") == year)
    first = rows.groupBy("conf").agg(F.min_by("c", "place").alias("c"))
    return first.select("conf", "c.*")


def timeline_value(timeline: Column, field: str) -> Column:
    """A value of the first timeline entry."""
    return F.get(timeline, F.lit(0))[field]


def system_of(timeline: Column) -> Column:
    """The first known submission system that a timeline's comments name, by entry, then by order of the systems."""
    named = F.transform(timeline, lambda e: F.coalesce(*[F.when(F.contains(F.lower(e["comment"]), F.lit(s.lower())), F.lit(s)) for s in SYSTEMS]))
    return F.get(F.filter(named, lambda s: s.isNotNull()), F.lit(0))


def backfilled(homepages: DataFrame, links: DataFrame) -> DataFrame:
    """homepages (short, year, domain) with blank domains from links (short, year, link), scheme and last slash cut; filled says which."""
    bare = F.regexp_replace(F.regexp_replace("link", r"^https?://", ""), r"/$", "")
    known = F.nullif(F.trim("domain"), F.lit(""))
    got = homepages.join(links.select("short", "year", bare.alias("bare")), ["short", "year"], "left")
    return got.select("short", "year", F.coalesce(known, "bare").alias("domain"), (known.isNull() & F.col("bare").isNotNull()).alias("filled"))


def domain_issue(domain: Column) -> Column:
    """The code of a malformed domain, null for a good or blank one."""
    return (
        F.when(F.coalesce(F.trim(domain), F.lit("")) == "", F.lit(None).cast("string"))
        .when(domain.rlike(r"^https?://"), F.lit("SCHEME"))
        .when(domain.rlike(r"[\s<>\"|{}^`\\]"), F.lit("CHARACTERS"))
        .when(~domain.rlike(r"[./]"), F.lit("FORMAT"))
    )
