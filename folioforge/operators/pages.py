"""Operators over stored pages: filters, scores, first copies, best pages, upserts, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.fixed import (
    EXCLUDED_DOMAINS,
    LINK_STRONG_WORDS,
    LINK_TEXT_WORDS,
    LINK_URL_WORDS,
    PAPER_LIST_WEIGHTS,
    SKIP_CONTENT_TYPES,
    SKIP_EXTENSIONS,
    SKIP_HOSTS,
    SKIP_PATHS,
    TEXT_WEIGHTS,
    URL_WEIGHTS,
)
from folioforge.functions.references import decoded
from folioforge.functions.text import absolute, any_contains, occurrences, path_parts, url_host, url_path, weighted


def skip_url(url: Column) -> Column:
    low = F.lower(url)
    ends = low.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in SKIP_EXTENSIONS) + ")$")
    return ends | any_contains(low, SKIP_HOSTS + SKIP_PATHS)


def skip_content_type(kind: Column) -> Column:
    low = F.lower(kind)
    return (
        F.when(F.coalesce(kind, F.lit("")) == "", F.lit(False))
        .when(any_contains(low, ["text/html", "application/xhtml"]), F.lit(False))
        .when(any_contains(low, SKIP_CONTENT_TYPES), F.lit(True))
        .otherwise(~F.contains(low, F.lit("text/")))
    )


def non_content(text: Column, low: Column | None = None) -> Column:
    """Whether a page's text (low is its small form) is too short to say anything."""
    low, size = F.lower(text) if low is None else low, F.length(text)
    return (size < 50) | (any_contains(low, ["page not found", "404"]) & (size < 300)) | (F.contains(low, F.lit("coming soon")) & (size < 200))


def wrong_year(text: Column, year: Column) -> Column:
    low, this, after = F.lower(text), year.cast("string"), (year + 1).cast("string")
    return ((occurrences(low, after) > 0) & (occurrences(low, after) > 2 * occurrences(low, this))) | any_contains(low, ["historical record", "proceedings are available"])


def paper_list_page(text: Column) -> Column:
    low, size = F.lower(text), F.length(text)
    many = occurrences(low, "abstract") > 100
    huge = (size > 500_000) & F.contains(low, F.lit("accepted papers"))
    return (size >= 1000) & (many | huge | ((weighted(low, PAPER_LIST_WEIGHTS) >= 2) & (size > 100_000)))


def excluded_domain(url: Column) -> Column:
    return any_contains(url_host(url), EXCLUDED_DOMAINS)


def size_score(size: Column) -> Column:
    return F.when(size.between(3000, 30000), 30).when(size.between(1000, 2999), 15).when(size.between(30001, 100000), 10).otherwise(0)


def page_score(url: Column, text: Column, depth: Column, low: Column | None = None) -> Column:
    """Relevance: weights of the words in address and text (low is its small form), size, depth."""
    return weighted(F.lower(url), URL_WEIGHTS) + weighted(F.lower(text) if low is None else low, TEXT_WEIGHTS) + size_score(F.length(text)) + F.when(depth == 0, 20).when(depth == 1, 10).otherwise(0)


def link_related(url: Column, anchor: Column) -> Column:
    return url.rlike(f"(?i){LINK_URL_WORDS}") | anchor.rlike(f"(?i){LINK_TEXT_WORDS}")


def link_priority(url: Column, anchor: Column) -> Column:
    """10 for a strong word with words in both, 30 for a word in either, 50 for none."""
    u, a = url.rlike(f"(?i){LINK_URL_WORDS}"), anchor.rlike(f"(?i){LINK_TEXT_WORDS}")
    strong = url.rlike(f"(?i){LINK_STRONG_WORDS}") | anchor.rlike(f"(?i){LINK_STRONG_WORDS}")
    return F.when(strong & u & a, 10).when(u | a, 30).otherwise(50)


def homepage_score(url: Column, title: Column, short: Column, year: Column) -> Column:
    host, low, head, y, s = url_host(url), F.lower(url), F.lower(title), year.cast("string"), F.lower(short)
    depth = F.size(path_parts(url))
    score = F.when(F.array_contains(F.split(host, r"\."), s), 200).when(F.contains(host, s), 5).otherwise(0)
    score += F.when(F.contains(low, y), 10).otherwise(0) + F.when(F.contains(head, s), 5).otherwise(0) + F.when(F.contains(head, y), 3).otherwise(0)
    return score + F.when(depth == 0, 20).when(depth == 1, 15).when(depth == 2, 10).otherwise(0)


def other_year(text: Column, year: Column) -> Column:
    """Whether text names a year from the one before to two after, but for the year itself."""
    low = F.lower(text)
    out = F.lit(False)
    for d in (-1, 1, 2):
        out = out | F.contains(low, (year + d).cast("string"))
    return out


def best_homepage(hits: DataFrame) -> DataFrame:
    """(short, year, url, score): the best search hit of each; the first of equals; nothing at score 0. hits: short, year, rank, url, title."""
    ok = hits.where(F.col("url").isNotNull() & ~excluded_domain(F.col("url")) & ~other_year(F.col("url"), F.col("year")) & ~other_year(F.col("title"), F.col("year")))
    scored = ok.withColumn("score", homepage_score(F.col("url"), F.col("title"), F.col("short"), F.col("year"))).where("score > 0")
    order = Window.partitionBy("short", "year").orderBy(F.desc("score"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where("place = 1").select("short", "year", "url", "score")


def top_pages(scored: DataFrame, keys: list[str], k: int = 10, least: int = 100, tie: str = "url") -> DataFrame:
    """The k best pages of each key with a score of least; ties by address. Spark limits each task to k rows before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), tie)
    return scored.where(F.col("score") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def first_by_hash(rows: DataFrame, hash_: Column, order: list[str]) -> DataFrame:
    """(hash, the order columns, copies): the first row of each hash as the least struct, so that tasks pre-aggregate."""
    own = rows.groupBy(hash_.alias("hash")).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("copies"))
    return own.select("hash", "first.*", "copies")


def upsert(old: DataFrame, new: DataFrame, key: str = "filename") -> DataFrame:
    """(key, status, hash): new, changed, unchanged or kept for each file of either side."""
    o, n = old.select(key, F.col("hash").alias("old_hash")), new.select(key, F.col("hash").alias("new_hash"))
    status = F.when(F.col("new_hash").isNull(), "kept").when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, status.alias("status"), F.coalesce("new_hash", "old_hash").alias("hash"))


def fresh_snapshots(snapshots: DataFrame, key: str, at: str, value: str, as_of: Column, ttl: int = 86_400) -> DataFrame:
    """The newest snapshot of each key, if younger than ttl seconds."""
    newest = snapshots.groupBy(key).agg(F.max(F.struct(at, value)).alias("newest"))
    return newest.where(F.unix_timestamp(as_of) - F.unix_timestamp(f"newest.{at}") < ttl).select(key, f"newest.{at}", f"newest.{value}")


def suffixed(rows: DataFrame, name: Column, order: list[str]) -> DataFrame:
    """rows with filename; the second of a name gets -1, the third -2."""
    own = rows.withColumn("_name", name)
    n = F.row_number().over(Window.partitionBy("_name").orderBy(*order)) - 1
    stem = F.regexp_replace("_name", r"\.txt$", "")
    return own.withColumn("_n", n).withColumn("filename", F.when(F.col("_n") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), F.lit(".txt")))).drop("_name", "_n")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, src, dst, anchor) of each a[href], quoted in either way or not at all; character references are decoded."""
    rx = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>"""
    groups = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(rx), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3, 4)])
    got = pages.where("html is not null and url is not null").select("page_id", "url", F.posexplode(groups).alias("place", "link"))
    href = F.trim(decoded(F.concat("link.g1", "link.g2", "link.g3")))  # one of them is not empty, or none
    anchor = F.trim(F.regexp_replace(decoded(F.regexp_replace("link.g4", r"(?s)<[^>]*>", "")), r"\s+", " "))
    return got.select("page_id", "place", F.col("url").alias("src"), absolute(F.col("url"), href).alias("dst"), anchor.alias("anchor"))


def link_admissible(src: Column, dst: Column, anchor: Column, depth: Column, home_path: Column) -> Column:
    """Same host, not skipped; below the first level under the homepage's path, or with a link word."""
    deeper = F.startswith(url_path(dst), home_path) | link_related(dst, anchor)
    return (url_host(src) == url_host(dst)) & ~skip_url(dst) & ((depth == 0) | deeper)
