"""Queries over the page archive, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as t
from folioforge.functions.fixed import (
    DROPPED_TAGS,
    DROPPED_TAGS_FLAT,
    EXCLUDED_DOMAINS,
    LINE_TAGS,
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
from folioforge.operators import pages as p
from folioforge.operators import walk as w
from folioforge.sources.tables import policy_text, table
from folioforge.plans.views import POLICY

# ---- SQL fragments of the twins -------------------------------------------------------------------------------------------


def sql_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def sql_weighted(col: str, weights: list[tuple[str, int]]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({col}, '{w}') THEN {n} ELSE 0 END" for w, n in weights) + ")"


def sql_dropped(col: str, tags: list[str]) -> str:
    out = f"regexp_replace({col}, '(?s)<!--.*?-->', '', 'g')"
    for tag in tags:
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return out


def sql_decoded(col: str) -> str:
    """The references that the stored pages hold, ampersands last."""
    for a, b in (("&nbsp;", "\u00a0"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        col = f"replace({col}, '{a}', '{b}')"
    return f"regexp_replace({col}, '&amp;?', '&', 'g')"


def sql_trim(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


HTML_TEXT = sql_trim(
    r"regexp_replace(regexp_replace("
    + sql_decoded(rf"regexp_replace(regexp_replace({sql_dropped('html', DROPPED_TAGS)}, '(?i)<({'|'.join(LINE_TAGS)})\b', E'\n<\\1', 'g'), '(?s)<[^>]*>', ' ', 'g')")
    + r", '[ \t]+', ' ', 'g'), '\s*\n\s*', E'\n', 'g')"
)
HTML_FLAT = sql_trim(r"regexp_replace(" + sql_decoded(rf"regexp_replace({sql_dropped('html', DROPPED_TAGS_FLAT)}, '(?s)<[^>]*>', '', 'g')") + r", '\s+', ' ', 'g')")
HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SCHEME = "regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
PARTS = f"list_filter(string_split({PATH}, '/'), lambda x: x <> '')"
SKIP = "(regexp_matches(lower({0}), '(?:" + "|".join(e.replace(".", r"\.") for e in SKIP_EXTENSIONS) + ")$') OR " + sql_any("lower({0})", SKIP_HOSTS + SKIP_PATHS) + ")"
HASH = r"sha256(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'))"
SIZE = "CASE WHEN {0} BETWEEN 3000 AND 30000 THEN 30 WHEN {0} BETWEEN 1000 AND 2999 THEN 15 WHEN {0} BETWEEN 30001 AND 100000 THEN 10 ELSE 0 END"
SCORE = f"({sql_weighted('lower(url)', URL_WEIGHTS)} + {sql_weighted('lower(text)', TEXT_WEIGHTS)} + {SIZE.format('length(text)')} + CASE depth WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 0 END)"
FILENAME = (
    f"(CASE WHEN len({PARTS}) = 0 THEN translate({HOST}, '.:', '--') ELSE "
    f"regexp_replace(regexp_replace(regexp_replace(array_to_string({PARTS}, '-'), '[^a-zA-Z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') END || '.txt')"
)
COUNT = "((length({0}) - length(replace({0}, {1}, ''))) // length({1}))"
LINKS = rf"""links AS (
  SELECT page_id, (i - 1)::INT AS place, url AS src, hrefs[i] AS href, trim(regexp_replace({sql_decoded("regexp_replace(anchors[i], '(?s)<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')) AS anchor,
    regexp_replace(trim({sql_decoded("hrefs[i]")}), '#.*$', '') AS bare
  FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url,
    regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS anchors FROM pages))),
resolved AS (SELECT page_id, place, src, anchor, CASE WHEN regexp_matches(bare, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN bare WHEN starts_with(bare, '//') THEN {SCHEME.format("src")} || ':' || bare
  WHEN starts_with(bare, '/') THEN {SCHEME.format("src")} || '://' || {HOST.format("src")} || bare WHEN bare = '' THEN regexp_replace(src, '#.*$', '')
  WHEN starts_with(bare, '?') THEN {SCHEME.format("src")} || '://' || {HOST.format("src")} || {PATH.format("src")} || bare
  ELSE regexp_replace({SCHEME.format("src")} || '://' || {HOST.format("src")} || CASE WHEN {PATH.format("src")} = '' THEN '/' ELSE {PATH.format("src")} END, '[^/]*$', '') || bare END AS dst FROM links)"""
RELATED = f"(regexp_matches(dst, '(?i){LINK_URL_WORDS}') OR regexp_matches(anchor, '(?i){LINK_TEXT_WORDS}'))"
PRIORITY = (
    f"CASE WHEN (regexp_matches(dst, '(?i){LINK_STRONG_WORDS}') OR regexp_matches(anchor, '(?i){LINK_STRONG_WORDS}')) AND regexp_matches(dst, '(?i){LINK_URL_WORDS}') "
    f"AND regexp_matches(anchor, '(?i){LINK_TEXT_WORDS}') THEN 10 WHEN {RELATED} THEN 30 ELSE 50 END"
)


# ---- Queries ------------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", t.html_text(F.col("html")).alias("text"))


def html_text_flat(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", t.html_text_flat(F.col("html")).alias("text"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return p.page_links(_pages(spark, d))


def link_admissible(spark: SparkSession, d: str) -> DataFrame:
    depth, home = F.col("page_id") % 3, F.concat(F.lit("/"), F.coalesce(F.get(t.path_parts(F.col("src")), F.lit(0)), F.lit("")))
    links = p.page_links(_pages(spark, d)).withColumn("depth", depth).withColumn("home", home)
    return links.select("page_id", "place", p.link_admissible(F.col("src"), F.col("dst"), F.col("anchor"), F.col("depth"), F.col("home")).alias("ok"))


def link_priority(spark: SparkSession, d: str) -> DataFrame:
    return p.page_links(_pages(spark, d)).groupBy(p.link_priority(F.col("dst"), F.col("anchor")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages, links) of sites: addresses that say what some pages are about, and beside the stored links those of a tree over each host's pages."""
    about = F.when(F.col("page_id") % 4 == 0, "/call-for-papers").when(F.col("page_id") % 4 == 1, "/submission").otherwise("")
    pages = _pages(spark, d).where("url is not null").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), about).alias("url"), t.url_host(F.col("url")).alias("host"))
    r = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    numbered = pages.withColumn("r", r)
    below = numbered.select("host", F.col("url").alias("src"), F.posexplode(F.array(F.col("r") * 2, F.col("r") * 2 + 1, F.col("r") * 3 + 2)).alias("place", "r"))
    anchor = F.when(F.col("page_id") % 3 == 0, "Call for Papers").when(F.col("page_id") % 3 == 1, "News").otherwise("Program")
    tree = below.join(numbered.select("host", "r", "page_id", F.col("url").alias("dst")), ["host", "r"]).select("src", "dst", anchor.alias("anchor"), (F.col("place") + 1000).alias("place"))
    stored = p.page_links(_pages(spark, d)).join(pages.select("page_id", "url"), "page_id").select(F.col("url").alias("src"), "dst", "anchor", "place")
    return pages, stored.union(tree)


def frontier(spark: SparkSession, d: str) -> DataFrame:
    """What a best-first walk of each site reads, where only stored pages can be read."""
    pages, links = _sites(spark, d)
    return w.walk(w.first_pages(pages), links, stored=pages.select("url"))


def frontier_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The walk with further seeds, all addresses readable: a feed names a page of every site, some of them with spaces or blank."""
    pages, links = _sites(spark, d)
    homes = w.first_pages(pages)
    link = F.when(F.col("page_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "url"))
    feed = pages.where("page_id % 9 = 0").select(F.col("host").alias("site"), link.alias("link"))
    return w.walk(homes, links, seeds=w.feed_seeds(homes, feed))


def skip_url(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ["", "/a.PDF", "/proceedings/", "/cfp", "/x.svg"])), (F.col("page_id") % 5 + 1).cast("int"))
    return _pages(spark, d).select("page_id", p.skip_url(F.concat("url", tail)).alias("skip"))


def url_filename(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", t.url_filename(F.col("url")).alias("filename"))


def trim_path(spark: SparkSession, d: str) -> DataFrame:
    deep = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(F.col("page_id") % 2 == 0, "/a/b").otherwise(""))
    return _pages(spark, d).select("page_id", t.trim_path(deep).alias("url"))


def excluded_domain(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 4 == 0, F.lit("https://www.Reddit.com/r/x")).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", p.excluded_domain(url).alias("excluded"))


def non_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", p.non_content(F.coalesce("text", F.lit(""))).alias("empty_page"))


def paper_list_page(spark: SparkSession, d: str) -> DataFrame:
    # every twentieth text gets the words of a paper list, so that both outcomes occur
    text = F.when(F.col("doc_id") % 20 == 0, F.repeat(F.concat(F.lit("Accepted papers. Abstract: "), "text", F.lit(" ")), 110)).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", p.paper_list_page(text).alias("paper_list"))


def wrong_year(spark: SparkSession, d: str) -> DataFrame:
    rows = policy_text(spark, d).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), " ").alias("text"))
    years = F.explode(F.sequence(F.lit(1992), F.lit(1998)))
    return rows.select("entity", "text", years.alias("year")).select("entity", "year", p.wrong_year(F.col("text"), F.col("year")).alias("wrong"))


def skip_content_type(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["text/html; charset=utf-8", "application/pdf", "", "image/png", "application/json", "text/plain", "application/xhtml+xml"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 7 + 1).cast("int"))
    return _pages(spark, d).select("page_id", p.skip_content_type(kind).alias("skip"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, score, empty, hash) of each page; its text is made once, and never leaves the row."""
    rows = _pages(spark, d).where("html is not null and url is not null").select("page_id", "url", "html", (F.col("page_id") % 3).alias("depth"))

    def judged(text):
        return t.let(F.lower(text), lambda low: F.struct(p.page_score(F.col("url"), text, F.col("depth"), low).cast("long").alias("score"), p.non_content(text, low).alias("empty"), t.hash_norm(text).alias("hash")))

    return rows.select("page_id", "url", t.let(t.html_text(F.col("html")), judged).alias("s")).select("page_id", "url", "s.*")


def score_page(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("page_id", "score")


def score_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(p.size_score(F.length(F.coalesce("text", F.lit("")))).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def best_pages(spark: SparkSession, d: str, k: int = 10, least: int = 20) -> DataFrame:
    """The flagship: text of each page, no empty pages, score, first copy of each content, the best k of each host."""
    rows = _scored(spark, d).where("not empty").withColumn("host", t.url_host(F.col("url"))).withColumn("minus", -F.col("score"))
    first = p.first_by_hash(rows.withColumnRenamed("hash", "own"), F.col("own"), ["minus", "url", "page_id", "host", "score"])
    return p.top_pages(first, ["host"], k, least).select("host", "place", "page_id", "score")


def best_homepage(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).where("url is not null")
    hits = pages.select(t.url_host(F.col("url")).alias("host"), (F.col("page_id") % 40).alias("g"), F.col("page_id").alias("rank"), "url")
    hits = hits.select(F.concat(F.lit("th"), F.col("g").cast("string")).alias("short"), F.lit(2025).alias("year"), "rank", F.when(F.col("rank") % 3 == 0, F.concat(F.lit("http://th"), F.col("g").cast("string"), F.lit(".example.org/2025/"))).otherwise(F.col("url")).alias("url"), F.lit("Home").alias("title"))
    return p.best_homepage(hits).select("short", "url", F.col("score").cast("long").alias("score"))


def hash_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.hash_norm(F.col("text")).alias("hash"))


def hash_raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.hash_raw(F.col("text")).alias("hash"))



def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return p.first_by_hash(table(spark, d, "documents"), t.hash_norm(F.col("text")), ["doc_id"])


def dedup_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", t.hash_raw(F.col("text")).alias("hash"))
    seen, new = rows.where("doc_id % 2 = 0").select("hash").distinct(), rows.where("doc_id % 2 = 1")
    return new.join(seen, "hash", "left_anti").select("doc_id", "hash")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_distinct(t.hash_raw(F.col("text"))).alias("unique_hashes"), F.count(F.lit(1)).alias("n_docs"))


def upsert_status(spark: SparkSession, d: str) -> DataFrame:
    """Documents with even ids are the old files, those with odd ids the new ones; every sixth new file has a name of its own."""
    rows = table(spark, d, "documents").select("doc_id", (F.floor(F.col("doc_id") / 2) * 2).alias("slot"), t.hash_norm(F.col("text")).alias("hash"))
    side = lambda r: rows.where(F.col("doc_id") % 2 == r).select(F.concat(F.lit("f"), (F.col("slot") + F.when((F.col("slot") % 12 == 0) & (F.lit(r) == 1), 1).otherwise(0)).cast("string")).alias("filename"), "hash")
    return p.upsert(side(0), side(1))


def cache_fresh(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("user_id is not null and ts is not null")
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp")
    got = p.fresh_snapshots(events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", as_of, 86_400 * 30)
    return got.select("user_id", "event_id")


def latest_result(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("user_id is not null and ts is not null")
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select("user_id", "l.event_id", "l.event_type")


def filename_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).where("url is not null").select("page_id", "url")
    return p.suffixed(rows, t.url_filename(F.col("url")), ["page_id"]).select("page_id", "filename")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.clean_text(F.concat(F.lit("|Back to Top|\n=====\n"), "text", F.lit("\n\n\n\nx"))).alias("text"))


def event_fields(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows of a stored event page: heading elements and the text behind them."""
    page = F.concat(F.lit("<tr><th>When</th><td>Jul "), (F.col("page_id") % 28 + 1).cast("string"), F.lit(", 2025</td></tr><tr><th>Where</th><td>City"), (F.col("page_id") % 9).cast("string"), F.lit("</td></tr><tr><th>Submission Deadline</th><td>Jan 5, 2025</td></tr>"))
    from folioforge.operators.feeds import event_fields as fields

    return fields(_pages(spark, d).select("page_id", F.concat("html", page).alias("html")))


def search_rows_lead(spark: SparkSession, d: str) -> DataFrame:
    from folioforge.operators.feeds import paired_rows

    page = F.concat(F.lit("<table><tr><td>ABC "), (F.col("page_id") % 4 + 2023).cast("string"), F.lit("</td></tr><tr><td>Jul 1</td><td>Town"), (F.col("page_id") % 5).cast("string"), F.lit("</td></tr><tr><td>XYZ 2025</td></tr><tr><td>Aug 2</td><td>Village</td></tr></table>"))
    return paired_rows(_pages(spark, d).select("page_id", page.alias("html")), "abc")


_DEDUP = f"SELECT {HASH.format('text')} AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"
_SCORED = f"scored AS (SELECT *, {SCORE}::BIGINT AS score FROM (SELECT page_id, url, {HTML_TEXT} AS text, page_id % 3 AS depth FROM pages WHERE html IS NOT NULL AND url IS NOT NULL))"
_NON = "(length({0}) < 50 OR ((contains(lower({0}), 'page not found') OR contains(lower({0}), '404')) AND length({0}) < 300) OR (contains(lower({0}), 'coming soon') AND length({0}) < 200))"
_STRIPPED = "regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '/call-for-papers' WHEN 1 THEN '/submission' ELSE '' END"


def _frontier_sql(seeds: str = "", stored: str = "") -> str:
    """A walk for each site by recursion: a row's heap is a sorted list, its head is read next."""
    entry = "{{'priority': {}, 'found': {}, 'place': {}, 'url': {}, 'depth': {}}}"
    near = f"(starts_with({PATH.format('dst')}, home_path) OR {RELATED})"
    return f"""WITH RECURSIVE {LINKS}, own AS (SELECT page_id, {_STRIPPED} AS url, {HOST.format("url")} AS host FROM pages WHERE url IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM own),
tree AS (SELECT a.url AS src, b.url AS dst, ['Call for Papers', 'News', 'Program'][b.page_id % 3 + 1] AS anchor, 1000 + i AS place
  FROM (SELECT *, unnest([r * 2, r * 2 + 1, r * 3 + 2]) AS c, unnest([0, 1, 2]) AS i FROM numbered) a JOIN numbered b ON a.host = b.host AND a.c = b.r),
every AS (SELECT o.url AS src, dst, anchor, place FROM resolved JOIN own o USING (page_id) UNION ALL SELECT src, dst, anchor, place FROM tree),
home AS (SELECT host AS site, arg_min(url, page_id) AS url FROM own GROUP BY 1),
paths AS (SELECT site, {HOST.format("url")} AS host, regexp_replace({PATH.format("url")}, '/+$', '') AS home_path FROM home),
kept AS (SELECT h.site, src, {PRIORITY} AS priority, place, dst, {near} AS near FROM every JOIN paths h ON h.host = {HOST.format("dst")} WHERE NOT {SKIP.format("dst")}{stored}),
edges AS (SELECT site, src, list({{'priority': priority, 'place': place, 'dst': dst, 'near': near}}) AS links FROM kept GROUP BY 1, 2),
start AS (SELECT site, {entry.format(0, 0, 0, "url", 0)} AS e FROM home{seeds}),
walk AS (
  SELECT site, 1 AS n, h[1] AS cur, h[2:] AS rest, [h[1].url] AS seen FROM (SELECT site, list(e ORDER BY e) AS h FROM start GROUP BY 1)
  UNION ALL
  SELECT site, n + 1, h[1], list_filter(h, lambda x: x.url <> h[1].url), list_append(seen, h[1].url) FROM (
    SELECT k.site, n, seen, list_sort(list_filter(list_concat(rest, CASE WHEN cur.depth < 3 AND links IS NOT NULL
      THEN list_transform(list_filter(links, lambda l: cur.depth = 0 OR l.near), lambda l: {entry.format("l.priority", "n", "l.place", "l.dst", "cur.depth + 1")}) ELSE [] END),
      lambda x: NOT list_contains(seen, x.url))) AS h
    FROM walk k LEFT JOIN edges e ON e.site = k.site AND e.src = k.cur.url) WHERE len(h) > 0 AND n < 15)
SELECT site, cur.url AS url, cur.depth::INT AS depth, cur.priority::INT AS priority, n::INT AS place FROM walk"""


_FED = "(SELECT DISTINCT o.host AS site, o.url FROM own o JOIN home h ON h.site = o.host AND h.url <> o.url WHERE o.page_id % 9 = 0 AND o.page_id % 5 <> 0)"
_SEEDED = " UNION ALL SELECT site, {'priority': 5, 'found': 0, 'place': row_number() OVER (PARTITION BY site ORDER BY url), 'url': url, 'depth': 0} FROM " + _FED

_EVENT_PAGE = "html || '<tr><th>When</th><td>Jul ' || (page_id % 28 + 1) || ', 2025</td></tr><tr><th>Where</th><td>City' || (page_id % 9) || '</td></tr><tr><th>Submission Deadline</th><td>Jan 5, 2025</td></tr>'"
_COUNTS = COUNT.format("lower(text)", "(year + 1)::VARCHAR"), COUNT.format("lower(text)", "year::VARCHAR")
_HIT = (
    "SELECT 'th' || (page_id % 40) AS short, page_id AS rank, CASE WHEN page_id % 3 = 0 THEN 'http://th' || (page_id % 40) || '.example.org/2025/' ELSE url END AS url FROM pages WHERE url IS NOT NULL"
)

QUERIES = {
    "html_text": (html_text, f"SELECT page_id, {HTML_TEXT} AS text FROM pages"),
    "html_text_flat": (html_text_flat, f"SELECT page_id, {HTML_FLAT} AS text FROM pages"),
    "page_links": (page_links, f"WITH {LINKS} SELECT page_id, place, src, dst, anchor FROM resolved"),
    "link_admissible": (
        link_admissible,
        f"WITH {LINKS} SELECT page_id, place, {HOST.format('src')} = {HOST.format('dst')} AND NOT {SKIP.format('dst')} AND (page_id % 3 = 0 OR starts_with({PATH.format('dst')}, '/' || coalesce({PARTS.format('src')}[1], '')) OR {RELATED}) AS ok FROM resolved",
    ),
    "link_priority": (link_priority, f"WITH {LINKS} SELECT ({PRIORITY})::INT AS priority, count(*) AS n FROM resolved GROUP BY 1"),
    "frontier": (frontier, _frontier_sql(stored=" AND dst IN (SELECT url FROM own)")),
    "frontier_seeds": (frontier_seeds, _frontier_sql(_SEEDED)),
    "skip_url": (skip_url, f"SELECT page_id, {SKIP.format('u')} AS skip FROM (SELECT page_id, url || ['', '/a.PDF', '/proceedings/', '/cfp', '/x.svg'][page_id % 5 + 1] AS u FROM pages)"),
    "url_filename": (url_filename, f"SELECT page_id, {FILENAME.format('url')} AS filename FROM pages"),
    "trim_path": (
        trim_path,
        f"SELECT page_id, CASE WHEN len({PARTS.format('u')}) > 2 THEN {SCHEME.format('u')} || '://' || {HOST.format('u')} || '/' || array_to_string({PARTS.format('u')}[1:2], '/') || '/' ELSE u END AS url "
        r"FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 2 = 0 THEN '/a/b' ELSE '' END AS u FROM pages)",
    ),
    "excluded_domain": (excluded_domain, f"SELECT page_id, {sql_any(HOST.format('u'), EXCLUDED_DOMAINS)} AS excluded FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://www.Reddit.com/r/x' ELSE url END AS u FROM pages)"),
    "non_content": (non_content, f"SELECT doc_id, {_NON.format('text')} AS empty_page FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"),
    "paper_list_page": (
        paper_list_page,
        f"SELECT doc_id, length(text) >= 1000 AND ({COUNT.format('lower(text)', chr(39) + 'abstract' + chr(39))} > 100 OR (length(text) > 500000 AND contains(lower(text), 'accepted papers')) OR ({sql_weighted('lower(text)', PAPER_LIST_WEIGHTS)} >= 2 AND length(text) > 100000)) AS paper_list "
        "FROM (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN repeat('Accepted papers. Abstract: ' || text || ' ', 110) ELSE text END AS text FROM documents)",
    ),
    "wrong_year": (
        wrong_year,
        POLICY + f", joined AS (SELECT entity, string_agg(text, ' ' ORDER BY k) AS text FROM policy GROUP BY 1) SELECT entity, year, ({_COUNTS[0]} > 0 AND {_COUNTS[0]} > 2 * {_COUNTS[1]}) OR {sql_any('lower(text)', ['historical record', 'proceedings are available'])} AS wrong FROM (SELECT *, unnest(range(1992, 1999))::INT AS year FROM joined)",
    ),
    "skip_content_type": (
        skip_content_type,
        f"SELECT page_id, CASE WHEN kind = '' THEN false WHEN {sql_any('lower(kind)', ['text/html', 'application/xhtml'])} THEN false WHEN {sql_any('lower(kind)', SKIP_CONTENT_TYPES)} THEN true ELSE NOT contains(lower(kind), 'text/') END AS skip "
        "FROM (SELECT page_id, ['text/html; charset=utf-8', 'application/pdf', '', 'image/png', 'application/json', 'text/plain', 'application/xhtml+xml'][page_id % 7 + 1] AS kind FROM pages)",
    ),
    "score_page": (score_page, f"WITH {_SCORED} SELECT page_id, score FROM scored"),
    "score_size": (score_size, f"SELECT ({SIZE.format('length(text)')})::INT AS score, count(*) AS n FROM (SELECT coalesce(text, '') AS text FROM documents) GROUP BY 1"),
    "topk_pages": (
        best_pages,
        f"WITH {_SCORED}, first AS (SELECT *, row_number() OVER (PARTITION BY {HASH.format('text')} ORDER BY score DESC, url, page_id) AS r FROM scored WHERE NOT {_NON.format('text')}), "
        f"best AS (SELECT *, {HOST.format('url')} AS host, row_number() OVER (PARTITION BY {HOST.format('url')} ORDER BY score DESC, url) AS place FROM first WHERE r = 1 AND score >= 20) SELECT host, place::INT AS place, page_id, score FROM best WHERE place <= 10",
    ),
    "best_homepage": (
        best_homepage,
        f"WITH hits AS ({_HIT}), ok AS (SELECT *, {HOST.format('url')} AS host FROM hits WHERE NOT {sql_any(HOST.format('url'), EXCLUDED_DOMAINS)} AND NOT (contains(lower(url), '2024') OR contains(lower(url), '2026') OR contains(lower(url), '2027'))), "
        f"s AS (SELECT *, (CASE WHEN list_contains(string_split(host, '.'), short) THEN 200 WHEN contains(host, short) THEN 5 ELSE 0 END + CASE WHEN contains(lower(url), '2025') THEN 10 ELSE 0 END + CASE len({PARTS.format('url')}) WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 10 ELSE 0 END)::BIGINT AS score FROM ok) "
        "SELECT short, url, score FROM (SELECT *, row_number() OVER (PARTITION BY short ORDER BY score DESC, rank) AS r FROM s WHERE score > 0) WHERE r = 1",
    ),
    "hash_norm": (hash_norm, f"SELECT doc_id, {HASH.format('text')} AS hash FROM documents"),
    "hash_raw": (hash_raw, "SELECT doc_id, md5(text) AS hash FROM documents"),
    "dedup_first": (dedup_first, _DEDUP),
    "dedup_anti": (dedup_anti, "SELECT doc_id, md5(text) AS hash FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)"),
    "dedup_stats": (dedup_stats, "SELECT count(DISTINCT md5(text)) AS unique_hashes, count(*) AS n_docs FROM documents"),
    "upsert_status": (
        upsert_status,
        f"WITH h AS (SELECT doc_id, doc_id // 2 * 2 AS slot, {HASH.format('text')} AS hash FROM documents), o AS (SELECT 'f' || slot AS filename, hash AS a FROM h WHERE doc_id % 2 = 0), "
        "n AS (SELECT 'f' || (slot + CASE WHEN slot % 12 = 0 THEN 1 ELSE 0 END) AS filename, hash AS b FROM h WHERE doc_id % 2 = 1) "
        "SELECT filename, CASE WHEN b IS NULL THEN 'kept' WHEN a IS NULL THEN 'new' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS status, coalesce(b, a) AS hash FROM o FULL JOIN n USING (filename)",
    ),
    "cache_fresh": (
        cache_fresh,
        "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE r = 1 AND floor(epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(ts))) < 86400 * 30",
    ),
    "latest_result": (latest_result, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE r = 1"),
    "filename_suffix": (
        filename_suffix,
        f"SELECT page_id, CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.txt$', '') || '-' || n || '.txt' END AS filename FROM (SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS n FROM (SELECT page_id, {FILENAME.format('url')} AS name FROM pages WHERE url IS NOT NULL))",
    ),
    "clean_text": (
        clean_text,
        "SELECT doc_id, "
        + sql_trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace('|Back to Top|' || chr(10) || '=====' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'x', chr(8203), ''), chr(65279), ''), '[\x{2028}\x{2029}]', chr(10), 'g'), '(?i)\|back to top\|', '', 'g'), '(?m)^[=\-]{4,}$', '', 'g'), '[ \t\r\f]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
        + " AS text FROM documents",
    ),
    "event_fields": (
        event_fields,
        rf"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(h, '<tr><th>([^<]*)</th><td>([^<]*)</td></tr>', 1)) AS label, unnest(regexp_extract_all(h, '<tr><th>([^<]*)</th><td>([^<]*)</td></tr>', 2)) AS val FROM (SELECT page_id, {_EVENT_PAGE} AS h FROM pages))
SELECT page_id, max(CASE WHEN lower(label) = 'when' THEN val END) AS dates, max(CASE WHEN lower(label) = 'where' THEN val END) AS location, max(CASE WHEN contains(lower(label), 'submission') THEN val END) AS submission_deadline, max(CASE WHEN contains(lower(label), 'notification') THEN val END) AS notification FROM r GROUP BY 1""",
    ),
    "search_rows_lead": (
        search_rows_lead,
        "SELECT page_id, 0 AS place, 'ABC ' || (page_id % 4 + 2023) AS title, 'Jul 1' AS dates, 'Town' || (page_id % 5) AS location FROM pages",
    ),
}
