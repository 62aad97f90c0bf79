"""Queries of the catalogue and the structured sources, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.rules import is_known
from folioforge.operators import catalogue as c
from folioforge.operators import feeds
from folioforge.plans.rules import KEYS, merged, rules
from folioforge.plans.views import POLICY, RULES
from folioforge.sources.archive import homepages as unpivoted
from folioforge.sources import feeds as feeds_of
from folioforge.sources.tables import policy_text, table

_WIDE = ["submission_deadline", "page_limit", "double_blind", "rebuttal_allowed", "conference_location"]


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """(n, short, name, area, ccf) made of nations: names in mixed case, and some of them twice."""
    rows = table(spark, d, "nation").crossJoin(spark.range(2).select(F.col("id").alias("twice"))).where("twice = 0 or n_nationkey % 10 = 0")
    n = F.col("n_nationkey")
    rank = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit(None).cast("string")), (n % 4 + 1).cast("int"))
    return rows.select((n + 100 * F.col("twice")).alias("n"), F.concat(F.lit("Conf"), n.cast("string")).alias("short"), F.concat("n_name", F.when(F.col("twice") == 1, " II").otherwise("")).alias("name"), F.col("n_regionkey").cast("string").alias("area"), rank.alias("ccf"))


def homepages(spark: SparkSession, d: str) -> DataFrame:
    """Wide home pages: one column for each year."""
    n = F.col("n_nationkey")
    columns = [F.when((n + y) % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("conf"), n.cast("string"), F.lit(f".org/{y}"))).alias(f"domain{y}") for y in (1995, 1996, 1997)]
    return table(spark, d, "nation").select(F.concat(F.lit("Conf"), n.cast("string")).alias("short"), *columns)


def areas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("area"), F.col("r_name").alias("area_title"))


def wide(spark: SparkSession, d: str) -> DataFrame:
    rows = merged(spark, d)
    of = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in _WIDE]
    return rows.groupBy(*KEYS).agg(F.count_if(is_known(F.col("value"), "site")).alias("known"), F.count(F.lit(1)).alias("total"), *of)


def rows(spark: SparkSession, d: str) -> DataFrame:
    got = c.catalogue(wide(spark, d), metadata(spark, d), unpivoted(homepages(spark, d), [1995, 1996, 1997]), areas(spark, d))
    country = F.concat(F.lit("Country "), (F.col("year") % 4).cast("string"))
    return got.withColumn("country", F.when(F.col("year") % 2 == 0, F.concat(F.lit("Town, "), country)).otherwise(country)).withColumn("last_checked", F.make_date("year", F.lit(6), F.lit(1))).withColumn("conf_date", (F.col("year") % 12 + 1).cast("int"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select(*KEYS, "name", "area_title", "ccf", "domain", "known", "total", "completeness")


def catalogue_visible(spark: SparkSession, d: str) -> DataFrame:
    return c.visible(rows(spark, d)).select(*KEYS, "domain")


def cat_search(spark: SparkSession, d: str) -> DataFrame:
    return c.search(rows(spark, d), "conf1").select(*KEYS, "name")


def cat_multi_filter(spark: SparkSession, d: str) -> DataFrame:
    return c.chosen(rows(spark, d), areas=["1", "Other"], ranks=["A", "-"], years=[1995, 1996]).select(*KEYS, "area", "ccf")


def cat_country(spark: SparkSession, d: str) -> DataFrame:
    return c.in_country(rows(spark, d), "Country 2").select(*KEYS, "country")


def cat_flags(spark: SparkSession, d: str) -> DataFrame:
    return c.flagged(rows(spark, d), "double_blind", "rebuttal_allowed").select(*KEYS)


def cat_sort(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    # a place for each row of a year: the order itself, as a column
    own = rows(spark, d)
    return own.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(*c.sort_keys("rank")))).select(*KEYS, "place")


def cat_page(spark: SparkSession, d: str) -> DataFrame:
    return c.page(rows(spark, d), "completeness", 3).select(*KEYS, "completeness")


def cat_countries(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where(is_known(F.col("country"))).select("country").distinct()


def rule_order(spark: SparkSession, d: str) -> DataFrame:
    return c.rule_order(rules(spark, d), KEYS).select(*KEYS, "field", "place")


def display_status(spark: SparkSession, d: str) -> DataFrame:
    got = rules(spark, d).select("field", c.display_status(F.col("value"), F.col("type")).alias("s")).select("field", "s.*")
    return got.where("field <> 'conference_location' and field <> 'submission_deadline'").groupBy("field", "status", "css").agg(F.count(F.lit(1)).alias("n"))


def date_strip(spark: SparkSession, d: str) -> DataFrame:
    strip = c.date_strip([("Submission", F.col("submission_deadline")), ("Notification", F.lit("unknown"))], F.lit("2025-06-15").cast("date"))
    return wide(spark, d).select(*KEYS, strip.alias("strip"))


def src_conferences(spark: SparkSession, d: str) -> DataFrame:
    last = metadata(spark, d).groupBy(F.upper("short").alias("short")).agg(F.max_by("name", "n").alias("name"), F.count(F.lit(1)).alias("entries"))
    return last


def filter_rank(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).where(F.coalesce("ccf", F.lit("")) == "B").select("n", "short", "name")


def homepage_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return unpivoted(homepages(spark, d), [1995, 1996, 1997])


def homepage_backfill(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "nation").select(F.concat(F.lit("Conf"), F.col("n_nationkey").cast("string")).alias("short"), F.lit(1995).alias("year"), F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".org/")).alias("link"))
    return feeds.backfilled(homepage_unpivot(spark, d), links)


def domain_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    domain = F.when(k == 0, "https://a.org").when(k == 1, "a b.org").when(k == 2, "localhost").when(k == 3, "").otherwise(F.concat(F.lit("conf.org/"), k.cast("string")))
    issue = feeds.domain_issue(domain)
    return table(spark, d, "part").select(issue.alias("issue")).where("issue is not null").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def discover_keys(spark: SparkSession, d: str) -> DataFrame:
    return policy_text(spark, d).select(*KEYS).distinct()


def discover_years(spark: SparkSession, d: str) -> DataFrame:
    years = policy_text(spark, d).select("year").distinct()
    latest = policy_text(spark, d).agg(F.max("year").alias("latest"))
    return years.crossJoin(F.broadcast(latest)).select("year", (F.col("year") == F.col("latest")).alias("is_latest"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Feeds with nested years and timelines, made of orders: conf, confs array of (year, place, timeline)."""
    o = table(spark, d, "orders")
    entry = F.struct(F.year("o_orderdate").alias("year"), F.concat(F.lit("Town"), (F.col("o_orderkey") % 9).cast("string")).alias("place"), F.array(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("deadline"), F.when(F.col("o_orderkey") % 40 == 0, "submit on EasyChair").otherwise("").alias("comment"))).alias("timeline"), F.col("o_orderkey").alias("k"))
    lists = o.groupBy(F.concat(F.lit("CONF"), F.col("o_custkey").cast("string")).alias("conf")).agg(F.collect_list(entry).alias("confs"))
    return lists.withColumn("confs", F.array_sort("confs", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))


def _feed_documents(spark: SparkSession, d: str) -> DataFrame:
    """(k, document): a document of the first feed for each order, some of them broken."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit('{"conference": "Conf'), (F.col("o_custkey") % 500).cast("string"), F.lit('"'))
    rounds = F.concat(F.lit(', "timeline": [{"deadline": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "comment": "order '), k.cast("string"), F.lit('"}, {"abstract_deadline": "TBD", "pages": 9}]}'))
    document = (
        F.when(k % 11 == 0, "no json").when(k % 11 == 1, F.concat(name, F.lit("}"))).when(k % 11 == 2, F.concat(name, F.lit(', "year": "soon"}'))).when(k % 11 == 3, F.concat(F.lit("["), name, F.lit("}]")))
        .otherwise(F.concat(name, F.lit(', "year": '), F.year("o_orderdate").cast("string"), rounds))
    )
    return table(spark, d, "orders").select(k.alias("k"), document.alias("document"))


def feed_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The rounds of each conference's newest document of a year."""
    return feeds_of.rounds(feeds_of.newest(feeds_of.accepted(_feed_documents(spark, d), feeds_of.FIRST), "k"))


def feed_rejects(spark: SparkSession, d: str) -> DataFrame:
    return feeds_of.rejected(_feed_documents(spark, d), feeds_of.FIRST).select("k", "document", "reason")


def explode_year_entry(spark: SparkSession, d: str) -> DataFrame:
    return feeds.year_entry(_nested(spark, d), F.lit(1996)).select("conf", "year", "place")


def feed_values(spark: SparkSession, d: str) -> DataFrame:
    got = feeds.year_entry(_nested(spark, d), F.lit(1996))
    from folioforge.functions.dates import format_deadline

    return got.select("conf", format_deadline(feeds.timeline_value(F.col("timeline"), "deadline")).alias("deadline"), feeds.system_of(F.col("timeline")).alias("system"))


_META = "meta AS (SELECT n_nationkey + 100 * t AS n, 'Conf' || n_nationkey AS short, n_name || CASE WHEN t = 1 THEN ' II' ELSE '' END AS name, n_regionkey::VARCHAR AS area, ['A', 'B', 'C', NULL][n_nationkey % 4 + 1] AS ccf FROM nation, (VALUES (0), (1)) AS v(t) WHERE t = 0 OR n_nationkey % 10 = 0)"
_HOME = "home AS (SELECT 'Conf' || n_nationkey AS short, y AS year, CASE WHEN (n_nationkey + y) % 5 = 0 THEN NULL ELSE 'conf' || n_nationkey || '.org/' || y END AS domain FROM nation, (VALUES (1995), (1996), (1997)) AS v(y))"
_ROWS = (
    RULES
    + f", {_META}, {_HOME}, lastmeta AS (SELECT upper(short) AS u, arg_max(name, n) AS name, arg_max(area, n) AS area, max_by(coalesce(ccf, '~'), n) AS c FROM meta GROUP BY 1), "
    + "wide AS (SELECT entity, year, count(*) FILTER (WHERE value NOT IN ('unknown', '', 'not_mentioned')) AS known, count(*) AS total, "
    + ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in _WIDE)
    + " FROM merged GROUP BY 1, 2), rws AS (SELECT w.*, m.name, m.area, nullif(m.c, '~') AS ccf, r_name AS area_title, h.domain, (100 * known // total)::BIGINT AS completeness, CASE WHEN w.year % 2 = 0 THEN 'Town, ' ELSE '' END || 'Country ' || (w.year % 4) AS country "
    "FROM wide w LEFT JOIN lastmeta m ON upper(w.entity) = m.u LEFT JOIN region ON r_regionkey::VARCHAR = m.area LEFT JOIN home h ON upper(h.short) = upper(w.entity) AND h.year = w.year)"
)
_RANK = "CASE ccf WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 999 END"
_AVAIL = "CASE WHEN value IN ('unknown', '', 'not_mentioned') THEN 0 WHEN type = 'boolean' AND value = 'false' THEN 1 WHEN type = 'enum' AND value IN ('none', 'forbidden') THEN 1 WHEN type = 'enum' AND value IN ('optional', 'required_disclosure') THEN 2 ELSE 3 END"
_NEST = "nested AS (SELECT 'CONF' || o_custkey AS conf, o_orderkey AS k, year(o_orderdate)::INT AS year, 'Town' || (o_orderkey % 9) AS place, o_orderdate, o_orderkey % 40 = 0 AS sys, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS r FROM orders)"


def _importance() -> str:
    from folioforge.functions.fixed import IMPORTANCE

    return "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in IMPORTANCE.items()) + " ELSE 0 END"


QUERIES = {
    "catalogue": (catalogue, _ROWS + " SELECT entity, year, name, area_title, ccf, domain, known, total, completeness FROM rws"),
    "catalogue_visible": (catalogue_visible, _ROWS + " SELECT entity, year, domain FROM rws WHERE domain IS NOT NULL AND conference_location <> 'unknown' AND submission_deadline <> 'unknown'"),
    "cat_search": (cat_search, _ROWS + " SELECT entity, year, name FROM rws WHERE contains(lower(entity), 'conf1') OR contains(lower(coalesce(name, '')), 'conf1')"),
    "cat_multi_filter": (cat_multi_filter, _ROWS + " SELECT entity, year, area, ccf FROM rws WHERE coalesce(area, 'Other') IN ('1', 'Other') AND coalesce(ccf, '-') IN ('A', '-') AND year IN (1995, 1996)"),
    "cat_country": (cat_country, _ROWS + " SELECT entity, year, country FROM rws WHERE country = 'Country 2' OR ends_with(country, ', Country 2')"),
    "cat_flags": (cat_flags, _ROWS + " SELECT entity, year FROM rws WHERE double_blind = 'true' AND rebuttal_allowed = 'true'"),
    "cat_sort": (cat_sort, _ROWS + f" SELECT entity, year, row_number() OVER (PARTITION BY year ORDER BY {_RANK}, entity, year)::INT AS place FROM rws"),
    "cat_page": (cat_page, _ROWS + " SELECT entity, year, completeness FROM rws ORDER BY completeness DESC, entity, year LIMIT 20 OFFSET 40"),
    "cat_countries": (cat_countries, _ROWS + " SELECT DISTINCT country FROM rws"),
    "rule_order": (rule_order, RULES + f" SELECT entity, year, field, row_number() OVER (PARTITION BY entity, year ORDER BY {_AVAIL} DESC, {_importance()} DESC, category, field)::INT AS place FROM rules"),
    "display_status": (
        display_status,
        RULES + ", s AS (SELECT field, CASE WHEN value IN ('unknown', '', 'not_mentioned') THEN 'Unknown' WHEN type = 'boolean' AND value = 'true' THEN 'Yes' WHEN type = 'boolean' THEN 'No' WHEN value IN ('mandatory', 'required') THEN 'Required' WHEN value = 'not_allowed' THEN 'Not Allowed' WHEN value = 'allowed' THEN 'Allowed' ELSE value END AS status, "
        "CASE WHEN value IN ('unknown', '', 'not_mentioned') THEN 'unknown' WHEN type = 'boolean' THEN CASE WHEN value = 'true' THEN 'confirmed' ELSE 'denied' END WHEN value IN ('not_allowed', 'forbidden', 'none') THEN 'denied' WHEN type = 'enum' THEN 'confirmed' ELSE 'value' END AS css FROM rules WHERE field NOT IN ('conference_location', 'submission_deadline')) SELECT field, status, css, count(*) AS n FROM s GROUP BY 1, 2, 3",
    ),
    "date_strip": (
        date_strip,
        _ROWS + r" SELECT entity, year, CASE WHEN submission_deadline = 'unknown' THEN '' ELSE 'Submission: ' || left(submission_deadline, 3) || ' ' || regexp_extract(submission_deadline, ' (\d+),', 1) || ', ' || right(submission_deadline, 4) END AS strip FROM wide",
    ),
    "src_conferences": (src_conferences, f"WITH {_META} SELECT upper(short) AS short, arg_max(name, n) AS name, count(*) AS entries FROM meta GROUP BY 1"),
    "filter_rank": (filter_rank, f"WITH {_META} SELECT n, short, name FROM meta WHERE ccf = 'B'"),
    "homepage_unpivot": (homepage_unpivot, f"WITH {_HOME} SELECT short, year, domain FROM home"),
    "homepage_backfill": (
        homepage_backfill,
        f"WITH {_HOME}, l AS (SELECT 'Conf' || n_nationkey AS short, 1995 AS year, lower(replace(n_name, ' ', '-')) || '.org' AS bare FROM nation) SELECT short, year, coalesce(domain, bare) AS domain, domain IS NULL AND bare IS NOT NULL AS filled FROM home LEFT JOIN l USING (short, year)",
    ),
    "domain_issues": (domain_issues, "SELECT issue, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'SCHEME' WHEN 1 THEN 'CHARACTERS' WHEN 2 THEN 'FORMAT' END AS issue FROM part) WHERE issue IS NOT NULL GROUP BY 1"),
    "discover_keys": (discover_keys, POLICY + " SELECT DISTINCT entity, year FROM policy"),
    "discover_years": (discover_years, POLICY + " SELECT DISTINCT year, year = (SELECT max(year) FROM policy) AS is_latest FROM policy"),
    "feed_rounds": (
        feed_rounds,
        "WITH good AS (SELECT 'Conf' || (o_custkey % 500) AS conference, year(o_orderdate)::INT AS year, max(o_orderkey) AS k, arg_max(o_orderdate::DATE::VARCHAR, o_orderkey) AS deadline FROM orders WHERE o_orderkey % 11 > 3 GROUP BY 1, 2) "
        "SELECT conference, year, 1::INT AS round, NULL::VARCHAR AS abstract_deadline, deadline, 'order ' || k AS comment FROM good UNION ALL SELECT conference, year, 2::INT, 'TBD', NULL, NULL FROM good",
    ),
    "feed_rejects": (
        feed_rejects,
        "WITH o AS (SELECT o_orderkey AS k, '{\"conference\": \"Conf' || (o_custkey % 500) || '\"' AS name FROM orders) SELECT k, CASE k % 11 WHEN 0 THEN 'no json' WHEN 1 THEN name || '}' WHEN 2 THEN name || ', \"year\": \"soon\"}' ELSE '[' || name || '}]' END AS document, "
        "['no JSON', 'no year', 'wrong type', 'no object'][k % 11 + 1] AS reason FROM o WHERE k % 11 <= 3",
    ),
    "explode_year_entry": (explode_year_entry, f"WITH {_NEST} SELECT conf, year, place FROM nested WHERE year = 1996 AND r = 1"),
    "feed_values": (
        feed_values,
        f"WITH {_NEST} SELECT conf, ['January','February','March','April','May','June','July','August','September','October','November','December'][month(o_orderdate)] || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) AS deadline, CASE WHEN sys THEN 'EasyChair' END AS system FROM nested WHERE year = 1996 AND r = 1",
    ),
}
