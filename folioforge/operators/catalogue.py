"""The catalogue: results with metadata and home pages, filters, sorts, pages, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.dates import short_date
from folioforge.functions.fixed import IMPORTANCE
from folioforge.functions.rules import is_known

#: Ranks for sorting.
RANKS = {"A": 1, "B": 2, "C": 3}
NO_RANK = 999
BATCH = 20


def catalogue(wide: DataFrame, metadata: DataFrame, homepages: DataFrame, areas: DataFrame, strict_case: bool = False) -> DataFrame:
    """wide (entity, year, known, total, fields...) with metadata (short, name, area, ccf), area titles and domains by (short, year).

    Names join in any case unless strict_case. Of several metadata rows of a name the last by file order (n) counts.
    """
    last = metadata.groupBy(F.upper("short").alias("u")).agg(F.max(F.struct("n", "short", "name", "area", "ccf")).alias("m")).select("u", "m.*").drop("n")
    pages = homepages.select((F.col("short") if strict_case else F.upper("short")).alias("p"), F.col("year").alias("py"), "domain")
    got = wide.withColumn("u", F.upper("entity")).join(last, "u", "left").join(areas, "area", "left")
    got = got.join(pages, (F.col("u") == F.col("p")) & (F.col("year") == F.col("py")), "left").drop("p", "py", "u")
    return got.withColumn("completeness", F.floor(F.col("known") * 100 / F.col("total")).cast("long"))


def visible(rows: DataFrame) -> DataFrame:
    return rows.where(is_known(F.col("domain"), "site") & is_known(F.col("conference_location"), "site") & is_known(F.col("submission_deadline"), "site"))


def search(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(F.contains(F.lower("entity"), F.lit(text.lower())) | F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(text.lower())))


def chosen(rows: DataFrame, areas: list[str] | None = None, ranks: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    for column, default, values in (("area", "Other", areas), ("ccf", "-", ranks)):
        if values:
            rows = rows.where(F.coalesce(column, F.lit(default)).isin(*values))
    return rows.where(F.col("year").isin(*years)) if years else rows


def in_country(rows: DataFrame, country: str) -> DataFrame:
    return rows.where((F.col("country") == country) | F.endswith("country", F.lit(f", {country}")))


def flagged(rows: DataFrame, *flags: str) -> DataFrame:
    for f in flags:
        rows = rows.where(F.col(f) == "true")
    return rows


def sort_keys(by: str) -> list[Column]:
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))]), F.coalesce("ccf", F.lit("-"))), F.lit(NO_RANK))
    first = {"name": F.col("entity").asc(), "name_desc": F.col("entity").desc(), "rank": rank.asc(), "completeness": F.col("completeness").desc(), "updated": F.col("last_checked").desc(), "month": F.col("conf_date").asc_nulls_last()}
    return [first[by], F.col("entity").asc(), F.col("year").asc()]


def page(rows: DataFrame, by: str, number: int, size: int = BATCH) -> DataFrame:
    """Rows of one page of the sorted list (from 1), by offset and limit, which Spark takes as a top-k."""
    return rows.orderBy(*sort_keys(by)).offset((number - 1) * size).limit(size)


def availability(value: Column, kind: Column) -> Column:
    return (
        F.when(~is_known(value, "site"), 0).when((kind == "boolean") & (value == "false"), 1).when((kind == "enum") & value.isin("none", "forbidden"), 1).when((kind == "enum") & value.isin("optional", "required_disclosure"), 2).otherwise(3)
    )


def rule_order(rules: DataFrame, keys: list[str]) -> DataFrame:
    """rules (keys, field, category, type, value) with place: what is known first, then what matters, then category and name."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in IMPORTANCE.items() for x in (F.lit(k), F.lit(v))]), F.col("field")), F.lit(0))
    order = Window.partitionBy(*keys).orderBy(F.desc(availability(F.col("value"), F.col("type"))), F.desc(weight), "category", "field")
    return rules.withColumn("place", F.row_number().over(order))


def display_status(value: Column, kind: Column) -> Column:
    """struct(status, css) of a rule's value."""
    status = F.when(~is_known(value, "site"), "Unknown").when((kind == "boolean") & (value == "true"), "Yes").when(kind == "boolean", "No").when(value.isin("mandatory", "required"), "Required").when(value == "not_allowed", "Not Allowed").when(value == "allowed", "Allowed").otherwise(value)
    css = F.when(~is_known(value, "site"), "unknown").when(kind == "boolean", F.when(value == "true", "confirmed").otherwise("denied")).when(value.isin("not_allowed", "forbidden", "none"), "denied").when(kind == "enum", "confirmed").otherwise("value")
    return F.struct(status.alias("status"), css.alias("css"))


def date_strip(dates: list[tuple[str, Column]], as_of: Column) -> Column:
    """'label: date' of the known dates in their fixed order."""
    return F.concat_ws(" | ", *[F.when(is_known(v, "site"), F.concat(F.lit(f"{k}: "), short_date(v, as_of))) for k, v in dates])
