"""Typed reading of the two feeds: nested JSON documents against a schema, with what doesn't fit kept aside and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first feed, with a timeline of rounds, and the second, which is flat. A document must name its conference and year.
FIRST = "conference string, year int, title string, dblp string, rank struct<ccf: string, core: string, thcpl: string>, link string, date string, place string, timezone string, timeline array<struct<abstract_deadline: string, deadline: string, comment: string>>"
SECOND = "conference string, year int, source string, event_url string, title string, dates string, location string, submission_deadline string, notification string, abstract_deadline string, camera_ready string"
_BROKEN = "_broken"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(document, file): the documents of a folder of JSON files, one document a file, whatever its lines."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("document"), F.col("_metadata.file_path").alias("file"))


def checked(documents: DataFrame, schema: str) -> DataFrame:
    """documents (document, ...) with d, the document as schema says, and reason: why it is refused, null for a good one.

    A value of another type than the schema's breaks its document, as does text that is no JSON; names that the schema doesn't know are
    left out. The last document of a conference and year isn't chosen here: see newest().
    """
    parsed = F.from_json("document", f"{schema}, {_BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    rows = documents.withColumn("d", parsed)
    named = F.coalesce(F.trim("d.conference"), F.lit("")) != ""
    kind = F.schema_of_variant(F.try_parse_json("document"))
    reason = (
        F.when(F.col("document").isNull() | (F.trim("document") == ""), "empty").when(kind.isNull(), "no JSON").when(~F.startswith(kind, F.lit("OBJECT")), "no object").when(F.col(f"d.{_BROKEN}").isNotNull(), "wrong type")
        .when(~named, "no conference").when(F.col("d.year").isNull(), "no year")
    )
    return rows.withColumn("reason", reason)


def accepted(documents: DataFrame, schema: str) -> DataFrame:
    """The good documents, flattened, beside the other columns."""
    own = [c for c in documents.columns if c != "document"]
    good = checked(documents, schema).where("reason is null").select(*own, F.col("d").dropFields(_BROKEN).alias("d"))
    return good.select(*own, "d.*")


def rejected(documents: DataFrame, schema: str) -> DataFrame:
    """The other documents as they came, with the reason."""
    return checked(documents, schema).where("reason is not null").drop("d")


def newest(rows: DataFrame, order: str) -> DataFrame:
    """One document for each conference (in any case) and year: the last by order."""
    key = F.lower(F.trim("conference"))
    picked = rows.groupBy(key.alias("_key"), "year").agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return picked.select("r.*")


def rounds(rows: DataFrame) -> DataFrame:
    """(conference, year, round, abstract_deadline, deadline, comment): the timeline of the first feed, a row for each round, from 1."""
    return rows.select("conference", "year", F.posexplode("timeline").alias("round", "t")).where("t is not null").select("conference", "year", (F.col("round") + 1).alias("round"), "t.*")
