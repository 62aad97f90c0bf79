"""Readers and writers of an archive of files: raw page texts, result tables, reports, configuration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFERENCES = "short string, name string, area string, dblp string, conf_date int, rank struct<ccf: string, core: string, thcpl: string>"


def read_texts(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    """(conf, year, source_key, text) of folder/conf/year/*.txt; blank files are left out."""
    got = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    part = lambda k: F.regexp_extract(path, r"([^/]+)/(\d{4})/([^/]+)\.txt$", k)
    rows = got.select(part(1).alias("conf"), part(2).cast("int").alias("year"), part(3).alias("source_key"), F.col("value").alias("text"))
    rows = rows.where((F.col("conf") != "") & F.col("text").rlike(r"\S"))
    return rows if year is None else rows.where(F.col("year") == year)


def discover_keys(texts: DataFrame, year: int = 0) -> DataFrame:
    """Distinct (conf, year); 0 is all years."""
    rows = texts.select("conf", "year").distinct()
    return rows if not year else rows.where(F.col("year") == year)


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType, parse=None) -> DataFrame:
    """Rows of one structured file of lists of mappings: JSON by Spark, YAML by the caller's parser (or PyYAML where it is installed)."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(schema).json(path, multiLine=path.endswith(".json"))
    if parse is None:
        import yaml

        parse = yaml.safe_load
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(parse(bytes(content)) or [], columns=fields.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, fields)


def read_conferences(spark: SparkSession, path: str, short: str | None = None, ccf: str | None = None, parse=None) -> DataFrame:
    rows = read_documents(spark, path, CONFERENCES, parse)
    if short is not None:
        rows = rows.where(F.upper("short") == short.upper())
    return rows if ccf is None else rows.where(F.coalesce("rank.ccf", F.lit("")) == ccf)


def read_patterns(spark: SparkSession, path: str, parse=None) -> DataFrame:
    """(field, pattern_idx, name, regex) of a pattern file of any size; the order is part of the meaning."""
    rows = read_documents(spark, path, "field string, patterns array<struct<name: string, regex: string>>", parse)
    return rows.select("field", F.posexplode("patterns").alias("pattern_idx", "p")).select("field", "pattern_idx", "p.name", "p.regex")


def homepages(rows: DataFrame, years: list[int]) -> DataFrame:
    """Columns domain<year> to (short, year, domain); blank is unknown."""
    long = rows.select("short", *[F.col(f"domain{y}") for y in years]).unpivot("short", [f"domain{y}" for y in years], "name", "domain")
    return long.select("short", F.substring("name", 7, 4).cast("int").alias("year"), F.nullif(F.trim("domain"), F.lit("")).alias("domain"))


def write_results(rules: DataFrame, folder: str) -> None:
    """One partition for each year; a rerun overwrites the years that it holds."""
    rules.write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read_results(spark: SparkSession, folder: str, year: int | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows if year is None else rows.where(F.col("year") == year)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def write_json_array(rows: DataFrame, order: list[str], folder: str) -> None:
    """Rows as one JSON array, by order (whose values are unique), in text files that make it up one behind the other.

    Each task writes its own stretch; a comma stands before every row but the first, which a minimum finds, so nothing is gathered.
    """
    key = F.struct(*[F.col(c) for c in order])
    first = rows.agg(F.min(key).alias("_first"))
    body = rows.select(F.lit(1).alias("_part"), key.alias("_key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("_json")).crossJoin(F.broadcast(first))
    lines = body.select("_part", "_key", F.concat(F.when(F.col("_key") == F.col("_first"), "").otherwise(","), "_json").alias("_line"))
    none = F.lit(None).cast(rows.select(key.alias("k")).schema["k"].dataType)
    ends = rows.sparkSession.createDataFrame([(0, "["), (2, "]")], "_part int, _line string").select("_part", none.alias("_key"), "_line")
    lines.union(ends).orderBy("_part", "_key").select(F.col("_line").alias("value")).write.mode("overwrite").text(folder)


def append_snapshots(pages: DataFrame, folder: str) -> None:
    """Fetched pages are appended with their time; fresh_snapshots() gives the newest."""
    pages.write.mode("append").parquet(folder)
