"""Arrivals as streams: duplicates remembered, snapshots that age, upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.functions.text import hash_norm
from folioforge.operators.pages import upsert


def read_arrivals(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_contents(pages: DataFrame, text: str = "text", at: str | None = None, late: str = "1 day") -> DataFrame:
    """Pages whose content hasn't been seen. With an event time the memory is bounded by a watermark, else it grows with distinct contents."""
    hashed = pages.withColumn("hash", hash_norm(F.col(text)))
    return hashed.withWatermark(at, late).dropDuplicatesWithinWatermark(["hash"]) if at else hashed.dropDuplicates(["hash"])


def latest(events: DataFrame, key: str, at: str, value: str, late: str = "1 day") -> DataFrame:
    """The newest value of each key so far (update mode)."""
    return events.withWatermark(at, late).groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def fresh_within(events: DataFrame, key: str, at: str, ttl: str, late: str = "1 hour") -> DataFrame:
    """Keys with a snapshot in each window of ttl; state ends with the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, ttl), key).agg(F.max(at).alias("newest"))


def write_upserts(pages: DataFrame, archive: str, checkpoint: str, on_batch: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Each micro-batch against the archive's newest hashes: unchanged files are skipped, others appended with their batch number.

    Batches are idempotent: a rerun batch writes its own partition again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("hash", hash_norm(F.col("text"))).groupBy("filename").agg(F.max_by("hash", "arrived").alias("hash"), F.max_by("text", "arrived").alias("text"))
        try:
            old = spark.read.parquet(archive).where(F.col("batch") < number).groupBy("filename").agg(F.max_by("hash", "batch").alias("hash"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = new.select("filename", "hash").limit(0)
        changed = upsert(old, new.select("filename", "hash")).where(F.col("status").isin("new", "changed"))
        out = changed.join(new.drop("hash"), "filename")
        if on_batch:
            on_batch(out)
        out.withColumn("batch", F.lit(number)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(archive)

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
