"""Streams of snapshots, on small folders."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioforge.operators.pages import fresh_snapshots
from folioforge.streaming.snapshots import answered

SCHEMA = "url string, at timestamp, text string"


@pytest.fixture(autouse=True)
def settings(spark):
    names = ["spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"]
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


class Cache:
    """A stream over a folder that runs until it has read all."""

    def __init__(self, spark, folder, ttl):
        self.spark, self.folder, self.ttl, self.batches = spark, str(folder), ttl, 0

    def send(self, *rows):
        self.batches += 1
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{self.folder}/in/b={self.batches}")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in/*")
        out = answered(stream, "url", "at", "text", self.ttl).writeStream.option("checkpointLocation", f"{self.folder}/state").outputMode("update")
        got = []
        out.foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
        return {(r["key"], r["hit"], r["value"]) for r in got}


def test_snapshots_answer_until_they_are_old(spark, tmp_path):
    t = datetime(2025, 1, 1)
    cache = Cache(spark, tmp_path, 3600)
    assert cache.send(("a", t, "one"), ("a", t, None), ("b", t, None), (None, t, "x"), ("c", None, "y")) == {("a", True, "one"), ("b", False, None)}
    later = lambda s: t + timedelta(seconds=s)
    assert cache.send(("a", later(3599), None), ("b", later(5), "two"), ("b", later(1), "older")) == {("a", True, "one")}
    assert cache.send(("a", later(3600), None), ("b", later(6), None)) == {("a", False, None), ("b", True, "two")}


def test_state_is_dropped_after_its_ttl(spark, tmp_path):
    """The lookup's own instant is fresh, but the state has gone by the cluster's clock."""
    t = datetime(2025, 1, 1)
    cache = Cache(spark, tmp_path, 4)
    assert cache.send(("a", t, "one"), ("a", t, None)) == {("a", True, "one")}
    time.sleep(5)
    assert cache.send(("a", t, None)) == {("a", False, None)}
    assert cache.send(("a", t, "again"), ("a", t, None)) == {("a", True, "again")}


def test_stream_agrees_with_the_batch_form(spark, tmp_path):
    t = datetime(2025, 1, 1)
    stored = [(f"u{k % 7}", t + timedelta(minutes=37 * k % 1000), f"text {k}") for k in range(40)]
    as_of, cache = t + timedelta(minutes=1020), Cache(spark, tmp_path, 7200)
    cache.send(*stored[:25])
    cache.send(*stored[25:])
    got = {(k, v) for k, hit, v in cache.send(*[(f"u{k}", as_of, None) for k in range(9)]) if hit}
    batch = fresh_snapshots(spark.createDataFrame(stored, SCHEMA), "url", "at", "text", F.lit(as_of), 7200)
    assert got == {(r["url"], r["text"]) for r in batch.collect()} and 0 < len(got) < 7
