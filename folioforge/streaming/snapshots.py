"""A cache of page snapshots as a stream: what was stored answers lookups for so long, then its state is dropped."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEWEST = "at long, value string"
_ANSWER = "key string, asked long, hit boolean, at long, value string"


class Snapshots(StatefulProcessor):
    """The newest snapshot of each key. Rows (key, at in microseconds, value) with a value are stored; those without one ask at that instant.

    A snapshot answers while it is younger than ttl by the rows' own instants. Beside that its state lives for ttl of the cluster's
    clock after it was stored, so that keys that nobody stores again cost no memory; a snapshot can't be stored before it was taken,
    so none goes that could still answer a lookup of now. Rows of one batch count by their instants, stores before lookups of equal
    ones; a snapshot that is older than the held one is left.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", _NEWEST, self.ttl * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.newest.get() if self.newest.exists() else None
        before = held
        for row in sorted((r for r in rows if r["at"] is not None), key=lambda r: (r["at"], r["value"] is None)):
            if row["value"] is not None:
                if held is None or row["at"] >= held[0]:
                    held = (row["at"], row["value"])
                continue
            hit = held is not None and row["at"] - held[0] < self.ttl * 1_000_000
            yield Row(key=key[0], asked=row["at"], hit=hit, at=held[0] if hit else None, value=held[1] if hit else None)
        if held is not before:
            self.newest.update(held)  # writing it anew begins a new ttl

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """State with a ttl needs the RocksDB store, whose size is that of the disk.

    Streams by the cluster's clock go on with batches without data; they are put off, so that a stream ends once it has read all
    (availableNow). Dropped state goes with the next batch of data.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def answered(events: DataFrame, key: str, at: str, value: str, ttl: int = 86_400) -> DataFrame:
    """A row for each lookup of a stream of stores and lookups (rows with and without a value): its key and instant, whether a fresh snapshot answers it, and that."""
    with_state_store(events.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker knows no path of this library
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(value).cast("string").alias("value"))
    out = rows.groupBy("key").transformWithState(statefulProcessor=Snapshots(ttl), outputStructType=_ANSWER, outputMode="Update", timeMode="ProcessingTime")
    return out.select("key", F.timestamp_micros("asked").alias("asked"), "hit", F.timestamp_micros("at").alias("at"), "value")
