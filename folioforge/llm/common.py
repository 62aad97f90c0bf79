"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.shared import settle, shared_folder

#: Bits of the filter of ids that is broadcast, 8 MB whatever the input. It keeps rows at home that no later join wants; with many
#: ids it fills up and lets more and more through. The joins behind it decide, so the plan and its rows are the same at every size.
ID_BITS = 1 << 26
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20

__all__ = ["settle", "shared_folder"]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _BASE
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    slim_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of BATCH_BYTES at most, for the rest of the session; a longer row comes alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def chunked(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes together; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def word_hashes(texts: list[bytes], between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (lower-case A-Z, split at the bytes of between), and where each text's words begin."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = between[buf]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE, np.uint64))
    letters = buf[~space].astype(np.uint64) + np.uint64(1)
    opens = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    letters *= powers[np.arange(len(letters)) - np.repeat(opens, lengths)]
    return mix(np.add.reduceat(letters, opens) + lengths.astype(np.uint64)), first


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of sequences given column by column."""
    out = np.zeros(len(parts[0]), np.uint64) + np.uint64(len(parts))
    for p in parts:
        out = mix(out * _BASE + p)
    return out


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: size words each; the whole sequence if it is shorter; none without words."""
    for lo, hi in chunked(texts):
        words, first = word_hashes(texts[lo:hi])
        grams = fold([words[j : len(words) - size + 1 + j] for j in range(size)]) if len(words) >= size else words[:0]
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield fold([words[i : i + 1] for i in range(a, b)])
            else:
                yield words[:0]


def sliced(batches: Iterator[pd.DataFrame], column: str = "text", most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Batches cut to about so many signs of a text column, so that a task holds little at once; a longer text comes alone."""
    for b in batches:
        sizes = b[column].str.len().fillna(0).to_numpy(np.int64)
        lo = size = 0
        for i, n in enumerate(sizes):
            if i > lo and size + n > most:
                yield b.iloc[lo:i].reset_index(drop=True)
                lo, size = i, 0
            size += n
        if lo < len(b):
            yield b.iloc[lo:].reset_index(drop=True)


def encoded(texts: pd.Series) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _word_and_bit(key: F.Column) -> tuple[F.Column, F.Column]:
    slot = F.pmod(key.bitwiseXOR(F.shiftrightunsigned(key, 29)), F.lit(ID_BITS))
    return F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(63).cast("int")


def _words(ids: DataFrame) -> DataFrame:
    """(_word, _bits): the bitmap of the ids of the one long column, ID_BITS / 64 rows at most."""
    key = F.col(ids.columns[0])
    word, bit = _word_and_bit(key)
    return ids.where(key.isNotNull()).select(word.alias("_word"), bit.alias("bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_bits"))


def id_bits(ids: DataFrame) -> np.ndarray:
    """The bitmap that holds every id of the one long column and some others (all, once there are very many)."""
    rows = _words(ids).toArrow().to_pandas()
    words = np.zeros(max(1, ID_BITS // 64), np.int64)
    words[rows["_word"].to_numpy(int)] = rows["_bits"].to_numpy(np.int64)
    return words


def marked(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """docs with _hit: true where id_col is in ids (a column of longs) and for some others; texts stay where they are.

    The bitmap is broadcast as a table of ID_BITS / 64 rows at most.
    """
    word, bit = _word_and_bit(F.col(id_col))
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, _bit)")) != 0, F.lit(False))
    near = docs.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(_words(ids)), F.col("_at") == F.col("_word"), "left")
    return near.withColumn("_hit", hit).drop("_at", "_bit", "_word", "_bits")


def only_maybe(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """docs whose id_col is in ids, and some others that the joins behind drop or bear."""
    return marked(docs, ids, id_col).where("_hit").drop("_hit")


def has_bit(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the bitmap; all that are, are."""
    at = (ids.view(np.int64) ^ (ids.view(np.uint64) >> np.uint64(29)).view(np.int64)) & (64 * len(words) - 1)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def row_key(doc_id: str = "doc_id", text: str = "text") -> F.Column:
    """A hash of id and text, never null: rows without an id have one too, and so does each text of a shared id."""
    own, words = F.col(doc_id), F.col(text).cast("string")
    return F.xxhash64(own.isNull(), F.coalesce(own.cast("long"), F.lit(0)), words.isNull(), F.coalesce(words, F.lit("")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable. Min-label rounds with pointer jumping, each settled; every join is on a key.

    Sort-merge joins throughout, as the tables are large at scale; small ones would only fill the driver with broadcasts.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near.hint("merge"), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = settle(step.join(hop.hint("merge"), "component", "left").select("id", "old", F.least("component", "further").alias("component")))
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels
