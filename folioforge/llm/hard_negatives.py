"""Hard negatives by Kronecker-packed products: one multiplication of wide integers scores a whole block of candidates.

Components become integers (floor of SCALE times). A block's candidates lie side by side in one wide integer for each dimension, each in
a field of its own; a bias makes all fields and the anchor's component non-negative, and fields are so wide that no sum over the
dimensions reaches the next field. So for an anchor the sum over dimensions of (its component times the block's integer), one
multiplication each, holds in its fields all the biased inner products, which are read out at once and freed from the bias:

    sum (a + s)(c + t) = sum a c + s sum c + t sum (a + s)

The integers have as many bits as the values need, so scores are exact for any range of components.

Anchors meet all rows in blocks: at most about ANCHORS of them are broadcast at a time, and each task goes through its blocks of
candidates. In a first pass tasks keep each anchor's best rows of its label, of which a ranked window takes the best; in a second one,
with the positives' scores broadcast beside the anchors, they keep for each positive the best rows of other labels between its bounds.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part, nor do rows without an id;
missing components at the end of a shorter vector count as zero; all rows of an anchor's id are itself, never its positives or
negatives; each distinct (label, vector) of an anchor's id is an anchor of its own, equal ones are asked once; other repeated rows are
candidates each; equal scores go by the smaller id; an anchor with no positive, or a positive with no row between its bounds, gives no
rows; scores beyond the range of long count as its ends; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import settle, slim_batches

#: Candidates in one wide integer; anchors that are broadcast at a time.
BLOCK, ANCHORS = 4096, 4096
#: Rows of a task at least.
LEAST = 1024
SCALE = 256
LONG = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v as doubles) of rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", finite))


def whole_numbers(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(SCALE * x) of all components, rows x dimensions, short rows filled with 0; Python integers where 64 bits may not do."""
    dim = max((len(v) for v in vectors), default=0)
    x = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    large = np.abs(x) > 2.0**44
    if not large.any():
        return np.floor(SCALE * x).astype(np.int64)
    return np.array([[int(c) * SCALE if big else int(np.floor(SCALE * c)) for c, big in zip(row, wide)] for row, wide in zip(x, large)], object)


class Packed:
    """A block of candidates: for each dimension one integer that holds all their biased components, field by field."""

    def __init__(self, c: np.ndarray, top: int):
        """c: candidates x dimensions; top: the largest biased component of any anchor that will be asked."""
        self.n, self.dim = c.shape
        self.bias = -min(0, int(c.min())) if c.size else 0
        most = (int(c.max()) + self.bias) * top * self.dim if c.size else 0
        self.bytes = 4 if most < 1 << 32 else 8 if most < 1 << 61 else -(-(most.bit_length() + 1) // 8)
        self.sums = (c if self.bytes <= 8 else c.astype(object)).sum(axis=1)
        self.wide = [self._joined(c[:, d] + self.bias) for d in range(self.dim)]

    def _joined(self, fields: np.ndarray) -> int:
        if self.bytes <= 8 and fields.dtype != object:
            return int.from_bytes(fields.astype(f"<u{self.bytes}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in fields), "little")

    def scores(self, anchor: list[int], bias: int) -> np.ndarray:
        """The inner products of an anchor (biased components) with all candidates."""
        total = 0
        for a, wide in zip(anchor, self.wide):
            if a:
                total += a * wide
        raw = total.to_bytes(self.n * self.bytes, "little")
        if self.bytes <= 8:
            fields = np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64)
        else:
            fields = np.array([int.from_bytes(raw[k : k + self.bytes], "little") for k in range(0, len(raw), self.bytes)], object)
        return as_long(fields - bias * self.sums - self.bias * sum(anchor))


def as_long(x: np.ndarray) -> np.ndarray:
    return x if x.dtype != object else np.array([max(-LONG - 1, min(LONG, int(i))) for i in x], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores where ok, best first, ties by id."""
    at = np.flatnonzero(ok)
    if len(at) > 8 * k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, whole components) of BLOCK rows each, whatever the batches."""
    ids, labels, rows = [], [], []
    for b in batches:
        for i, label, v in zip(b["vec_id"], b["label"], b["v"]):
            ids.append(i), labels.append(label), rows.append(v)
            if len(ids) == BLOCK:
                yield np.array(ids, np.int64), np.array(labels, np.int64), whole_numbers(rows)
                ids, labels, rows = [], [], []
    if ids:
        yield np.array(ids, np.int64), np.array(labels, np.int64), whole_numbers(rows)


class Anchors:
    """A block of anchors as they are broadcast."""

    def __init__(self, rows: pd.DataFrame, bounds: dict[int, list[int]] | None = None):
        self.key, self.ids, self.labels = (rows[c].to_numpy(np.int64) for c in ("key", "vec_id", "label"))
        x = whole_numbers(rows["v"].tolist())
        self.bias = -min(0, int(x.min())) if x.size else 0
        self.top = int(x.max()) + self.bias if x.size else 0
        self.rows = [[int(c) + self.bias for c in row] for row in x]
        self.bounds = bounds


def _cut(x: np.ndarray, dim: int) -> np.ndarray:
    """Components of dimensions beyond the anchors' add nothing."""
    return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def _scanned(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(key, pair, score, vec_id): each task's k best rows for each anchor (pair 0), or for each of its positives (from 1)."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        dim = len(own.rows[0])
        kept: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def keep(place: tuple[int, int], scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
            if ok.any():
                new = [(-int(scores[i]), int(ids[i])) for i in best(scores, ids, ok, k)]
                kept[place] = sorted(kept.get(place, []) + new)[:k]

        for ids, labels, x in blocks(batches):
            packed = Packed(_cut(x, dim), own.top)
            for q, a in enumerate(own.rows):
                scores, other, same = packed.scores(a, own.bias), ids != own.ids[q], labels == own.labels[q]
                if own.bounds is None:
                    keep((q, 0), scores, ids, same & other)
                    continue
                other &= ~same
                for p, s in enumerate(own.bounds.get(int(own.key[q]), ())):
                    keep((q, p + 1), scores, ids, other & (scores >= -(-30 * s // 100)) & (scores <= 90 * s // 100))
        out = [(int(own.key[q]), p, -s, i) for (q, p), found in kept.items() for s, i in found]
        yield pd.DataFrame(out, columns=["key", "pair", "score", "vec_id"])

    return rows.mapInPandas(scan, "key long, pair int, score long, vec_id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks' rows with their rank."""
    order = Window.partitionBy("key", "pair").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, the rows for which is_anchor holds."""
    spark = vectors.sparkSession
    slim_batches(spark)
    rows = settle(usable(vectors))
    asked = settle(rows.where(is_anchor).withColumn("key", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["key"]))
    passes = max(1, -(-asked.count() // ANCHORS))
    dealt = rows.coalesce(max(1, rows.count() // LEAST))
    out = None
    for g in range(passes):
        block = asked.where(F.pmod("key", F.lit(passes)) == g).toArrow().to_pandas()
        if not len(block):
            continue
        near = settle(_ranked(_scanned(dealt, Anchors(block), positives), positives).select("key", F.col("rank").alias("pair"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")))
        bounds: dict[int, list[int]] = {}  # a few scores for each anchor of the block
        known = near.select("key", "pair", "positive_score").toArrow().to_pandas().sort_values(["key", "pair"])
        for key, s in zip(known["key"].tolist(), known["positive_score"].tolist()):
            bounds.setdefault(key, []).append(s)
        far = _ranked(_scanned(dealt, Anchors(block, bounds), negatives), negatives)
        far = far.select("key", "pair", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = far.join(near, ["key", "pair"]).join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
        pairs = settle(pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        out = pairs if out is None else out.union(pairs)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def mined(vectors: DataFrame) -> DataFrame:
    """hard_negatives for each hundredth id, after every seventh id has taken on the next of ten labels."""
    label = F.col("label").cast("long")
    moved = vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


def oracle_sql() -> str:
    """The rows of mined over embeddings in DuckDB SQL; sums of products of such whole numbers are exact as doubles."""
    return """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
            from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.q, c.q)::bigint as score
            from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id
        ),
        positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank,
               vec_id as negative_id, positive_score, score as negative_score
        from positives join scored using (anchor_id)
        where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
        qualify rank <= 10
    """
