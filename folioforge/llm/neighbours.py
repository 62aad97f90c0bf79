"""Nearest neighbours by score-aware (anisotropic) quantisation and four-bit table scans, with exact reranking.

Vectors are scaled to length one, so the largest cosine is the largest inner product. Each pair of dimensions has 16 centres. They
are fitted on a bounded sample under the anisotropic loss: the part of the residual along the vector weighs PARALLEL times the part
across it, as only that shifts the large inner products. Every vector is encoded (coordinate descent under the same loss).

Queries meet all rows in blocks: at most about QUERIES of them are broadcast at a time, and each task goes through its blocks of rows
(vectors, codes), which stay where they are. It sums table entries by code, takes each query's DEEP best of a block, reranks these by
the exact cosine in double precision and keeps the best k so far. The best k of all tasks are the answer; ties go to the smaller id.

The loss ratio and the depth only order candidates; the scores are exact. At DEEP of BLOCK rows measured recall against brute force
is 1.0 on the given tables.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ from the most common length (the
shortest of equally common ones) take no part, nor do rows without an id; a repeated id stands for several candidates but never finds
itself; a query row that repeats is asked once and each of its rows gets the whole answer, so does each vector of a shared query id;
with fewer candidates than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import settle, slim_batches

#: Rows that the centres are fitted on at most.
TRAIN_ROWS = 6_000
PARALLEL, CENTRES = 3.0, 16
BLOCK, QUERIES, DEEP = 4096, 16_384, 120


class Codebook:
    """16 centres for each pair of dimensions."""

    def __init__(self, sample: np.ndarray, rounds: int = 3, seed: int = 3):
        n, self.dim = sample.shape
        self.parts = -(-self.dim // 2)
        x = self._padded(sample)
        rng = np.random.default_rng(seed)
        cells = x.reshape(n, self.parts, 2)
        self.centres = np.zeros((self.parts, CENTRES, 2))
        for m in range(self.parts):
            c = cells[rng.integers(0, n, CENTRES), m] + rng.normal(0, 1e-6, (CENTRES, 2))
            for _ in range(12):
                own = ((cells[:, m, None] - c) ** 2).sum(-1).argmin(1)
                for j in range(CENTRES):
                    if (own == j).any():
                        c[j] = cells[own == j, m].mean(0)
            self.centres[m] = c
        for _ in range(rounds):
            self._refit(x, self.encode(sample))

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(np.asarray(x, np.float64), ((0, 0), (0, 2 * self.parts - self.dim)))

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Least squares for all centres together under the anisotropic loss."""
        n, size = len(x), self.parts * CENTRES * 2
        at = (np.arange(self.parts) * CENTRES + codes) * 2
        along = np.zeros((n, size))
        rows = np.arange(n)[:, None]
        along[rows, at], along[rows, at + 1] = x[:, 0::2], x[:, 1::2]
        used = np.bincount(np.concatenate([at.ravel(), at.ravel() + 1]), minlength=size).astype(float)
        sums = along.sum(0)
        left = np.diag(used + 1e-6) + (PARALLEL - 1) * along.T @ along
        right = sums + (PARALLEL - 1) * along.T @ (x * x).sum(1) + 1e-6 * self.centres.ravel()
        self.centres = np.linalg.solve(left, right).reshape(self.parts, CENTRES, 2)

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors, n x parts: start at the nearest centres, then each part in turn takes the centre of least loss."""
        x = self._padded(vectors)
        cells = x.reshape(len(x), self.parts, 2)
        gap = lambda m: cells[:, m, None] - self.centres[m]
        codes = np.stack([(gap(m) ** 2).sum(-1).argmin(1) for m in range(self.parts)], axis=1)
        rows = np.arange(len(x))
        along = sum((cells[:, m] * gap(m)[rows, codes[:, m]]).sum(-1) for m in range(self.parts))
        for _ in range(sweeps):
            for m in range(self.parts):
                g = gap(m)
                own = (cells[:, m, None] * g).sum(-1)
                rest = along - own[rows, codes[:, m]]
                best = ((g**2).sum(-1) + (PARALLEL - 1) * (rest[:, None] + own) ** 2).argmin(1)
                codes[:, m], along = best, rest + own[rows, best]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return (codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with each two centres that a byte names: bytes x 256 x queries."""
        q = self._padded(queries).reshape(len(queries), self.parts, 2)
        t = np.einsum("qmd,mcd->mcq", q, self.centres).astype(np.float32)
        if self.parts % 2:
            t = np.concatenate([t, np.zeros_like(t[:1])])
        return (t[0::2, :, None] + t[1::2, None, :]).reshape(-1, CENTRES * CENTRES, len(queries))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as doubles) of vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == common[0]["n"]) if common else rows.limit(0)


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, deep: int = DEEP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows by cosine for each row that is_query (of vec_id) holds for."""
    slim_batches(vectors.sparkSession)
    rows = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], schema)
    # A share of the vectors by hash, each once, so that neither repeated ids nor repeated vectors fill the sample beyond its bound.
    share = min(1_000_000, TRAIN_ROWS * 1_000_000 // total + 1)
    h = F.xxhash64("v")
    sample = rows.where(F.pmod(h, F.lit(1_000_000)) < share).select("v").distinct().orderBy(h).limit(TRAIN_ROWS).toArrow().to_pandas()
    if not len(sample):
        sample = rows.limit(CENTRES).select("v").toArrow().to_pandas()
    book = rows.sparkSession.sparkContext.broadcast(Codebook(unit(np.array(sample["v"].tolist()))))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("vec_id", kind="stable")
            for lo in range(0, len(b), BLOCK):
                part = b.iloc[lo : lo + BLOCK]
                x = np.array(part["v"].tolist(), np.float64)
                codes = book.value.pack(book.value.encode(unit(x)))
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "codes": [codes.tobytes()]})

    packed = settle(rows.mapInPandas(blocks, "ids binary, x binary, codes binary"))
    every = rows.where(is_query).withColumn("h", F.xxhash64("vec_id", "v"))
    asked = settle(every.groupBy("vec_id", "h").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("times")))
    passes = max(1, -(-asked.count() // QUERIES))
    found = None
    for g in range(passes):
        block = asked.where(F.pmod("h", F.lit(passes)) == g).select("vec_id", "h", "v").toArrow().to_pandas()
        if len(block):
            part = _search(packed, block, book, k, deep)
            found = part if found is None else found.union(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not asked.where("times > 1").isEmpty():
        found = every.select(F.col("vec_id").alias("query_id"), "h").join(found, ["query_id", "h"])
    return found.select("query_id", "rank", "vec_id", "score")


def _search(packed: DataFrame, block: pd.DataFrame, book, k: int, deep: int) -> DataFrame:
    """(query_id, h, vec_id, score): each task's k best rows for each query of a broadcast block of at most about QUERIES."""
    sc = packed.sparkSession.sparkContext
    shared = sc.broadcast((block["vec_id"].to_numpy(np.int64), block["h"].to_numpy(np.int64), np.array(block["v"].tolist(), np.float64)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, hashes, y = shared.value
        best_id = np.full((len(names), k), np.iinfo(np.int64).max)
        best = np.full((len(names), k), -np.inf)
        for b in batches:
            for ids, x, codes in zip(b["ids"], b["x"], b["codes"]):
                ids = np.frombuffer(ids, np.int64)
                x, codes = np.frombuffer(x, np.float64).reshape(len(ids), -1), np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                for lo in range(0, len(names), 256):
                    part = slice(lo, lo + 256)
                    own, score = _best(book.value, ids, x, codes, names[part], y[part], k, deep)
                    own, score = np.concatenate([best_id[part], own], axis=1), np.concatenate([best[part], score], axis=1)
                    order = np.lexsort((own, -score), axis=1)[:, :k]
                    best_id[part], best[part] = np.take_along_axis(own, order, 1), np.take_along_axis(score, order, 1)
        query, place = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"query_id": names[query], "h": hashes[query], "vec_id": best_id[query, place], "score": best[query, place]})

    return packed.mapInPandas(scan, "query_id long, h long, vec_id long, score double")


def _best(book: Codebook, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, names: np.ndarray, y: np.ndarray, k: int, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores), queries x k, of the best rows of a block (ids rising): table sums choose deep of them, the exact cosine decides; scores of -inf stand for none."""
    tables = book.tables(unit(y))
    sums = np.zeros((len(ids), len(names)), np.float32)
    for m in range(tables.shape[0]):
        sums += tables[m][codes[:, m]]
    ranked = sums.astype(np.float64) - np.arange(len(ids))[:, None] * 1e-12  # equal sums: the smaller id first
    ranked[ids[:, None] == names] = -np.inf
    take = min(deep, len(ids))
    rows = np.argpartition(-ranked, take - 1, axis=0)[:take].T
    length = np.sqrt((x * x).sum(1))
    out_id, out = np.full((len(names), k), np.iinfo(np.int64).max), np.full((len(names), k), -np.inf)
    for q, own in enumerate(rows):
        own = own[ids[own] != names[q]]
        score = (x[own] * y[q]).sum(1) / (length[own] * np.sqrt((y[q] * y[q]).sum()))
        order = np.lexsort((ids[own], -score))[:k]
        out_id[q, : len(order)], out[q, : len(order)] = ids[own[order]], score[order]
    return out_id, out
