"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

Words are runs of letters, digits and non-ASCII signs, in lower case. A document leaks an item of n words if some run of its words
is within floor(edits * n) word edits (insert, delete, replace) of the whole item. With so few edits some run of q intact words is
left (pigeonhole), which places the windows: each occurrence of an item's q-gram in a document gives the window of the item's
length at that alignment. CGK walks (random walks that copy words and stall, shared by both sides) turn item and window into
strings of thrice the length, whose Hamming distance follows the edit distance; samples of DRAWS positions (tables) in each of WALKS
walks decide whether a pair goes on; the edit distance of item and surroundings then decides exactly.

The number of tables follows from the wanted recall: enough that a window whose walks agree in AGREE of the positions is missed by all
of them with a chance of at most 1 - RECALL. Windows that agree more are missed far less.

Defined cases: null or wordless texts and items match nothing; repeated rows give repeated matches; rows without doc_id or item_id
are left out of the matches (without_leaks() judges rows without doc_id too); without items or documents there are no matches; very long
texts are taken whole; of several best runs the first counts; items beyond ITEM_BYTES together are taken in several blocks, one pass each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import chunked, mix, row_key, sliced, slim_batches, word_hashes

#: Walks; positions that a key draws; the recall that the tables must reach for windows whose walks agree in so large a share of positions.
WALKS, DRAWS, RECALL, AGREE = 4, 2, 0.98, 0.25
#: Bytes of items that are broadcast at once.
ITEM_BYTES = 32 << 20


def tables(recall: float = RECALL, agree: float = AGREE) -> int:
    """Tables for each walk that reach the recall: all miss a window with chance (1 - agree^DRAWS)^(WALKS * tables)."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**DRAWS) / WALKS))


_EDGE = np.ones(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def normal(texts: pd.Series) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _grams(words: np.ndarray, q: int) -> np.ndarray:
    n = len(words) - q + 1
    return sum(words[j : j + n] * _STEPS[j] for j in range(q)) if n > 0 else words[:0]


class Items:
    """The items of one block, with their q-grams and their walks."""

    def __init__(self, ids: list[int], texts: list[bytes], edits: float, recall: float = RECALL):
        self.tables = tables(recall)
        words, first = word_hashes(texts, _EDGE)
        kept = [(i, words[a:b]) for i, a, b in zip(ids, first[:-1], first[1:]) if b > a]
        self.ids, self.words = np.array([i for i, _ in kept], np.int64), [w for _, w in kept]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.most = np.floor(self.length * edits).astype(np.int64)
        self.q = np.clip(-(-(self.length - self.most) // (self.most + 1)), 1, 3)
        self.seeds = {}
        for q in (1, 2, 3):
            rows = [(g, k, at) for k in np.flatnonzero(self.q == q) for at, g in enumerate(_grams(self.words[k], q).tolist())]
            if rows:
                g, k, at = (np.array(x, t) for x, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
                order = np.argsort(g, kind="stable")
                small = np.zeros(1 << 20, bool)
                small[g & np.uint64((1 << 20) - 1)] = True
                self.seeds[q] = small, g[order], k[order], at[order]
        self.samples = [self.sample(self.words[k][None, :])[0] for k in range(len(self.words))]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, start of the window) of each alignment that enough of an item's q-grams support.

        words are those of several documents, which begin at first. Each edit breaks at most q of the item's q-grams, and the
        others lie within twice the edits of each other's alignment; so windows with fewer hits around can't match.
        """
        found = []
        ends = first[1:]
        for q, (small, g, k, at) in self.seeds.items():
            own = _grams(words, q)
            where = np.flatnonzero(small[own & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(g, own[where], "left"), np.searchsorted(g, own[where], "right")
            many = hi - lo
            row = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            where = np.repeat(where, many)
            doc = np.searchsorted(ends, where, "right")
            inside = where + q <= ends[doc]
            item, doc, start = k[row][inside], doc[inside], (where - at[row])[inside]
            order = np.lexsort((start, doc, item))
            item, doc, start = item[order], doc[order], start[order]
            span = np.int64(len(words) + 4 * self.length.max() + 1)
            line = (item * len(ends) + doc) * span + start + 2 * self.length.max()
            around = np.searchsorted(line, line + 2 * self.most[item], "right") - np.searchsorted(line, line - 2 * self.most[item], "left")
            new = np.concatenate(([True], line[1:] != line[:-1])) if len(line) else np.zeros(0, bool)
            new &= around >= self.length[item] - q + 1 - q * self.most[item]
            found.append(np.stack([item[new], doc[new], start[new]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(found, axis=1))

    def sample(self, windows: np.ndarray) -> np.ndarray:
        """windows x (WALKS * tables) LSH keys: DRAWS positions of the CGK string each; positions depend on the length alone."""
        n, length = windows.shape
        rng = np.random.default_rng(length)
        padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
        keys = []
        for walk in range(WALKS):
            spots = rng.integers(0, 2 * length, (self.tables, DRAWS))
            taken = np.zeros((2 * length, n), np.uint64)
            at = np.zeros(n, np.int64)
            for step in range(2 * length):  # beyond it nearly all walks have ended
                sign = padded[np.arange(n), at]
                taken[step] = sign
                at = np.minimum(at + (mix(sign ^ np.uint64(walk * 100_003 + step + 1)) & np.uint64(1)).astype(np.int64), length)
            key = np.zeros((self.tables, n), np.uint64)
            for draw in range(DRAWS):
                key = key * _STEPS[0] + taken[spots[:, draw]]
            keys.append(np.where((taken[spots] != 0).all(axis=1), key, mix(np.arange(n, dtype=np.uint64) + np.uint64(walk))))
        return np.concatenate(keys).T

    def near(self, k: int, words: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, begin, end) of the best run around each window within low..high: edit distance with free ends, for all windows at once."""
        item, slack = self.words[k], int(self.most[k])
        width = len(item) + 2 * slack
        around = _cut(words, low, high, starts - slack, width)
        steps = np.arange(width + 1)
        wide = width + 2  # distance and begin in one number, so that the smallest distance takes the latest begin
        cost = np.tile(wide - 1 - steps, (len(starts), 1)).astype(np.int64)
        for sign in item:
            best = cost + wide
            best[:, 1:] = np.minimum(best[:, 1:], cost[:, :-1] + wide * (around != sign))
            cost = np.minimum.accumulate(best - wide * steps, axis=1) + wide * steps
        end = cost.argmin(axis=1)
        least = cost[np.arange(len(starts)), end]
        return least // wide, starts - slack + (wide - 1 - least % wide), starts - slack + end

    def leaks(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, distance, begin, end) of the best run of each item that documents leak; places within the document."""
        items, docs, starts = self.hits(words, first)
        low, high = first[docs], first[docs + 1]
        for k in np.unique(items).tolist():
            passed = []
            mine = np.flatnonzero(items == k)
            for lo in range(0, len(mine), 4096):
                part = mine[lo : lo + 4096]
                windows = _cut(words, low[part], high[part], starts[part], int(self.length[k]))
                passed.append(part[(self.sample(windows) == self.samples[k]).any(axis=1)])
            best: dict[int, tuple[int, int, int]] = {}
            passed = np.concatenate(passed)
            for lo in range(0, len(passed), 1024):
                part = passed[lo : lo + 1024]
                distance, begin, end = self.near(k, words, low[part], high[part], starts[part])
                for j in np.flatnonzero(distance <= self.most[k]).tolist():
                    doc, one = int(docs[part[j]]), (int(distance[j]), int(begin[j]), int(end[j]))
                    best[doc] = min(best.get(doc, one), one)
            for doc, (distance, begin, end) in best.items():
                yield doc, k, distance, begin - int(first[doc]), end - int(first[doc])


def _cut(words: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows of words from starts on; 0 where they leave their document."""
    cols = starts[:, None] + np.arange(width)
    return np.where((cols >= low[:, None]) & (cols < high[:, None]), words[np.clip(cols, 0, len(words) - 1)], np.uint64(0))


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts of a batch, hashed in chunks, and where each text's words begin."""
    parts, begins, n = [], [np.zeros(1, np.int64)], 0
    for lo, hi in chunked(texts):
        words, first = word_hashes(texts[lo:hi], _EDGE)
        parts.append(words)
        begins.append(first[1:] + n)
        n += len(words)
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(begins)


def find_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.25, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, distance, similarity, begin_word, end_word): the best match of each item that a document leaks."""
    spark = docs.sparkSession
    slim_batches(spark)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // ITEM_BYTES))
    out = None
    for block in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow().to_pandas().sort_values(["item_id", "text"])
        shared = spark.sparkContext.broadcast(Items(got["item_id"].tolist(), normal(got["text"]), edits, recall))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = shared.value
            for b in sliced(batches):
                ids = b["doc_id"].tolist()
                leaks = known.leaks(*batch_words(normal(b["text"]))) if len(known.words) else ()
                rows = [(ids[i], known.ids[k], d, 1 - d / known.length[k], begin, end) for i, k, d, begin, end in leaks]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "similarity", "begin_word", "end_word"])

        part = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        part = part.mapInPandas(run, "doc_id long, item_id long, distance long, similarity double, begin_word long, end_word long")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.25) -> DataFrame:
    """docs that leak no item, their columns kept; rows are judged by id and text, those without an id as well."""
    keyed = docs.withColumn("_key", row_key())
    leaked = find_leaks(keyed.select(F.col("_key").alias("doc_id"), "text"), items, edits).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(leaked, "_key", "left_anti").select(*docs.columns)
