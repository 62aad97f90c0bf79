"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes counts what follows. A byte's code length is that of PPM with
escape method C: a count n of N among d different followers codes it with n / (N + d); an unseen follower costs the escape
d / (N + d) and goes on in the next shorter context; the last resort is 1 of 256. Nothing is updated while scoring (frozen counts,
no exclusions). A text's language is that of the least code length; the score is its posterior share under equal priors.

The counts come from whole texts of at most about TRAIN_BYTES for each language (an equal share of TRAIN_TOTAL, if there are many
languages), chosen by a hash of doc_id; Spark counts them.
Scoring looks each position up once in the longest known context, for all languages together, and goes on with what is missing.

Defined cases: null texts and texts without a letter (Unicode category L) are 'und' with score 0; very long texts are summed in parts; an
empty table gives no rows; rows without lang or doc_id aren't learned from; without
any training row every text is 'und'; equal code lengths take the first language by name; rows repeat as they come; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import chunked, encoded, settle, sliced, slim_batches

ORDER = 3
#: Bytes of whole texts that are learned from at most, about: of each language, and of all together, which bounds what reaches the driver.
TRAIN_BYTES, TRAIN_TOTAL = 4 << 20, 64 << 20
#: Rows of the table of languages that may be broadcast.
MOST_LANGUAGES = 10_000
_LETTER = regex.compile(r"\p{L}")
_HASH = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(each byte with the order bytes before it, packed with the length in front; where each text begins). Zeros stand before a text."""
    joined = b"".join(b"\0" * order + t for t in texts)
    buf = np.frombuffer(joined, np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    out = buf[order:] + (np.uint64(order + 1) << np.uint64(56)) if len(buf) > order else buf[:0]
    for k in range(order):
        out = out | (buf[order - 1 - k : len(buf) - 1 - k] << np.uint64(8 * (k + 1)))
    keep = np.ones(len(out), bool)
    starts = np.cumsum(sizes + order) - sizes - order
    for k in range(order):  # the zeros before the second text and on aren't positions
        keep[starts[1:] - order + k] = False
    return out[keep], np.cumsum(sizes) - sizes


def shorter(gram: np.ndarray, order: int) -> np.ndarray:
    """The gram without its first byte."""
    return (gram & np.uint64((1 << (8 * order)) - 1)) | (np.uint64(order) << np.uint64(56))


class Lookup:
    """uint64 keys to row numbers, by open addressing over numpy arrays; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[at] < 0
            slots, one = np.unique(at[free], return_index=True)
            won = left[free][one]
            self.keys[slots], self.rows[slots] = keys[won], won
            rest = self.rows[at] != left
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        rows = self.rows[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (rows >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            rows[wrong] = self.rows[at[wrong]]
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (rows[wrong] >= 0)]
        return rows


class Trees:
    """The frozen counts of all languages, turned into code lengths by order."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        """counts: lang, gram (packed as in grams, of the longest order), c."""
        self.order, self.langs = order, sorted(counts["lang"].unique())
        lang = counts["lang"].map({x: k for k, x in enumerate(self.langs)}).to_numpy()
        gram, c = counts["gram"].to_numpy(np.int64).view(np.uint64), counts["c"].to_numpy(np.float64)
        width = len(self.langs)
        self.seen, self.costs, self.contexts, self.escapes = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        below = None
        levels = []
        for k in range(order, -1, -1):
            levels.append((k, gram))
            gram = shorter(gram, k) if k else gram
        for k, own in reversed(levels):  # from the empty context up
            keys, row = np.unique(own, return_inverse=True)
            n = np.zeros((len(keys), width))
            np.add.at(n, (row, lang), c)
            context, group = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), width)), np.zeros((len(context), width))
            np.add.at(total, group, n)
            np.add.at(kinds, group, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                direct = np.log2((total + kinds)[group] / n)
            less = np.full((len(keys), width), 8.0) if below is None else self.costs[k - 1][self.seen[k - 1].find(shorter(keys, k))]
            self.costs[k] = np.where(n > 0, direct, escape[group] + less)
            self.seen[k], self.contexts[k], self.escapes[k] = Lookup(keys), Lookup(context), escape
            below = k

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """positions x languages, in bits."""
        out = np.zeros((len(gram), len(self.langs)))
        left = np.arange(len(gram))
        for k in range(self.order, -1, -1):
            row = self.seen[k].find(gram)
            known = row >= 0
            out[left[known]] += self.costs[k][row[known]]
            left, gram = left[~known], gram[~known]
            if not len(left):
                return out
            context = self.contexts[k].find(gram >> np.uint64(8))
            out[left] += np.where((context >= 0)[:, None], self.escapes[k][context], 0.0)
            gram = shorter(gram, k) if k else gram
        out[left] += 8.0
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: the code length of each whole text."""
        out = np.zeros((len(texts), len(self.langs)))
        for lo, hi in chunked(texts, 1 << 20):
            gram, starts = grams(texts[lo:hi], self.order)
            filled = np.array([len(t) > 0 for t in texts[lo:hi]])
            if len(gram):
                sums = np.zeros((filled.sum(), len(self.langs)))
                begins = starts[filled]
                for a in range(0, len(gram), 1 << 20):  # a very long text in parts
                    bits = self.code_lengths(gram[a : a + (1 << 20)])
                    first, last = np.searchsorted(begins, [a, a + len(bits)], "right")
                    inner = begins[first:last] - a
                    cuts = np.unique(np.concatenate(([0], inner[inner < len(bits)])))
                    sums[np.searchsorted(begins, cuts + a, "right") - 1] += np.add.reduceat(bits, cuts)
                out[lo + np.flatnonzero(filled)] = sums
        return out


def train_trees(docs: DataFrame, order: int = ORDER) -> Trees | None:
    """Count the contexts of docs (doc_id, text, lang) that may be learned from."""
    rows = docs.where("doc_id is not null and text is not null and lang is not null")
    sizes = settle(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")))
    most = min(TRAIN_BYTES, TRAIN_TOTAL // max(1, sizes.count()))
    # A row for each language says which share of its rows is taken; broadcast if they are as few as languages are, so that no text moves.
    share = settle(sizes.select("lang", F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("bytes", F.lit(1))).alias("share")))
    share = F.broadcast(share) if share.count() <= MOST_LANGUAGES else share
    taken = rows.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.ceil(F.col("share") * 1_000_000))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            for lang, own in b.groupby("lang"):
                texts = encoded(own["text"])
                for lo, hi in chunked(texts):
                    gram, c = np.unique(grams(texts[lo:hi], order)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "c": c})

    counts = taken.select("lang", "text").mapInPandas(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")).toArrow().to_pandas()
    return Trees(counts.sort_values(["lang", "gram"], ignore_index=True), order) if len(counts) else None


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs with _lang and _score."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("struct<lang: string, score: double>")
    def best(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        lettered = np.array([isinstance(t, str) and _LETTER.search(t) is not None for t in texts], bool)
        out = pd.DataFrame({"lang": np.full(len(texts), "und", object), "score": np.zeros(len(texts))})
        if known is not None and lettered.any():
            bits = known.totals(encoded(texts[lettered]))
            won = bits.argmin(axis=1)
            share = 1 / np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0)).sum(axis=1)
            out.loc[lettered, "lang"] = np.array(known.langs, object)[won]
            out.loc[lettered, "score"] = share
        return out

    got = docs.withColumn("_best", best(F.col("text").cast("string")))
    return got.withColumn("_lang", F.col("_best.lang")).withColumn("_score", F.col("_best.score")).drop("_best")


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from rows that aren't held out."""
    slim_batches(docs.sparkSession)
    trees = train_trees(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    got = predict(docs.select("doc_id", "text"), trees)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
