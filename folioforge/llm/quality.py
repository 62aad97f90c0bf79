"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in counts of its whole text (shares of letter kinds, repetition of words and lines, lengths). It is
learned from preference pairs (a document labelled 1 is preferred to one labelled 0): logistic loss on the feature differences.
The threshold is the quantile of the training scores at the share of label 0; a logistic map puts it at 0.5.

Defined cases: a null or empty text has all-zero counts and still gets a score; labels that are null are dropped, several labels
of a document count by their mean, and so do the counts of rows that share a labelled id; without labels of both kinds every document scores 0.5 (accepted); rows repeat as they come; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, encoded, sliced, slim_batches

#: The fit takes about so many labelled rows at most (chosen by a hash of doc_id), and so many pairs.
MOST_LABELLED = 12_000
MOST_PAIRS = 200_000

_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]


def features(text: bytes) -> list[float]:
    """Counts of one whole text; all are shares or logarithms."""
    n = len(text)
    if not n:
        return [0.0] * (len(_PUNCT) + 16)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    many, rows = max(1, len(words)), max(1, len(lines))
    lower = counts[97:123].sum()
    upper = counts[65:91].sum()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    squeezed = len(zlib.compress(text, 1))
    return [
        *np.sqrt(counts[_PUNCT]), lower, upper, upper / max(lower + upper, 1e-9), counts[48:58].sum(), counts[SPACE].sum(), counts[128:].sum(),
        np.log1p(n), np.log1p(many), np.log1p(rows), n / many / 10, len(set(words)) / many, len(set(words)) / np.sqrt(many), len(set(lines)) / rows,
        repeats / many, squeezed / n, sum(x[:1].isupper() for x in words) / many,
    ]


#: Where the logarithm of the bytes stands among the features.
_LENGTH = len(_PUNCT) + 6


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features; those of a text of a few bytes shrink towards the mean, as its shares say little."""
    n = np.expm1(x[:, _LENGTH])
    return np.clip((x - mean) / scale, -6, 6) * (n / (n + 20))[:, None]


@dataclass
class Ranker:
    """Score = logistic(slope * (w . standardised features - threshold))."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.mean, self.scale) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -30, 30)))


def fit_pairs(x: np.ndarray, label: np.ndarray, seed: int = 7, ridge: float = 1e-3) -> Ranker:
    """Bradley-Terry by Newton steps on logistic loss of differences."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, rng = standard(x, mean, scale), np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pairs = min(MOST_PAIRS, 20 * len(x))
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance of the wrong order
        gradient = d.T @ p / pairs - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step / max(1.0, np.abs(step).max())
    s = z @ w
    threshold = float(np.quantile(s, (label == 0).mean(), method="midpoint"))  # halfway between the neighbours, not closer to one class
    spread = max(1e-6, float(s[good].mean() - s[bad].mean()))
    return Ranker(mean, scale, w, threshold, 6.0 / spread)


def labelled(labels: DataFrame, train: F.Column) -> DataFrame:
    """(doc_id, label) of documents that may be learned from, at most about MOST_LABELLED by a hash of doc_id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train)
    rows = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    share = min(1.0, MOST_LABELLED / max(1, rows.count()))
    return rows.where((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) < share)  # a share of the hash's range, however small


def train_ranker(docs: DataFrame, labels: DataFrame, train: F.Column) -> Ranker | None:
    """Fit on the bounded sample; its features are counted by Spark where the texts are, the mean of an id's rows for each id."""
    slim_batches(docs.sparkSession)
    sample = labelled(labels, train).withColumnRenamed("doc_id", "_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            yield pd.DataFrame({"id": b["doc_id"], "label": b["label"], "x": [features(t) for t in encoded(b["text"])]})

    # At most about MOST_LABELLED rows of two numbers: broadcast, so that texts stay where they are.
    near = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    size = len(features(b""))
    rows = near.mapInPandas(count, "id long, label int, x array<double>").groupBy("id").agg(F.first("label").alias("label"), *[F.avg(F.col("x")[k]).alias(f"x{k}") for k in range(size)])
    got = rows.select("id", "label", F.array(*[f"x{k}" for k in range(size)]).alias("x")).toArrow().to_pandas().sort_values("id", ignore_index=True)
    if got["label"].nunique() < 2:
        return None
    return fit_pairs(np.array(got["x"].tolist()), got["label"].to_numpy())


def score_quality(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 accepted, 0 rejected); docs' other columns stay."""
    slim_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if ranker is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(ranker.score(np.array([features(t) for t in encoded(texts)]).reshape(len(texts), -1)))

    scored = docs.withColumn("_score", score(F.col("text").cast("string")))
    return scored.withColumn("_predicted", (F.col("_score") >= 0.5).cast("int"))


def in_third(doc_id: F.Column, third: int) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder of 3."""
    return F.crc32(doc_id.cast("string")) % 3 == third


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labels of rows that aren't held out."""
    ranker = train_ranker(docs, labels, ~in_third(F.col("doc_id"), 1))
    scored = score_quality(docs.select("doc_id", "text"), ranker)
    held = F.coalesce(in_third(F.col("doc_id"), 1), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
