"""Long repeats by a run-length index (r-index) of the corpus's repetitive parts.

A byte goes if a WINDOW-byte string over it also starts earlier: in a document with a smaller doc_id, or earlier in the same one.

1. Equal whole texts (by length and two 64-bit hashes): only the first stays in play; the others, if as long as a window, go whole.
2. Each window names its anchor, the k-mer of least hash (the leftmost of equals); equal windows name equal anchors, at the same
   place within. Spark counts anchors; only windows whose anchor occurs twice can repeat. Consecutive windows with one anchor are
   cut out with the bytes under them (a context). Equal contexts are one, with their first place; the others' windows all repeat.
3. The distinct contexts of anchors that have several go to tasks by anchor, in buckets of about BUCKET_BYTES. An anchor with more
   than HOT of them is split: by the windows' distance to it and by the bytes that all windows at such distances share, which
   equal windows have in common; halves that are still too many are split again, down to single windows. So no bucket holds more
   than HOT contexts of one key, whatever the corpus.
4. In each bucket a run-length index is built: the Burrows-Wheeler transform as runs, rank by runs, suffix samples at run ends, and
   for each range of suffixes that share a window the earliest place where it starts. Contexts are then streamed through it
   backwards, all at once, by LF steps; a position whose row lies in such a range has a matching statistic of a window or more, and
   repeats if the range starts earlier.

Places of windows come back to their documents, and runs of bytes under them are removed. What hashes decide (equal texts, equal
contexts) would be runs of the transform that no window boundary cuts; the index decides all matches between unlike contexts.

Defined cases: null is empty; rows without doc_id come after all others; rows that share doc_id and text are one document; unlike texts
that share a doc_id are ordered by a hash of the text; texts shorter than a window stay whole; very long texts are read in parts that
overlap by a window less one byte; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import encoded, has_bit, id_bits, marked, only_maybe, settle, sliced, slim_batches

WINDOW, KMER = 100, 32
BUCKET_BYTES = 1 << 18
#: Distinct contexts of one anchor that are indexed together; more are split.
HOT = 500
#: Bytes whose anchors are found at once.
PART = 1 << 16
SPAN = WINDOW - KMER + 1
_LAST = (1 << 63) - 1
_BASES = [pow(0x9E3779B1, 1 << k, 1 << 32) for k in range(KMER.bit_length() - 1)]
_MULTIPLY = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, anchor's hash, first window, number of windows, where the anchor begins in the first) of each run of windows with one anchor.

    Texts are taken together up to PART bytes; longer ones in parts that overlap by a window less one byte.
    """
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PART):
            piece = t[at : at + PART + WINDOW - 1]
            if size + len(piece) > PART and pieces:
                yield _runs(pieces)
                pieces, size = [], 0
            if len(piece) >= WINDOW:
                pieces.append((i, at, piece))
                size += len(piece)
    if pieces:
        yield _runs(pieces)


def _runs(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = b"".join(p for _, _, p in pieces)
    h = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h += np.uint32(1)
    for k, base in enumerate(_BASES):
        h = h[: -(1 << k)] * np.uint32(base) + h[1 << k :]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    least = h.astype(np.uint64)
    least <<= np.uint64(32)
    least |= np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    place = least.astype(np.uint32)
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    new = np.concatenate(([True], place[1:] != place[:-1]))
    new[ends - sizes] = True
    borders = ends - WINDOW + 1  # windows from here on leave their text
    new[borders[borders < len(new)]] = True
    first = np.flatnonzero(new)
    own = np.searchsorted(ends, first, "right")
    inside = first + WINDOW <= ends[own]
    stop = np.concatenate((first[1:], [len(place)]))[inside]
    first, own = first[inside], own[inside]
    at = place[first].astype(np.int64)
    words = np.ndarray((len(raw) - KMER + 1,), "V32", raw, strides=(1,))[at].view(np.uint64).reshape(-1, KMER // 8)
    name = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(_MULTIPLY):
        name = (name ^ words[:, k]) * factor
        name ^= name >> np.uint64(29)
    numbers, offsets = np.array([i for i, _, _ in pieces]), np.array([a for _, a, _ in pieces])
    return numbers[own], name, first - (ends - sizes)[own] + offsets[own], stop - first, at - first


class RunLengthIndex:
    """The run-compressed transform of contexts, each closed by a sign of its own."""

    def __init__(self, contexts: list[bytes], starts: np.ndarray):
        """starts: where each context's first byte stands in the order of the corpus; its others follow."""
        sizes = np.array([len(c) for c in contexts])
        n = int(sizes.sum()) + len(sizes)
        closes = np.cumsum(sizes + 1) - 1
        signs = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[closes] = False
        signs[body] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        reach = closes[owner] - np.arange(n)
        order, window = self._suffixes(signs, reach)
        before = signs[order - 1]
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        #: The transform: sign and first row of each run, samples at run ends, how many of a run's sign stand in earlier runs.
        self.run_sign, self.run_row = before[heads], heads
        lengths = np.diff(np.concatenate((heads, [n])))
        self.samples = order[heads + lengths - 1]
        by_sign = np.argsort(self.run_sign, kind="stable")
        sums = np.cumsum(lengths[by_sign]) - lengths[by_sign]
        self.run_rank = np.zeros(len(heads), np.int64)
        self.run_rank[by_sign] = sums  # rows of smaller signs included, so that LF needs no further count
        self.rows, self.count = n, len(sizes)
        self.run = np.repeat(np.arange(len(heads), dtype=np.int32), lengths)
        # Ranges of rows whose suffixes share a window, with the earliest start.
        shared = np.concatenate(([False], (window[order[1:]] == window[order[:-1]]) & (reach[order[1:]] >= WINDOW)))
        first = np.flatnonzero(~shared)
        place = starts[owner] + (np.arange(n) - (closes - sizes)[owner])
        size = np.diff(np.concatenate((first, [n])))
        self.range = np.where(size > 1, np.arange(len(first)), -1).astype(np.int32).repeat(size)
        self.earliest = np.minimum.reduceat(place[order], first)

    @staticmethod
    def _suffixes(signs: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array, a number for the WINDOW signs from each position). Prefix doubling of the suffixes that still tie; closing signs count as unlike."""
        n = len(signs)
        key, width = np.zeros(n, np.int64), 7
        for k in range(width):
            key = (key << 9) | np.where(reach >= k, np.concatenate((signs[k:], np.zeros(k, np.int64))), 0)
        order = np.argsort(key, kind="stable")  # equal cut-off keys stay in the order of their contexts
        sorted_ = key[order]
        new = np.concatenate(([True], (sorted_[1:] != sorted_[:-1]) | (reach[order[1:]] < width)))
        rank = np.zeros(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        window = None
        while True:
            if 2 * width > WINDOW >= width:
                window = rank * n + np.concatenate((rank[WINDOW - width :], np.zeros(WINDOW - width, np.int64)))[:n]
            tied = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
            if not len(tied) and window is not None:
                return order, window
            if len(tied):
                own = order[tied]
                key = rank[own] * n + rank[np.minimum(own + width, n - 1)]
                by = np.argsort(key)
                own, key = own[by], key[by]
                order[tied] = own
                new[tied] = np.concatenate(([True], key[1:] != key[:-1]))
                rank[own] = np.maximum.accumulate(np.where(new[tied], tied, 0))
            width *= 2

    def step(self, rows: np.ndarray) -> np.ndarray:
        """LF: the rows of the suffixes one sign longer."""
        run = self.run[rows]
        return self.run_rank[run] + rows - self.run_row[run]

    def stream(self, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Backwards over all contexts at once: (signs left to the end, contexts, whether a window repeats there, the earliest start)."""
        who = np.arange(self.count)
        rows = who.copy()  # closing signs are the least, in the order of their contexts
        for taken in range(1, int(sizes.max(initial=0)) + 1):
            more = sizes[who] >= taken
            who, rows = who[more], self.step(rows[more])
            if taken >= WINDOW:
                at = self.range[rows]
                yield taken, who, at >= 0, self.earliest[at]


def repeated_windows(contexts: list[bytes], docs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(context, first window, number of windows): runs of a context's windows that start earlier elsewhere among the contexts."""
    order = np.lexsort((places, docs))
    rank = np.zeros(len(docs), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], docs[order][1:] != docs[order][:-1]))) if len(docs) else 0
    starts = (rank << 34) + places
    sizes = np.array([len(c) for c in contexts])
    many = sizes - WINDOW + 1
    base = np.cumsum(many) - many
    flags = np.zeros(int(many.sum()), bool)
    for taken, who, held, earliest in RunLengthIndex(contexts, starts).stream(sizes):
        window = sizes[who] - taken
        flags[base[who] + window] = held & (earliest < starts[who] + window)
    owner = np.repeat(np.arange(len(many)), many)
    edge = np.concatenate(([True], (flags[1:] != flags[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(edge)
    length = np.diff(np.concatenate((first, [len(flags)])))
    for f, c in zip(first[flags[first]].tolist(), length[flags[first]].tolist()):
        yield int(owner[f]), f - int(base[owner[f]]), c


def _named(docs: DataFrame) -> DataFrame:
    """(id, text, t, u): two 64-bit hashes of each whole text; null is empty."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})


def _repeated(docs: DataFrame) -> DataFrame:
    """(h): anchors that occur twice or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _, _, _ in anchors(encoded(b["text"])))])
            h, c = np.unique(hashes, return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "c": np.minimum(c, 2).astype(np.int32)})

    return docs.select("text").mapInPandas(run, "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h")


def _contexts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Contexts (h anchor, c hash, id, t, at, many, off) of the anchors in repeated and of some others, which have one place and change nothing.

    at is the first window, many the number of windows, off where the anchor begins in the first. h and c together are 128 bits.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(repeated))
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            texts, ids, names = encoded(b["text"]), b["id"].to_numpy(np.int64), b["t"].to_numpy(np.int64)
            for number, h, first, many, off in anchors(texts):
                rows = np.flatnonzero(has_bit(bits.value, h))
                number, first, many = number[rows], first[rows], many[rows]
                c = np.fromiter((digest(texts[i][a:z]) for i, a, z in zip(number.tolist(), first.tolist(), (first + many + WINDOW - 1).tolist())), np.uint64, len(rows))
                yield pd.DataFrame({"h": h[rows].view(np.int64), "c": c.view(np.int64), "id": ids[number], "t": names[number], "at": first, "many": many.astype(np.int32), "off": off[rows].astype(np.int32)})

    return docs.select("id", "t", "text").mapInPandas(run, "h long, c long, id long, t long, at long, many int, off int")


def _halves(hot: DataFrame, level: int) -> DataFrame:
    """Contexts (h, anchor's key; own bytes; ...) cut at the level's distances of their windows to the anchor, with keys by the bytes that all windows of a part share."""
    step = -(-SPAN // (1 << level))
    parts = hot.withColumn("d", F.explode(F.sequence(F.floor(F.greatest(F.col("off") - F.col("many") + 1, F.lit(0)) / step), F.floor(F.col("off") / step))))
    high = F.least(F.col("off").cast("long"), (F.col("d") + 1) * step - 1)
    low = F.greatest(F.col("off") - F.col("many") + 1, F.col("d") * step)
    parts = parts.withColumns({"skip": (F.col("off") - high).cast("int"), "left": (high - low + 1).cast("int"), "core": F.substring("own", (F.col("off") - F.col("d") * step + 1).cast("int"), F.lit(WINDOW + 1 - step))})
    own = F.substring("own", F.col("skip") + 1, F.col("left") + WINDOW - 1)
    parts = parts.select(F.xxhash64("h", F.lit(level), "d", "core").alias("h"), "id", "t", (F.col("at") + F.col("skip")).alias("at"), F.col("left").alias("many"), (F.col("off") - F.col("skip")).alias("off"), own.alias("own"))
    return parts.withColumn("c", F.xxhash64("own"))


def find_repeats(docs: DataFrame) -> DataFrame:
    """(id, t, spans): for each document (id, whole-text hash) the windows that repeat, as (first window, number of windows)."""
    place = F.struct("id", "t", "at")
    docs = _named(docs)
    texts = docs.select("id", "t", "u", F.octet_length("text").cast("long").alias("n"))
    texts = settle(texts)
    first = settle(texts.groupBy("t", "u", "n").agg(F.min("id").alias("first")))
    copies = texts.join(first, ["t", "u", "n"]).where((F.col("id") > F.col("first")) & (F.col("n") >= WINDOW)).select("id", "t", F.lit(0).cast("long").alias("at"), (F.col("n") - WINDOW + 1).cast("int").alias("many")).distinct()
    leading = only_maybe(docs, first.select("first"))
    held = settle(_contexts(leading, settle(_repeated(leading))))
    once = lambda rows, *more: rows.groupBy("h", "c").agg(F.min(F.struct("id", "t", "at", "many", "off", *more)).alias("first"), F.count(F.lit(1)).alias("places"))
    further = lambda rows, whole: rows.join(whole.where("places > 1").select("h", "c", "first"), ["h", "c"]).where(place > F.struct("first.id", "first.t", "first.at")).select("id", "t", "at", "many")
    whole = settle(once(held))
    spans = [copies, further(held, whole)]
    # Only anchors with several contexts can share a window between unlike contexts.
    several = whole.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    wanted = settle(whole.join(several, "h").select("h", "contexts", "first.*"))
    own = F.substring(F.encode("text", "utf-8"), (F.col("at") + 1).cast("int"), F.col("many") + WINDOW - 1)
    asked = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("h", "contexts", "at", "many", "off")).alias("asked"))
    source = only_maybe(docs, wanted.select("id").distinct()).join(asked, ["id", "t"])
    # Rows that repeat a document repeat its contexts; the index takes each once.
    cut_out = settle(source.select("id", "t", "text", F.explode("asked").alias("a")).select("id", "t", "a.*", own.alias("own")).drop("text").distinct())
    kept, hot, level = [cut_out.where(F.col("contexts") <= HOT)], cut_out.where(F.col("contexts") > HOT), 0
    while not hot.isEmpty():
        level += 1
        halves = settle(_halves(hot, level))
        whole = settle(once(halves, "own"))
        spans.append(further(halves, whole))
        several = whole.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
        again = settle(whole.join(several, "h").select("h", "contexts", "first.*"))
        kept.append(again.where(F.col("contexts") <= HOT))
        hot = again.where(F.col("contexts") > HOT)
    indexed = kept[0].select("h", "id", "t", "at", "own")
    for more in kept[1:]:
        indexed = indexed.union(more.select("h", "id", "t", "at", "own"))
    buckets = max(1, -(-wanted.count() * 2 * WINDOW // BUCKET_BYTES))
    indexed = indexed.select("id", "t", "at", "own", F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"))

    def find(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["id", "t", "at"], ignore_index=True)
        docs = own.groupby(["id", "t"], sort=False).ngroup().to_numpy(np.int64)
        rows = [(own["id"].iat[k], own["t"].iat[k], own["at"].iat[k] + w, m) for k, w, m in repeated_windows(own["own"].tolist(), docs, own["at"].to_numpy(np.int64))]
        return pd.DataFrame(rows, columns=["id", "t", "at", "many"])

    out = indexed.groupBy("bucket").applyInPandas(find, "id long, t long, at long, many int")
    for more in spans:
        out = out.union(more)
    return out.groupBy("id", "t").agg(F.collect_list(F.struct("at", "many")).alias("spans"))


def cut(text: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    parts, done, removed, runs, stop = [], 0, 0, 0, -1
    for a, m in sorted((s["at"], s["many"]) for s in spans):
        end = a + m + WINDOW - 1
        if a > stop:
            parts.append(text[done:a])
            runs += 1
        removed += max(0, end - max(a, stop))
        stop = max(stop, end)
        done = stop
    parts.append(text[done:])
    return removed, runs, b"".join(parts)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept are the bytes that are left, for each row of docs."""
    slim_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.col("text").cast("string").alias("text"))
    spans = settle(find_repeats(docs))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            rows = []
            for i, t, own in zip(b["id"], encoded(b["text"]), b["spans"]):
                removed, runs, kept = cut(t, own) if own is not None else (0, 0, t)
                rows.append((None if i == _LAST else i, len(t), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    # Texts without repeats stay where they are.
    rows = marked(_named(docs).drop("u"), spans.select("id").distinct())
    near = rows.where("_hit").join(spans, ["id", "t"], "left").select("id", "text", "spans")
    far = rows.where("not _hit").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return near.mapInPandas(run, schema).union(far.mapInPandas(run, schema))


def repeats_digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("kept")
