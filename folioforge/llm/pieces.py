"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, byte fallback, whitespace markers.

The pieces and their log scores are read from a public model file (its path is a parameter). A text is encoded as the best sum of
scores over all segmentations of its marked form (a marker in front, and one for each space); a sign that is no piece costs the
least score less 10 and becomes its UTF-8 byte pieces. No piece crosses from other signs to a marker, so the best segmentation is
that of the words; each task segments each distinct word once, all words of a batch together by numpy over the trie's arrays.

Decoding joins the pieces and bytes, turns markers into spaces and drops the one in front. It gives the text back, but for U+2581,
which stands for a space there, as the model has it.

Of segmentations with equal scores the one found first counts, which depends on the text alone.

Defined cases: null text has null ids and null decoded text; empty text has no ids; a text without spaces is one word, however long;
an empty table gives no rows; rows repeat as they come; other columns stay in encode() and are
ignored in piece_counts().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import chunked, slim_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Words that a task remembers at most before it starts anew, and bytes of text that it takes at once.
MEMORY, SLICE = 1 << 17, 1 << 20


def read_model(raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Pieces, log scores and kinds (1 normal, 2 unknown, 3 control, 4 user, 6 byte) of a model's protobuf bytes."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(field, begin, end) of each value."""
        while at < end:
            key, at = varint(at)
            if key & 7 == 2:
                size, at = varint(at)
            elif key & 7 == 0:
                size = varint(at)[1] - at
            else:
                size = 4 if key & 7 == 5 else 8
            yield key >> 3, at, at + size
            at += size

    pieces, scores, kinds = [], [], []
    for field, a, b in fields(0, len(raw)):
        if field == 1:
            own = {f: (x, y) for f, x, y in fields(a, b)}
            pieces.append(raw[slice(*own[1])])
            scores.append(np.frombuffer(raw[slice(*own[2])], "<f4")[0] if 2 in own else 0.0)
            kinds.append(varint(own[3][0])[0] if 3 in own else 1)
    return pieces, np.array(scores, np.float64), np.array(kinds)


class Pieces:
    """A model's pieces in a double-array trie: from state s, byte b leads to base[s] + b if check[there] is s."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, kinds = read_model(raw)
        self.least = float(self.scores[kinds == 1].min()) - 10
        self.byte_ids = np.zeros(256, np.int32)
        self.plain = list(self.pieces)
        for i, (p, kind) in enumerate(zip(self.pieces, kinds)):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.plain[i] = bytes([int(p[3:5], 16)])
            elif kind in (2, 3):
                self.plain[i] = b""
        self.plain = [p.replace(MARK, b" ") for p in self.plain]
        self.plain_bytes = np.frombuffer(b"".join(self.plain), np.uint8)
        self.plain_sizes = np.array([len(p) for p in self.plain], np.int64)
        self.plain_starts = np.cumsum(self.plain_sizes) - self.plain_sizes
        self._build([(p, i) for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind in (1, 4)])

    def _build(self, entries: list[tuple[bytes, int]]) -> None:
        nodes: list[dict[int, int]] = [{}]
        ids = [-1]
        for piece, i in entries:
            at = 0
            for b in piece:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    ids.append(-1)
                at = nodes[at][b]
            ids[at] = i
        size = 4 * len(nodes) + 512
        base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, free = {0: 0}, [1] * 257  # where to look on for nodes with so many signs
        for node in range(len(nodes)):
            state, signs = place[node], sorted(nodes[node])
            leaf[state] = ids[node]
            if not signs:
                base[state] = size - 256
                continue
            at = free[len(signs)]
            while any(used[at + b] for b in signs):
                at += 1
            base[state] = free[len(signs)] = at
            for b in signs:
                used[at + b] = 1
                check[at + b] = state
                place[nodes[node][b]] = at + b
        self.base, self.check, self.leaf = base, check, leaf

    def segment(self, words: list[bytes], most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words' best segmentations in one array, the number of each word's); about so many bytes of words go together."""
        parts = [self._viterbi(words[lo:hi]) for lo, hi in chunked(words, most)]
        return np.concatenate([i for i, _ in parts]), np.concatenate([c for _, c in parts])

    def _matches(self, signs: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, id) of each piece at each sign, found by one walk of all positions at once; id -1 for a sign that is no piece."""
        heads = np.flatnonzero((signs & 0xC0) != 0x80)
        head = signs[heads]
        lengths = 1 + (head >= 0xC0) + (head >= 0xE0).astype(np.int64) + (head >= 0xF0)
        whole = np.zeros(len(signs), np.int64)
        whole[heads] = lengths
        found, live, state, depth = [], heads, np.zeros(len(heads), np.int32), 0
        while len(live):
            there = self.base[state] + signs[live + depth]
            ok = self.check[there] == state
            live, state, depth = live[ok], there[ok], depth + 1
            hit = self.leaf[state] >= 0
            found.append((live[hit], np.full(hit.sum(), depth), self.leaf[state[hit]]))
            room = stops[live] > live + depth
            live, state = live[room], state[room]
        position, length, ids = (np.concatenate(x) for x in zip(*found))
        single = np.zeros(len(signs), bool)
        single[position[whole[position] == length]] = True
        lone = heads[~single[heads]]
        return np.concatenate([position, lone]), np.concatenate([length, whole[lone]]), np.concatenate([ids, np.full(len(lone), -1, np.int32)])

    def _viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        signs = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        sizes = np.array([len(w) for w in words])
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        position, length, ids = self._matches(signs, np.repeat(first + sizes, sizes))
        within = position - first[word[position]]
        order = np.argsort(within.astype(np.uint16) if sizes.max() < 1 << 16 else within, kind="stable")
        position, length, ids = position[order], length[order], ids[order]
        score = np.where(ids >= 0, self.scores[ids], self.least)
        start = position + word[position]  # a word of n bytes has n + 1 places
        end = start + length
        best, came = np.full(len(signs) + len(words), -np.inf), np.zeros(len(signs) + len(words), np.int64)
        opens = first + np.arange(len(words))
        best[opens] = 0
        cuts = np.searchsorted(within[order], np.arange(int(sizes.max()) + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):  # within one position of each word, no two matches share an end
            reached = best[start[lo:hi]] + score[lo:hi]
            better = reached > best[end[lo:hi]]
            there = end[lo:hi][better]
            best[there] = reached[better]
            came[there] = lo + np.flatnonzero(better)
        who, at, steps = np.arange(len(words)), opens + sizes, []
        while len(who):  # back from the ends, all words at once
            match = came[at]
            steps.append((who, match))
            at = start[match]
            more = at > opens[who]
            who, at = who[more], at[more]
        owner, match = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(owner, kind="stable")
        owner, match = owner[order], match[order]
        many = np.where(ids[match] >= 0, 1, length[match])
        place = np.repeat(position[match] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        own = np.repeat(ids[match], many)
        return np.where(own >= 0, own, self.byte_ids[signs[place]]).astype(np.int32), np.bincount(np.repeat(owner, many), minlength=len(words))

    @staticmethod
    def words(text: str) -> list[bytes]:
        """The marked form, cut before each marker that follows another sign."""
        if not text:
            return []
        parts = ("▁" + text.replace(" ", "▁")).encode("utf-8", "surrogatepass").split(MARK)
        out, marks = [], 0
        for part in parts[1:]:
            marks += 1
            if part:
                out.append(MARK * marks + part)
                marks = 0
        return out + [MARK * marks] if marks else out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bytes of each) of texts that have so many ids each."""
        sizes = self.plain_sizes[ids]
        raw = _pick(self.plain_bytes, self.plain_starts[ids], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        kept = np.ones(len(raw), bool)
        kept[ends[:-1][counts > 0]] = False  # the marker in front
        return raw[kept], np.diff(ends) - (counts > 0)


def _pick(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of values, one behind the other."""
    return values[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]


class Encoder:
    """Encodes texts with a memory of segmented words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the number of each text's)."""
        split = [self.pieces.words(t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.forget()
        new = list({w for s in split for w in s}.difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            ids, counts = self.pieces.segment(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        at = np.fromiter((self.known[w] for s in split for w in s), np.int64)
        sizes = np.concatenate(([0], np.cumsum([len(s) for s in split])))
        counts = np.diff(np.concatenate(([0], np.cumsum(self.counts[at])))[sizes])
        return _pick(self.ids, self.starts[at], self.counts[at]), counts


@lru_cache(1)
def load(raw: bytes) -> Pieces:
    return Pieces(raw)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with ids (the piece ids of the whole text) and decoded (the text that they give back)."""
    slim_batches(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(load(open(model, "rb").read()))  # a public model of fixed size, read where the driver has it
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    docs = docs.select(*[f"`{f.name}`" for f in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value)
        for whole in batches:
            lengths = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0)))
            cuts = np.unique(np.searchsorted(lengths, np.arange(SLICE, int(lengths[-1]), SLICE), "right")).tolist() if len(lengths) else []
            for lo, hi in zip([0, *cuts], [*cuts, whole.num_rows]):
                if hi > lo:
                    b = whole.slice(lo, hi - lo)
                    texts = b.column("text").to_pylist()
                    null = np.array([t is None for t in texts], bool)
                    ids, counts = encoder.encode(texts)
                    raw, sizes = pieces.value.decode(ids, counts)
                    ends = [np.concatenate(([0], np.cumsum(x))).astype(np.int32) for x in (counts, sizes)]
                    valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
                    lists = pa.Array.from_buffers(pa.list_(pa.int32()), len(texts), [valid, pa.py_buffer(ends[0])], children=[pa.array(ids, pa.int32())])
                    decoded = pa.Array.from_buffers(pa.string(), len(texts), [valid, pa.py_buffer(ends[1]), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([*b.columns, lists, decoded], [*b.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def piece_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip, decoded_sha256) for each row of docs."""
    got = encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return got.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"))
