"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they don't know.

The base spans (e-mail, IP, card, phone) are the seeds. The words around an instance make lexical patterns: the last word before it, the
last two, and the words on both sides. Spark scores the graph of patterns and instances (values) in rounds: a pattern's score is the weight of known values among
all its occurrences before anything in the whole corpus, and a value that isn't a seed gets the best score of its accepted patterns,
which raises further patterns, also those that no seed stands behind. A pattern is accepted with MIN_VALUES different known values
and a score of MIN_SCORE; values of accepted patterns are identifiers wherever they occur as whole tokens. Scores only rise; rounds
go on until no new pattern is accepted and the accepted scores together rise by no more than SETTLED. In each round, occurrences are
counted for the patterns that known values newly reach, but for those whose instances alone already press the score below MIN_SCORE.

Instances are tokens with a digit, of 5 to 64 signs without the punctuation around them, that overlap no base span.

Defined cases: null is empty; rows repeat as they come, each with its spans; ids play no part in the search; other columns are
ignored; with no seeds or too few there are just the base spans; an empty table gives no rows; very long texts are taken whole; equal
texts get equal spans. redact() tells rows apart by id and text, so rows without an id and unlike texts of one id keep their own spans.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import _STEP, encoded, has_bit, id_bits, row_key, settle, sliced, slim_batches, chunked, mix, word_hashes

KINDS = ("email", "ip", "card", "phone", "id")
MIN_VALUES, MIN_SCORE, SETTLED = 5, 0.5, 0.001

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_AROUND = "\"'`()[]{}<>,;:!?#$%&*|=~^."


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: its local part to the left (no further than the last match), its domain to the right."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            yield left, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return out


def pattern_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word but the first: the pattern of the word before it; for each but the first two: that of the two before it."""
    one = mix(words[:-1] * _STEP + np.uint64(1))
    return one, mix(words[:-2] * _STEP + words[1:-1] + np.uint64(2)) if len(words) > 2 else words[:0]


def frame_keys(words: np.ndarray) -> np.ndarray:
    """For each word but the first and the last: the pattern of the words on both sides."""
    return mix(mix(words[:-2] * _STEP + np.uint64(3)) + words[2:]) if len(words) > 2 else words[:0]


def _instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, bool, list[bytes], list[bytes]]]:
    """(start, end, value, is a seed, up to two words before, the word behind) of the seeds and of the other tokens with a digit."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    begins = [a for a, _ in tokens]
    taken = sorted((a, b) for _, a, b in base)

    def before(k: int) -> list[bytes]:
        return [text[a:b].encode("utf-8", "surrogatepass") for a, b in tokens[max(0, k - 2) : k]]

    def behind(k: int) -> list[bytes]:
        return [text[a:b].encode("utf-8", "surrogatepass") for a, b in tokens[k : k + 1]]

    for a, b in taken:
        yield a, b, text[a:b].lower(), True, before(bisect.bisect_right(begins, a) - 1), behind(bisect.bisect_left(begins, b))
    j = 0
    for k, (a, b) in enumerate(tokens):
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        if any(x < b and y > a for x, y in taken[j : j + 8]) or not _DIGIT.search(text, a, b):
            continue
        core = text[a:b]
        left = a + len(core) - len(core.lstrip(_AROUND))
        value = core.strip(_AROUND)
        if 5 <= len(value) <= 64:
            yield left, left + len(value), value.lower(), False, before(k), behind(k + 1)


def _scan(docs: DataFrame) -> DataFrame:
    """Each row with a number of its own, its base spans and its instances with the keys of their patterns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = TaskContext.get().partitionId() << 40
        for b in sliced(batches):
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                found = []
                if base or _DIGIT.search(text):
                    for a, z, value, seed, words, after in _instances(text, base):
                        hashes = word_hashes([*words, *after])[0]
                        own = np.concatenate([hashes[: len(words)], np.zeros(1, np.uint64), hashes[len(words) :]])
                        one, two = pattern_keys(own[: len(words) + 1])
                        frame = frame_keys(own[len(words) - 1 :]) if words and after else own[:0]
                        found.append((a, z, value, seed, *(int(x[-1:].view(np.int64)[0]) if len(x) else None for x in (one, two, frame))))
                rows.append((uid, None if pd.isna(doc_id) else int(doc_id), [(int(k), a, z) for k, a, z in base], found))
                uid += 1
            out = pd.DataFrame(rows, columns=["uid", "doc_id", "base", "found"])
            yield out.astype({"doc_id": "Int64"})

    span = "kind: int, start: long, stop: long"
    return docs.mapInPandas(run, f"uid long, doc_id long, base array<struct<{span}>>, found array<struct<start: long, stop: long, value: string, seed: boolean, one: long, two: long, frame: long>>")


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each occurs around any word of the corpus; a bitmap of fixed size keeps other keys at home."""
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(patterns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches):
            texts, kept = encoded(b["text"]), []
            for lo, hi in chunked(texts):
                words, first = word_hashes(texts[lo:hi])
                if len(words) < 2:
                    continue
                place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                one, two = pattern_keys(words)
                for keys in (one[place[1:] >= 1], two[place[2:] >= 2], frame_keys(words)[place[2:] >= 2]):
                    kept.append(keys[has_bit(bits.value, keys)])
            keys, total = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"pattern": keys.view(np.int64), "total": total})

    seen = docs.select("text").mapInPandas(run, "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return seen.join(patterns, "pattern", "left_semi")


def find_pii(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, base, extra): arrays of (kind, start, stop) for each row; extra holds what the patterns add, of kind id."""
    slim_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = settle(_scan(docs))
    found = rows.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    edges = found.select("value", "seed", F.explode(F.array("one", "two", "frame")).alias("pattern")).where("pattern is not null")
    edges = settle(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("c")))
    widely = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("c").alias("held")).where(F.col("values") >= MIN_VALUES).select("pattern", "held")
    edges = settle(edges.join(widely, "pattern"))
    nothing = F.array().cast("array<struct<kind:int,start:bigint,stop:bigint>>")
    known = seeds = settle(edges.where("seed").select("value").distinct().withColumn("score", F.lit(1.0)))
    totals, before = None, (0, 0.0)
    while True:
        scored = edges.join(known, "value").groupBy("pattern").agg(F.sum(F.col("c") * F.col("score")).alias("hit"), F.first("held").alias("held"), F.sum((F.col("score") >= MIN_SCORE).cast("long")).alias("values"))
        scored = settle(scored.where((F.col("values") >= MIN_VALUES) & (F.col("hit") >= MIN_SCORE * F.col("held"))).select("pattern", "hit", "held"))
        new = scored.select("pattern") if totals is None else settle(scored.select("pattern").join(totals, "pattern", "left_anti"))
        if not new.isEmpty():
            counted = new.join(_occurrences(docs, new), "pattern", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))
            totals = settle(counted if totals is None else totals.union(counted))
        if totals is None:
            break
        accepted = scored.join(totals, "pattern").select("pattern", (F.col("hit") / F.greatest("total", "held")).alias("p")).where(F.col("p") >= MIN_SCORE)
        accepted = settle(accepted)
        now = tuple(accepted.agg(F.count(F.lit(1)), F.coalesce(F.sum("p"), F.lit(0.0))).first())
        reached = edges.join(accepted, "pattern").groupBy("value").agg(F.max("p").alias("score"))
        known = settle(seeds.union(reached.select("value", "score")).groupBy("value").agg(F.max("score").alias("score")))
        if now[0] <= before[0] and now[1] - before[1] <= SETTLED:
            break
        before = now
    if not before[0]:
        return rows.select("uid", "doc_id", "base", nothing.alias("extra"))
    added = found.where("not seed").join(known.where(F.col("score") >= MIN_SCORE), "value", "left_semi")
    added = added.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct(F.lit(4).alias("kind"), "start", "stop"))).alias("extra"))
    return rows.join(added, "uid", "left").select("uid", "doc_id", "base", F.coalesce("extra", nothing).alias("extra"))


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["stop"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans, for each row of docs."""
    got = find_pii(docs)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return got.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "extra")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, in rows without an id as well; n_chars, where docs has it, follows."""
    keyed = docs.withColumn("_key", row_key())
    extra = find_pii(keyed.select(F.col("_key").alias("doc_id"), "text")).where(F.size("extra") > 0).select(F.col("doc_id").alias("_key"), "extra")
    extra = settle(extra.groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_set("extra"))).alias("_extra")))

    def clean(text: str | None, more) -> str | None:
        if text is None:
            return None
        spans = sorted([(a, b, k) for k, a, b in base_spans(text)] + [(s["start"], s["stop"], s["kind"]) for s in more])
        parts, done = [], 0
        for a, b, k in spans:
            if a >= done:
                parts += [text[done:a], f"[{KINDS[k].upper()}]"]
            elif b <= done:
                continue
            done = max(done, b)
        return "".join([*parts, text[done:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean(t, ()), na_action="ignore")

    @F.pandas_udf("string")
    def cleaned_of(texts: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([clean(t, m if m is not None else ()) for t, m in zip(texts, more)])

    if extra.isEmpty():
        out = docs.withColumn("text", cleaned("text"))
    else:
        near = keyed.join(extra, "_key", "left")
        out = near.withColumn("text", cleaned_of("text", "_extra")).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
