"""Exact copies by two passes over a Bloom filter, in DataFrame functions alone.

The first pass counts, for each bit of a blocked Bloom filter, how many rows set it; a page of the filter keeps the bits that two rows
or more have set. The second pass looks up each row's bits in its page: only where all of them are set may the text stand twice. These
rows alone shuffle, as (hash, id), to be counted exactly; all others pass straight through as groups of one.

The filter has BITS_A_ROW bits for each row of the input, as a power of two, and MOST_BITS at most (32 MB, which is what is broadcast,
in pages of 4 KB). With more rows than that it fills up and lets more of them through to the exact count; plan and result stay.

A group's rows are counted in SALTS parts first and meet their totals part by part, so that a text that a third of all rows share
is neither one task's work in the count nor in the join.

Texts are equal when identical after lower-casing A-Z only; they are told apart by the SHA-256 of their UTF-8 bytes. Defined cases: a
null text counts as empty; of equal texts the row with the largest doc_id stays, ids before none; of rows that also share their doc_id
(or have none) exactly one stays, whichever; keep_id is null only where no row of the group has an id; an empty table gives no rows;
texts are hashed whole, whatever their length; other columns are ignored by find_copies and kept by without_copies, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import settle

#: Bits of the filter for each row; bits of a page; bits of the whole filter at least and at most.
BITS_A_ROW, PAGE_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 18, 1 << 28
#: Parts that a group's rows are counted in.
SALTS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: F.Column) -> F.Column:
    """The text with A-Z lower-cased and nothing else; null is empty. lower() is the faster way where there are only one-byte signs."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def text_hash(text: F.Column) -> F.Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _places(sha: F.Column, pages: int) -> tuple[F.Column, list[F.Column]]:
    """The page of a hash in the filter, and its two bits there."""
    h = F.xxhash64(sha)
    return h.bitwiseAND(pages - 1).cast("int"), [F.shiftrightunsigned(h, k).bitwiseAND(PAGE_BITS - 1).cast("int") for k in (30, 47)]


def bits_for(rows: int) -> int:
    """Bits of the filter for so many rows."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_ROW * max(1, rows) - 1).bit_length()))


def repeated_bits(hashes: DataFrame, bits: int) -> DataFrame:
    """(_page, _words): of the hashes (column sha), the bits of the filter that two rows or more have set; bits / PAGE_BITS rows at most."""
    page, places = _places(F.col("sha"), bits // PAGE_BITS)
    once = hashes.select(page.alias("page"), F.explode(F.array(*places)).alias("bit")).groupBy("page", "bit").agg(F.count(F.lit(1)).alias("rows"))
    words = once.where("rows > 1").groupBy("page", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("bits"))
    pages = words.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("own"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(PAGE_BITS // 64 - 1)), lambda k: F.coalesce(F.col("own")[k], F.lit(0)))
    return pages.select(F.col("page").alias("_page"), dense.alias("_words"))


def _probed(rows: DataFrame, filter_pages: DataFrame, bits: int) -> DataFrame:
    """rows (sha, ...) with again: whether all bits of the hash are set, so that its text may stand twice. No row moves."""
    page, places = _places(F.col("sha"), bits // PAGE_BITS)
    own = [F.get("_words", F.shiftright(b, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63))) != 0 for b in places]
    near = rows.join(F.broadcast(filter_pages), page == F.col("_page"), "left")
    return near.withColumn("again", F.coalesce(own[0] & own[1], F.lit(False))).drop("_page", "_words")


def find_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of docs."""
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("sha"), F.monotonically_increasing_id().alias("row")))
    bits = bits_for(rows.count())
    probed = _probed(rows, settle(repeated_bits(rows, bits)), bits)
    alone = probed.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")

    again = probed.where("again").select("doc_id", "sha", "row", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    last = F.max(F.struct("doc_id", "row"))  # null is the smallest
    parts = again.groupBy("sha", "salt").agg(F.count(F.lit(1)).alias("n"), last.alias("last"))
    totals = parts.groupBy("sha").agg(F.sum("n").alias("group_size"), F.max("last").alias("last"), F.collect_list("salt").alias("salts"))
    spread = totals.select("sha", "group_size", "last", F.explode("salts").alias("salt"))
    counted = again.join(spread, ["sha", "salt"]).select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "sha")
    return alone.union(counted).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows whose text can't stand twice never shuffle."""
    rows = docs.select(text_hash(F.col("text")).alias("sha"), F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    hashes = settle(rows.select("sha"))
    bits = bits_for(hashes.count())
    probed = _probed(rows, settle(repeated_bits(hashes, bits)), bits)
    one = probed.where("again").groupBy("sha").agg(F.max_by("whole", F.struct("id")).alias("whole"))
    return probed.where("not again").select("whole.*").union(one.select("whole.*"))


def oracle_sql() -> str:
    """The rows of find_copies over documents in DuckDB SQL."""
    return f"""
        with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               row_number() over (partition by norm order by doc_id desc nulls last) = 1 as kept, sha256(norm) as text_sha256
        from t
    """
