"""Classifiers and rules on long texts: work in proportion to the text, and the results of short ones."""

import random
import re
import time

from pyspark.sql import functions as F

from folioforge.functions import classifier_patterns as cp
from folioforge.functions import regex
from folioforge.operators import classify

N = 20_000


def test_policies_of_a_text_of_many_beginnings(spark):
    """Each sentence begins what only stands complete at the text's start."""
    text = "Authors may submit to other venues. " + "Authors may submit a rebuttal. " * N
    begin = time.time()
    got = {r["policy"]: r for r in classify.policy_class(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).collect()}
    assert time.time() - begin < 40
    assert (got["concurrent_submission"]["label"], got["concurrent_submission"]["score"]) == ("allowed", 1) and got["concurrent_submission"]["evidence"].startswith("Authors may submit to other venues")
    assert got["llm_policy"]["label"] == "not_mentioned" and got["llm_policy"]["confidence"] == "low"


def test_page_limit_of_a_text_of_many_limits(spark):
    text = "É Papers: 5 pages plus unlimited references. " + "Submissions are limited to 9 pages. " * N + "A full paper has 8 pages excluding references, \U0001f600 says the submission guide."
    texts = spark.createDataFrame([(1, text), (2, None), (3, "none")], "k int, text string")
    begin = time.time()
    got = classify.page_limit(texts, ["k"]).collect()
    assert time.time() - begin < 40
    assert [tuple(r) for r in got] == [(1, "8 pages", "8 pages excluding references", "high")]
    assert {tuple(r) for r in classify.page_exclusions(classify.page_limit(texts, ["k"]), texts, ["k"]).collect()} == {(1, "references", "unlimited")}


def test_the_cut_behind_the_last_end_loses_no_match(spark):
    rng = random.Random(4)
    words = ["AI", "may use", "LLMs", "must disclose", "prohibited", "not allowed", "is", "encouraged to submit", "data", "code", "other venues", "authors may submit", "to", "\n", "concurrently", "encouraged to provide", "source code", "usage of AI allowed"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    gapped = [rx for labels in cp.POLICIES.values() for rxs in labels.values() for rx in rxs if classify.until(rx, re.I | re.S)]
    assert len(gapped) == 7
    rows = spark.createDataFrame([(i, regex.fold(t)) for i, t in enumerate(texts)], "k int, low string")
    found = 0
    for rx in gapped:
        java = F.lit(regex.java_of_folded(rx, re.I | re.S))
        cut = F.coalesce(F.regexp_substr("low", F.lit(classify.until(rx, re.I | re.S))), F.lit(""))
        for r in rows.select("k", F.regexp_extract_all(cut, java, F.lit(0)).alias("m")).collect():
            want = [m.group(0).lower() for m in re.finditer(rx, texts[r["k"]], re.I | re.S)]
            assert r["m"] == want, (rx, texts[r["k"]])
            found += len(want)
    assert found > 100


def test_each_match_holds_all_literals():
    assert regex.literals(r"authors?\s+may\s+submit(?:.*?)(?:to\s+)?other\s+venues") == ["author", "submit", "venues", "other", "may"]
    assert regex.literals(r"(?:one|two)\s+(\d+)") == [] and regex.literals(r"a\s+b") == ["a"]


def test_rules_take_negations_without_texts(spark):
    """A boolean's words are sought in its own text, which no join carries along."""
    from folioforge.functions.patterns import fields_table, patterns_table
    from folioforge.plans.rules import typed_of

    rows = [("A", 2000, "No rebuttals this year. Authors may submit a rebuttal."), ("B", 2000, "Authors may submit a rebuttal."), ("C", 2000, None)]
    got = typed_of(spark.createDataFrame(rows, "entity string, year int, text string"), fields_table(spark), patterns_table(spark))
    values = {(r["entity"], r["field"]): r["value"] for r in got.collect()}
    assert values["A", "rebuttal_allowed"] == "false" and values["B", "rebuttal_allowed"] == "true" and not any(k == "C" for k, _ in values)


def test_normal_forms_come_in_batches_of_bounded_size(spark, tmp_path):
    from folioforge.plans.rules import clean_feed_nfkc

    spark.createDataFrame([(1, "\u2460 x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert clean_feed_nfkc(spark, str(tmp_path)).first()["text"] == "fi1 x"
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def test_patterns_look_at_the_first_sign_and_match_as_before(spark):
    """A choice at a pattern's beginning isn't tried at each place of a text; what matches stays what Python's dialect says."""
    assert regex.java_of_folded(r"(?:papers?|a\s+b)x") == r"(?dmU)(?=[pa])(?:papers?|a[\s\x1c-\x1f]+b)x" and regex.java_of_folded(r"a(?:b|c)").startswith("(?dmU)a")
    assert not any("?=" in regex.java_of_folded(rx) for rx in (r"(?:a)?", r"\b", r"[^a]b", r".a", r"(?:a|)b*"))
    rng = random.Random(5)
    patterns = [r"(?:a|bc)+x", r"\b(?:ab|c)\b", r"(?:a\s+)?b", r"[A-Ck]\s*x", r"\s*x", r"(?:\d|x)+a", r"^(?:a|b)", r"(?!ab)(?:a|c).", r"(?:a?|b)c", r"(?<=a)(?:b|c)"]
    texts = ["".join(rng.choice("aAbBcCkKxX 1\n\u212a\u0130") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, text string").select("k", regex.folded(F.col("text")).alias("low"))
    for rx in patterns:
        for r in rows.select("k", "low", F.regexp_extract_all("low", F.lit(regex.java_of_folded(rx)), F.lit(0)).alias("m")).collect():
            assert r["m"] == [m.group(0) for m in re.finditer(rx, r["low"], re.I | re.M)], (rx, r["low"])


def test_negations_go_through_a_long_text_once_a_word(spark):
    from folioforge.functions import text as t

    # on one text of 24 MB, each further time that it is made small again counts
    rows = spark.createDataFrame([(1, "No chairs. ")], "k int, text string").withColumn("text", F.concat(F.repeat("text", F.lit(4)), F.repeat(F.lit("Ordinary words of a page. "), F.lit(900_000)), F.lit("chairs")))
    words = [f"word {k}" for k in range(40)] + ["chairs"]
    begin = time.time()
    got = rows.select(t.let(F.lower("text"), lambda low: F.transform(F.array(*map(F.lit, words)), lambda w: t.negated_low(low, w))).alias("d")).first()["d"]
    assert time.time() - begin < 12
    assert got == [False] * 40 + [True]
    few = spark.createDataFrame([("NO Papers",), ("papers, not now",), ("x" * 60 + "papers",), ("",), (None,)], "text string")
    assert [r[0] for r in few.select(t.negated(F.col("text"), "Papers")).collect()] == [True, False, False, False, None]
