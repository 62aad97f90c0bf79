"""What is sought before a pattern is tried is found wherever the pattern is, and tells most texts without a match."""

import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from folioforge.functions import classifier_patterns as cp
from folioforge.functions.patterns import patterns_table
from folioforge.functions.regex import folded, java_of_folded, sought

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    c, parser = re._constants, re._parser

ODD = [r"(?:ab)+page(?:s|t)? x", r"x*\bword\b.*?tail", r"(?:a|bc){2,3}(q+)long(?=er)", r"^\s*name: (?:mr )?smith", r"(\w)\1word", r"(?:no|not)\s+(?:a |an )?late\s+(?:paper|poster)s?", r"[^x]{0,30}mark", r"(?i:ab)word", r"(?:é|e)word"]


def made(tree, rng):
    """A string that a sequence matches, look-around aside."""
    out = ""
    for op, av in tree:
        if op is c.LITERAL:
            out += chr(av)
        elif op is c.IN:
            kind, value = rng.choice(av)
            out += {c.LITERAL: lambda: chr(value), c.RANGE: lambda: chr(rng.randint(*value)), c.CATEGORY: lambda: {c.CATEGORY_DIGIT: "7", c.CATEGORY_SPACE: rng.choice(" \n"), c.CATEGORY_WORD: "w"}.get(value, "-"), c.NEGATE: lambda: "-"}[kind]()
        elif op in (c.ANY, c.NOT_LITERAL):
            out += "-"
        elif op is c.SUBPATTERN:
            out += made(av[3], rng)
        elif op is c.BRANCH:
            out += made(rng.choice(av[1]), rng)
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            out += "".join(made(av[2], rng) for _ in range(rng.randint(av[0], min(av[0] + 3, 99 if av[1] is c.MAXREPEAT else av[1]))))
    return out


@pytest.mark.parametrize("flags", [re.I | re.M, re.I, re.I | re.S])
def test_found_wherever_the_pattern_is(spark, flags):
    rng, rows = random.Random(2), []
    patterns = [*ODD, *cp.PAGE] + [r["regex"] for r in patterns_table(spark).select("regex").collect()]
    for rx in patterns:
        low = java_of_folded(rx, flags)
        if low is not None:
            for k in range(6):
                hit = made(parser.parse(rx, flags), rng)
                rows.append((f"{rng.choice(['', 'x ', 'Some words, ', chr(10)])}{hit.upper() if k == 0 else hit}{rng.choice(['', '.', 'er and more'])}", rx, low, sought(rx, flags)))
    df = spark.createDataFrame(rows, "text string, rx string, low string, sought array<string>").withColumn("text", folded(F.col("text")))
    got = df.select("text", "rx", F.regexp_like("text", F.col("low")).alias("hit"), F.forall("sought", lambda s: F.regexp_like(F.col("text"), s)).alias("may"), F.size("sought").alias("n"))
    assert got.where("hit").count() > len(rows) // 2
    assert got.where("n > 0").count() > len(rows) // 4
    assert got.where("hit AND NOT may").collect() == []


def test_most_texts_without_a_match_are_told(spark):
    text = "Call for position papers. Limited to 9 pages, excluding references. The LaTeX template is required."
    rxs = [r"\b(?:no|without|not) (?:a |an |any )?(?:position paper)", cp.PAGE[3], r"(?:latex )?template is required (?:is|are) not allowed"]
    for rx in rxs:
        one = spark.createDataFrame([(text, sought(rx))], "text string, sought array<string>").select(F.forall("sought", lambda s: F.regexp_like(folded(F.col("text")), s)))
        assert not one.first()[0], rx
