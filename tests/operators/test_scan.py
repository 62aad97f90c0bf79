"""The rule scan: the dialect of patterns, their literals, places of matches, tables of many patterns."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioforge.functions import classifier_patterns, regex
from folioforge.functions.patterns import PATTERNS, fields_table, patterns_table
from folioforge.operators import scan

DIALECT = [
    r"(?i)(?<!camera[- ]ready\s)(?<!final\s)submission\s+deadline\s*:?", r"(?<![A-Za-z])cmt(?![a-z])", r"(?P<word>\w+) (?P=word)", r"(\w)\1", r"[]a\[^-]+", r"[^]\s]+x", r"a{,2}b", r"x{2}|y{2,3}?", r"(?s:a.b)", r"^a.*$", r"due\Z",
    r"(?#note)held in", r"a++b", r"(?>ab|a)c", r"\bno\b\s", r"[\W\d]{3}", r"\S+\v?", r"caf\xe9", r"straße", r"[A-Z][a-z]+ \d{1,2}", "K", "[i-k]s", r"{not a count}", r"(?:oral|poster)s? (?=talk)", r"é|è", r"\d\s*(?:MB|GB)",
]
TEXTS = [
    "", "Submission deadline: May 3", "camera-ready submission deadline: x", "final submission  deadline", "the acmtool, then cmt1 and CMT.", "the the end", "aab bookkeeping", "a[^-]]x", "a\nb a.b aa", "yyyx xxy", "due\n", "due", "Held In Rome", "aaab abc ac",
    "is no more", "--- 12!", "x\x1cy z w", "CAFÉ café", "STRASSE straße", "June 12, jUNE 3", "K ſs İs ıs Js", "{not a count} {NOT", "Oral talk posters talk", "10 MB 5gb", "É È", "a b", "\U0001f600 aa \U0001f600 no x",
]


def test_java_form_matches_as_python_does(spark):
    """Place and text of each first match, on the text itself and on the folded one."""
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    first = lambda col, rx: F.when(col.rlike(rx), F.struct((F.length(F.get(F.split(col, rx, 2), F.lit(0)))).alias("at"), F.length(F.regexp_substr(col, F.lit(rx))).alias("size")))
    columns, low = [], regex.folded(F.col("text"))
    for k, p in enumerate(DIALECT):
        columns.append(first(F.col("text"), regex.java(p)).alias(f"p{k}"))
        small = regex.java_of_folded(p)
        columns.append((first(low, small) if small else F.lit(None)).alias(f"low{k}"))
    for row in texts.select("i", *columns).collect():
        for k, p in enumerate(DIALECT):
            m = re.search(p, TEXTS[row["i"]], re.I | re.M)
            want = (m.start(), m.end() - m.start()) if m else None
            odd = bool(set("İıſ\u212a") & set(TEXTS[row["i"]]))  # Java and Python differ on these with a letter of another size, and in back-references
            for name, doubtful in ((f"p{k}", ("K", "[i-k]s", *DIALECT[2:4])), (f"low{k}", DIALECT[2:4])):
                if not (odd and p in doubtful) and (name[0] == "p" or regex.java_of_folded(p)):
                    assert (tuple(row[name]) if row[name] else None) == want, (name, p, TEXTS[row["i"]])
    assert sum(regex.java_of_folded(p) is None for p in DIALECT) == 3  # letters beyond ASCII


def test_conditions_on_groups_are_refused():
    with pytest.raises(ValueError, match="Java"):
        regex.java(r"(a)?b(?(1)c|d)")


def test_each_match_holds_its_literal():
    rng = random.Random(2)
    atoms = ["a", "B", "k", "ab", "[xy]", ".", r"\s", "(?:cd|ce)", "(ef)", "g+", "h?", "i{2}", "j*", r"\b", "(?=k)", "(?<!l)", "É"]
    held = 0
    for _ in range(3000):
        p = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.2:
            p = f"(?:{p})+|{rng.choice(atoms)}" if rng.random() < 0.5 else f"({p}){rng.choice(['+', '?', '{2}'])}z"
        need = regex.literal(p)
        for _ in range(12):
            t = "".join(rng.choice("abBkKcdeéÉfghiIİıſjklxyz K") for _ in range(rng.randint(0, 14)))
            m = re.search(p, t, re.I | re.M)
            if m:
                held += bool(need)
                assert need in regex.fold(m.group(0)), (p, t)
    assert held > 300


def test_literals_of_the_librarys_patterns():
    own = [rx for _, _, rx in PATTERNS] + [rx for groups in (classifier_patterns.POLICIES.values(), [classifier_patterns.REVIEW]) for labels in groups for rxs in labels.values() for rx in rxs]
    assert sum(len(regex.literal(rx)) >= 3 for rx in own) > 0.9 * len(own)


def scanned(spark, rows, patterns, fields=("f", "g")):
    texts = spark.createDataFrame(rows, "k int, text string")
    table = spark.createDataFrame(patterns, "field string, pattern_idx int, name string, regex string")
    known = spark.createDataFrame([(f,) for f in fields], "field string")
    return {(r["k"], r["field"]): (r["pattern_idx"], r["name"], r["start"], r["match"]) for r in scan.pattern_scan(texts, ["k"], known, table).collect()}


def test_first_pattern_at_its_true_place(spark):
    """A match starts where its pattern matched, not where its text first occurs."""
    text = "The acmtool page. Submit your paper via CMT today."
    rows = [(0, text), (1, "nothing"), (2, None), (3, "It's 'quoted' \\ back"), (4, "😀 via cmt")]
    patterns = [("f", 1, "late", r"\bpaper\b"), ("f", 0, "early", r"\bcmt\b"), ("g", 0, "quote", r"'q\w+' \\"), ("g", 1, "name's", "acmtool"), ("unknown", 0, "x", "The")]
    assert scanned(spark, rows, patterns) == {(0, "f"): (0, "early", 41, "CMT"), (0, "g"): (1, "name's", 5, "acmtool"), (3, "g"): (0, "quote", 6, "'quoted' \\"), (4, "f"): (0, "early", 7, "cmt")}
    assert scanned(spark, rows, []) == {} and scanned(spark, [], patterns) == {}


def test_scan_equals_python_for_a_large_table(spark):
    """Hundreds of patterns, some of Java's dialect alone, in any order of rows."""
    rng = random.Random(5)
    words = ["deadline", "paper", "review", "camera", "author", "notice", "track", "cmt", "page", "limit"]
    patterns = []
    for f in range(40):
        for k in range(10):
            a, b = rng.choice(words), rng.choice(words)
            patterns.append((f"f{f}", k, f"n{k}", rng.choice([rf"\b{a}\s+{b}\b", rf"(?<!no\s){a}\s*:\s*(\w+)", rf"{a}(?!\s{b})s?\s\d+", rf"(?i){a}.{{1,9}}{b}"])))
    patterns.append(("f0", 10, "java", r"\p{Lu}{3}\Q.\E"))
    rng.shuffle(patterns)
    rows = [(i, " ".join(rng.choice([*words, "No", "7", ":", "Limits", "ABC."]) for _ in range(60))) for i in range(40)]
    want = {}
    for i, text in rows:
        for field, k, name, rx in sorted(patterns, key=lambda p: (p[0], p[1])):
            m = re.search(r"[A-Za-z]{3}\." if name == "java" else rx, text, re.I | re.M)
            if m and (i, field) not in want:
                want[i, field] = (k, name, m.start() + 1, m.group(0))
    assert scanned(spark, rows, patterns, [f"f{f}" for f in range(40)]) == want and len(want) > 900


def test_own_tables_are_scanned(spark):
    texts = spark.createDataFrame([(0, "Submission deadline: May 3, 2025. Double-blind review.")], "k int, text string")
    got = {r["field"]: r["match"] for r in scan.pattern_scan(texts, ["k"], fields_table(spark), patterns_table(spark)).collect()}
    assert got["submission_deadline"] == "Submission deadline: May 3, 2025" and got["double_blind"] == "Double-blind"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99])
def test_places_of_all_matches(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice(["é", "xy", " "]) + "ab" * rng.randint(1, 3) for _ in range(n)) + rng.choice(["", "tail"])
    got = spark.createDataFrame([(text,)], "text string").select(scan.all_matches(F.col("text"), F.lit("(?:ab)+")).alias("m")).first()["m"]
    assert [(m["start"], m["match"]) for m in got] == [(m.start() + 1, m.group(0)) for m in re.finditer("(?:ab)+", text)]


def test_places_of_very_many_matches_take_seconds(spark):
    df = spark.createDataFrame([("page 7, " * 100_000,)], "text string").select(scan.all_matches(F.col("text"), F.lit(r"\d")).alias("m"))
    begin = time.time()
    got = df.select(F.size("m").alias("n"), F.element_at("m", -1)["start"].alias("last")).first()
    assert tuple(got) == (100_000, 800_000 - 2) and time.time() - begin < 40
