"""Hard negatives, the prefix trie and exact copies against brute force, with their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import exact_copies, hard_negatives, prefix_trie

# --- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, score double, rank int, key string"


def negatives_by_force(rows):
    usable = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, label if i % 7 else (label + 1) % 10, [math.floor(256 * x) for x in v]))
    score = lambda a, c: sum(x * y for x, y in zip(a, c))
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in usable if i % 100 == 0}:
        others = [(max(-(1 << 63), min((1 << 63) - 1, score(v, w))), j, m) for j, m, w in usable if j != i]
        for s, j in sorted(((s, j) for s, j, m in others if m == label), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted(((t, k) for t, k, m in others if m != label and 30 * s <= 100 * t <= 90 * s), key=lambda x: (-x[0], x[1]))[:10]
            out += [(i, j, r + 1, k, s, t) for r, (t, k) in enumerate(fit)]
    return Counter(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 0.5, 3, "x") for r in rows], VECTORS)
    return Counter(tuple(r) for r in hard_negatives.mined(df).collect())


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    base = [[rng.uniform(-0.5, 0.5) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(420):
        v = [x + rng.uniform(-0.2, 0.2) for x in rng.choice(base)] if i % 3 else list(base[0])  # a third are one vector, so scores tie
        rows.append((i, v, 0 if i % 3 == 0 else rng.randrange(10)))
    odd = [(1000, None, 1), (1001, [0.1, None], 1), (1002, [float("nan")] * 6, 2), (1003, [float("inf"), 0.0], 2), (1004, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    return rows + odd + [rows[100], rows[5], rows[5], (1100, [], 3), (1101, [0.3] * 3, 3), (1102, [0.2] * 8, 0), (1200, [0.4] * 8, 0)]


@pytest.mark.parametrize(("block", "anchors", "least"), [(4096, 4096, 1024), (7, 2, 16)])
def test_negatives_equal_brute_force(spark, vectors, monkeypatch, block, anchors, least):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "LEAST", least)
    got = mined(spark, vectors)
    assert got == negatives_by_force([(i, v, x) for i, v, x in vectors]) and len(got) > 100


def test_negatives_of_wide_values(spark):
    rng = random.Random(9)
    rows = [(i * 10, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 9, 16, 19]) for _ in range(4)], rng.randrange(3)) for i in range(60)]
    assert mined(spark, rows) == negatives_by_force(rows)


def test_negatives_of_nothing(spark):
    assert not mined(spark, []) and not mined(spark, [(1, [0.5], 1)]) and not mined(spark, [(100, [0.5], 1)])


@pytest.mark.parametrize("most", [10, 2_000, 10**6, 10**11, 10**25])
def test_packed_scores_are_exact_for_fields_of_any_width(most):
    rng = random.Random(most)
    draw = lambda n, d: np.array([[rng.randint(-most, most // 2) for _ in range(d)] for _ in range(n)], np.int64 if most < 2**62 else object)
    c, a = draw(33, 5), draw(4, 5)
    bias = -int(a.min())
    packed = hard_negatives.Packed(c, int(a.max()) + bias)
    for row in a:
        exact = [sum(int(x) * int(y) for x, y in zip(row, other)) for other in c]
        assert packed.scores([int(x) + bias for x in row], bias).tolist() == [max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact]


# --- the trie

TURNS = "conv_id long, turn long, role string, text string, node string, depth long"


def trie_by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            t = ((role or ""), (text or ""))
            sha = hashlib.sha256(f"{len(t[0].encode())}:{t[0]}{t[1]}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, t[0], sha), t))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in own.items():
        h, first = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        whole[c] = own.get(first, [])[:h] + x[h:]
    nodes = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    out = []
    kids = Counter(k[:-1] for k in nodes if k)
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(k))))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], sum(x not in kids for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def tried(spark, rows):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], TURNS)
    return Counter(tuple(r) for r in prefix_trie.conversation_trie(df).collect())


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(6)
    rows = []
    for c in [*range(40), *range(100, 130), 205, 207, -3, 10**15]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "É😀"])) for t in range(rng.randint(1, 6))]
    for c in range(300, 340):  # copies, one deeper
        rows += [(c, t, "user", f"same {t}") for t in range(9 + (c == 333))]
    rows += [(400, t, "user", f"long {t}") for t in range(60)] + [(402, t, "user", f"long {t}" if t < 40 else "other") for t in range(50)]
    odd = [(500, None, None, None), (500, 1, "user", None), (500, 1, None, "x"), (500, 1, None, "x"), (500, 1, "user", "w" * 100_000), (None, 1, "user", "lost"), (599, 7, "user", "alone")]
    rows += odd
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [1 << 18, 150, 1])
def test_trie_equals_brute_force(spark, turns, monkeypatch, group):
    """Bands peeled in tasks and levels peeled by aggregation give the same nodes."""
    few = [r for r in turns if r[0] not in (400, 402)] if group == 1 else turns
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    assert tried(spark, few) == trie_by_force(few)


def test_trie_of_nothing(spark):
    assert not tried(spark, []) and not tried(spark, [(None, 1, "user", "x")])
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert list(tried(spark, [(lone, 0, "user", "gone")])) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]  # turnless: the root alone


def test_peel_is_bounded_by_its_prefix():
    path = lambda *x: b"".join(bytes([k]) * 16 for k in x)
    rows = [(path(1, 2, 3), [5, 5, 5], 2, 4, 0, 0, False), (path(1, 2, 4), [5, 5, 7], 1, 3, 0, 0, False), (path(1), [5], 1, 9, 0, 0, False)]
    got = list(prefix_trie.peel(rows, 0))
    assert [(x[2], x[3], x[4], x[5], x[6], x[7]) for x in got] == [(3, 4, 2, 0, 1, 5), (3, 3, 1, 0, 1, 0), (2, 3, 3, 2, 2, 15), (1, 3, 4, 1, 2, 30)]


# --- exact copies

DOCS = "doc_id long, text string, sha string, row long, salt int, whole string, again boolean"


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def copies_by_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            out[(i, ids[-1], len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = [(i, f"text {rng.randrange(300)} ÄÉ" if i % 3 else "THE same") for i in range(600)]
    odd = [(700, None), (701, ""), (None, None), (None, "lone"), (None, "lone"), (702, "É"), (703, "é"), (704, "İI"), (705, "i̇i"), (706, "İi"), (707, "Z" * 300_000), (708, "z" * 300_000), (709, " "), (710, "a\x00B")]
    return rows + odd + [rows[3], rows[3], rows[5], (700, None)]


@pytest.mark.parametrize(("least", "most"), [(1 << 18, 1 << 28), (1 << 15, 1 << 15)])
def test_copies_equal_brute_force(spark, texts, monkeypatch, least, most):
    monkeypatch.setattr(exact_copies, "LEAST_BITS", least)
    monkeypatch.setattr(exact_copies, "MOST_BITS", most)
    docs = spark.createDataFrame([(*r, "s", 1, 2, "w", False) for r in texts], DOCS)
    want = copies_by_force(texts)
    assert Counter(tuple(r) for r in exact_copies.find_copies(docs).collect()) == want
    stay = exact_copies.without_copies(docs)
    assert stay.columns == docs.columns
    names = {hashlib.sha256(norm(t).encode()).hexdigest(): norm(t) for _, t in texts}
    assert Counter((r.doc_id, norm(r.text)) for r in stay.collect()) == Counter((w[0], names[w[4]]) for w in want if w[3])


def test_copies_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_copies.find_copies(docs).count() == 0 and exact_copies.without_copies(docs).count() == 0


def test_full_filter_lets_all_rows_through_and_a_sparse_one_few(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2950).alias("text"))
    hashes = docs.select(exact_copies.text_hash(F.col("text")).alias("sha"))

    def through(bits):
        return exact_copies._probed(hashes, exact_copies.repeated_bits(hashes, bits), bits).where("again").count()

    assert 100 <= through(exact_copies.bits_for(3000)) < 200 and through(1 << 15) >= 100
    wide = spark.range(60_000).select(exact_copies.text_hash(F.col("id").cast("string")).alias("sha"))
    assert exact_copies._probed(wide, exact_copies.repeated_bits(wide, 1 << 15), 1 << 15).where("again").count() > 40_000


def test_copies_run_without_python_workers(spark):
    plan = exact_copies.find_copies(spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
