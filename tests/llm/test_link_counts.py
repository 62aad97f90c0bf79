"""Each document's number of links, also of those inside a component that no leader meets, against all pairs."""

import random

import numpy as np
import pytest

from folioforge.llm import ngram_join


def brute(rows, size, percent):
    """For each row the other rows with an id whose sets link with its own."""
    sets = []
    for i, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    linked = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    return sorted((str(i), len(sets[a]), sum(bool(linked(a, b)) for b in range(len(rows)) if b != a and rows[b][0] is not None) if i is not None else 0) for a, (i, _) in enumerate(rows))


def near_copies(rng, family, n, length, most):
    base = [f"w{family}_{k}" for k in range(length)]
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(length), rng.randint(0, most)):
            words[at] = f"x{rng.randrange(10**6)}"
        yield " ".join(words[: length - rng.randint(0, 6)])


def counted(spark, rows):
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    return sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in got)


@pytest.mark.parametrize("members", [512, 6])
def test_all_links_of_a_component_count(spark, monkeypatch, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)  # with 6, pairs meet across blocks
    rng = random.Random(members)
    texts = [t for family, n, length, most in ((0, 40, 220, 7), (1, 12, 90, 3), (2, 3, 150, 4), (3, 2, 60, 1)) for t in near_copies(rng, family, n, length, most)]
    texts += rng.sample(texts, 15) + ["", None, "one two", "One  TWO", "alone among all of these"]
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts)) + [(None, texts[0])]
    want = brute(rows, 4, 85)
    assert counted(spark, rows) == want
    assert max(n for *_, n in want) > 10 and sum(n for *_, n in want) > 500


def test_links_of_repeated_ids_and_long_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHINGLES", 900)
    rng = random.Random(8)
    one, two = (list(near_copies(rng, family, 9, 260, 5)) for family in (0, 1))
    rows = [*zip([7, 7, 3, 4, 4, 9, 10, 11, 12], one), *zip([7, 1, 3, 2, 2, 5, 6, 6, 8], two), (7, one[0]), (7, one[0]), (30, "a b c d e f"), (30, "a b c d e f"), (31, None)]
    # one id whose two texts link with each other only
    rows += [(40, " ".join(f"k{i}" for i in range(200))), (40, " ".join(f"k{i}" for i in range(199)))]
    assert counted(spark, rows) == brute(rows, 4, 85)


def test_sizes_of_intersections(monkeypatch):
    monkeypatch.setattr(ngram_join, "WIDTH", 16)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-60, 60, n)) for n in (50, 90, 1, 33, 70)]
    more = [np.unique(rng.integers(-90, 10, n)) for n in (5, 80)]
    size = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    assert ngram_join._shared(sets, more).tolist() == [[size(a, b) for b in more] for a in sets]
    own = ngram_join._shared(sets)
    assert all(own[i, j] == size(sets[i], sets[j]) for i in range(5) for j in range(5) if i != j)
    assert ngram_join._shared(sets[:1], [np.array([99])]).tolist() == [[0]]


def test_components_alone_are_the_same(spark):
    rng = random.Random(2)
    rows = list(enumerate(near_copies(rng, 0, 30, 120, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = ngram_join.ngram_join(docs, 4, 85).drop("n_links")
    alone = ngram_join.ngram_components(docs, 4, 85)
    assert alone.columns == ["doc_id", "n_shingles", "component_id"] and sorted(map(tuple, alone.collect())) == sorted(map(tuple, whole.collect()))
