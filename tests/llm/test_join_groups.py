"""The n-gram join: shingles with the same members are one group, and no link is lost by it."""

import random

from folioforge.llm import ngram_join


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").split()
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_a_passage_is_one_group_and_all_links_stay(spark, monkeypatch):
    rng, rows = random.Random(11), []
    for family in range(12):
        base = [f"w{family}_{k}" for k in range(rng.randint(120, 400))]
        for copy in range(rng.randint(2, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words[: len(words) - rng.randint(0, 20)])))
    seen = []
    settle = ngram_join.settle

    def spied(df):
        out = settle(df)
        if {"token", "band", "m0"} <= set(out.columns) and "main" not in out.columns:
            seen.append(out)
        return out

    monkeypatch.setattr(ngram_join, "settle", spied)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(rows, 4, 85)
    members = {}
    for r in seen[0].collect():
        members.setdefault(r["token"], set()).add((r["id"], r["n"], r["early"]))  # a group is its members and whether each holds the shingle early
    sets = [frozenset(m) for m in members.values()]
    assert len(sets) == len(set(sets)) > 12


def test_a_pair_that_shares_many_groups_comes_out_of_one(spark, monkeypatch):
    rng, rows = random.Random(4), []
    base = [f"w{k}" for k in range(160)]
    for copy in range(60):  # near copies of one text, of which many don't link with the leaders
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**9), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, across = {}, ngram_join._across

    def run(known):
        def spied(mixed, near):
            pairs = across(mixed, near)
            ids = pairs.selectExpr("least(x.id, y.id) AS a", "greatest(x.id, y.id) AS b")
            seen[known] = ids.count(), {tuple(r) for r in ids.distinct().collect()}
            return pairs

        monkeypatch.setattr(ngram_join, "_across", spied)
        monkeypatch.setattr(ngram_join, "KNOWN", known)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, 4, 85).collect()} == brute(rows, 4, 85)

    run(ngram_join.KNOWN)
    run(0)  # as it was: a pair comes out of each of its groups
    (few, pairs), (many, same) = seen[8], seen[0]
    assert pairs == same and len(pairs) > 20
    assert few < 2 * len(pairs) < many


def test_what_may_link_meets_a_leader_and_the_rest_comes_out_once(spark, monkeypatch):
    rng, rows = random.Random(9), []
    base = [f"w{k}" for k in range(300)]
    for copy in range(120):  # near copies with up to 14 changed words, so that many members link with those near the base only, or with none
        words = list(base)
        for at in rng.sample(range(300), rng.randint(0, 14)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**9), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    across, seen = ngram_join._across, []

    def spied(mixed, near):
        pairs = across(mixed, near)
        seen.extend(tuple(r) for r in pairs.selectExpr("least(x.id, y.id) AS a", "greatest(x.id, y.id) AS b", "x.n = y.n AND NOT (x.early AND y.early) AS late").collect())
        return pairs

    monkeypatch.setattr(ngram_join, "_across", spied)
    want = brute(rows, 4, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs, 4, 85).collect()} == want
    assert not any(late for *_, late in seen)  # equal sets share their first shingle early in both
    assert len(seen) <= 2 * len({(a, b) for a, b, _ in seen})
    assert sum(want[a][1] == want[b][1] for a, b, _ in seen) < len(rows)  # what links did so with a leader
