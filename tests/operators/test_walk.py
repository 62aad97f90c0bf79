"""The best-first walk against a heap."""

import heapq
import random

from folioforge.operators.walk import feed_seeds, walk


def by_heap(site, home, seeds, links, stored, depth, most, rank):
    """The order in which a heap of (priority, number) reads pages."""
    heap, n, done, out = [], 0, set(), []

    def push(priority, url, d):
        nonlocal n
        heapq.heappush(heap, (priority, n, url, d))
        n += 1

    push(0, home, 0)
    for s in sorted(seeds):
        if s != home:
            push(5, s, 0)
    while heap and len(out) < most:
        priority, _, url, d = heapq.heappop(heap)
        if url in done:
            continue
        done.add(url)
        if url not in stored:
            continue
        out.append((site, url, d, priority, len(out) + 1))
        for dst, anchor in links.get(url, ()) if d < depth else ():
            priority, near = rank(dst, anchor)
            if dst not in done and (d == 0 or near):
                push(priority, dst, d + 1)
    return out


def test_walk_equals_a_heap(spark):
    rng = random.Random(3)
    homes, seeds, links, stored, want = [], [], [], set(), []
    for s in range(14):
        host = f"s{s}.example.org"
        names = [f"http://{host}/2025/{'cfp' if k % 5 == 0 else 'x'}/{k}" if k % 3 else f"http://{host}/{'submission' if k % 4 == 0 else 'y'}/{k}" for k in range(40)]
        home, own = f"http://{host}/2025/", {}
        stored |= {home, *(u for u in names if rng.random() < 0.85)}
        for u in [home, *names]:
            own[u] = [(rng.choice(names), rng.choice(["Call for Papers", "Submission", "news", "more", ""])) for _ in range(rng.choice([0, 1, 3, 6]) if s else 25)]
            links += [(u, dst, anchor, k) for k, (dst, anchor) in enumerate(own[u])]
        links.append((home, "http://elsewhere.org/cfp", "Call for Papers", 99))
        sown = rng.sample(names, 3) + [home] if s % 2 else []
        homes.append((host, home))
        seeds += [(host, u) for u in sown]
        want.append((host, home, sown, own))

    from pyspark.sql import functions as F

    from folioforge.operators.pages import link_priority, link_related

    kinds = spark.createDataFrame([(dst, anchor) for _, dst, anchor, _ in links], "dst string, anchor string").distinct()
    ranks = {(r["dst"], r["anchor"]): (r["p"], r["rel"]) for r in kinds.select("dst", "anchor", link_priority(F.col("dst"), F.col("anchor")).alias("p"), link_related(F.col("dst"), F.col("anchor")).alias("rel")).collect()}
    rank = lambda dst, anchor: (ranks[dst, anchor][0], ranks[dst, anchor][1] or dst.split("/", 3)[3].startswith("2025"))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = frame(homes, "site string, url string"), frame(links, "src string, dst string, anchor string, place int")
    for most, depth in ((15, 3), (4, 1)):
        expected = [r for site, home, sown, own in want for r in by_heap(site, home, sown, own, stored, depth, most, rank)]
        got = walk(*tables, depth=depth, most=most, seeds=frame(seeds, "site string, url string"), stored=frame([(u,) for u in stored], "url string"))
        assert sorted(map(tuple, got.collect())) == sorted(expected)
        assert len({r[3] for r in expected}) == 5 or depth == 1  # all priorities occur


def test_feed_seeds_join_known_sites(spark):
    homes = spark.createDataFrame([("a", "http://a/"), ("b", "http://b/")], "site string, url string")
    feed = spark.createDataFrame([("a", " http://a/x "), ("a", "http://a/x"), ("a", "http://a/"), ("b", "  "), ("b", None), ("c", "http://c/")], "site string, link string")
    assert [tuple(r) for r in feed_seeds(homes, feed).collect()] == [("a", "http://a/x")]


def test_walk_of_nothing(spark):
    homes = spark.createDataFrame([], "site string, url string")
    links = spark.createDataFrame([], "src string, dst string, anchor string, place int")
    assert walk(homes, links).count() == 0
    lone = spark.createDataFrame([("a", "http://a/")], "site string, url string")
    assert [tuple(r) for r in walk(lone, links).collect()] == [("a", "http://a/", 0, 0, 1)]
