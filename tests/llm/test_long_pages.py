"""Long pages lose what their host's short pages lose, and streams match alike whatever their length."""

import random
from difflib import SequenceMatcher

import pytest

from folioforge.llm import wrappers


def page(number, blocks):
    body = "".join(blocks)
    return (
        f"<html><body><div class='top'><a href='/'>Home</a> <a href='/x'>More</a></div><div class='content'><h1>Story {number}</h1>{body}</div>"
        f"<div class='sidebar'><p>Popular now: item {number}</p></div><div class='comments'><p>Reader {number} says no</p></div><div class='advert'><p>Buy {number} today</p></div></body></html>"
    )


def mixed(rng, number, n):
    kinds = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]
    texts = [f"block {number} {k} of words that differ {rng.randrange(10**6)}" for k in range(n)]
    return [rng.choice(kinds).format(t) for t in texts], texts


@pytest.mark.parametrize("blocks", [3_000, 30_000])
def test_long_page_gives_its_article_alone(spark, blocks):
    rng = random.Random(7)
    rows, want = [], {}
    for number in range(7):
        n = blocks if number == 6 else rng.randint(6, 12)
        html, texts = mixed(rng, number, n)
        rows.append((number, f"http://long.example.org/{number}", page(number, html)))
        want[number] = "\n".join([f"Story {number}", *texts])
    tokens, _ = wrappers.read(rows[6][2])
    assert len(wrappers.folded(tokens)[0]) > wrappers.LONGEST
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == want[0] and got[6] == want[6]


def test_blocks_of_long_streams_are_those_of_short_ones(monkeypatch):
    monkeypatch.setattr(wrappers, "AT_ONCE", 0)
    rng = random.Random(3)
    for _ in range(300):
        few = rng.choice(["ab", "abc", "abcdefgh"])
        a, b = ([rng.choice(few) for _ in range(rng.randint(0, 40))] for _ in range(2))
        plain = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        pairs = lambda blocks: [(i + k, j + k) for i, j, n in blocks for k in range(n)]
        assert pairs(wrappers.matching_blocks(a, b)) == pairs(plain)


def test_host_of_long_pages_alone_has_a_wrapper(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for number in range(6):
        html, texts = mixed(rng, number, 3_000)
        rows.append((number, f"http://all-long.example.org/{number}", page(number, html)))
        want[number] = "\n".join([f"Story {number}", *texts])
        assert len(wrappers.folded(wrappers.read(rows[-1][2])[0])[0]) > wrappers.LONGEST
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_alignment_is_that_of_compared_streams(monkeypatch):
    rng = random.Random(5)
    cases = [([rng.choice(["a", "b+", "c?", "d", "#", "e+?"]) for _ in range(rng.randint(0, 60))], [rng.choice("abcd#e") for _ in range(rng.randint(0, 60))]) for _ in range(200)]
    plain = [wrappers.aligned(a, b) for a, b in cases]
    monkeypatch.setattr(wrappers, "AT_ONCE", 0)
    assert [wrappers.aligned(a, b) for a, b in cases] == plain
