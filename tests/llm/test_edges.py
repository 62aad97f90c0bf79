"""Edge cases of the training-data operators: hot keys, full filters, empty tables, very long texts, clashing columns, against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EDGES, components_by_force, frame, kept_by_force, words

from folioforge.llm import common, decontaminate, language, neighbours, ngram_join, pieces, pii, quality, repeats, secret_scan, wrappers


@pytest.fixture
def full_filter(monkeypatch):
    """A bitmap of 64 bits: as good as every id passes, as with very many ids."""
    monkeypatch.setattr(common, "ID_BITS", 64)


def near_copies(rng, groups=8, copies=9):
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randint(40, 80)).split(" ")
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = words(rng, 1)
            texts.append((len(texts), " ".join(own)))
    return texts


def test_join_with_a_full_filter(spark, full_filter):
    texts = near_copies(random.Random(2)) + EDGES
    want, _ = components_by_force(texts, 4, 85)
    got = ngram_join.ngram_join(frame(spark, texts), 4, 85).collect()
    assert len(got) == len(texts) and all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)


def hot_texts(rng, n):
    """Texts around one passage, which is cut at many places, so that one anchor has many contexts."""
    passage = words(rng, 12)[:66].ljust(66, "z")
    flanks = ["".join(rng.choice("pqrs") for _ in range(60)) for _ in range(12)]
    texts = []
    for k in range(n):
        left, right = rng.choice(flanks), rng.choice(flanks)
        own = "".join(rng.choice("tuvw") for _ in range(20))
        texts.append((1000 + k, own + left[rng.randrange(60) :] + passage + right[: rng.randrange(60)] + own[::-1]))
    return texts


@pytest.mark.parametrize("hot", [3, 40])
def test_repeats_of_hot_anchors(spark, full_filter, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = hot_texts(random.Random(3), 400) + EDGES
    want = kept_by_force(texts)
    for r in repeats.repeats_digest(frame(spark, texts)).collect():
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_repeats_of_ten_thousand_contexts_of_one_anchor(spark):
    texts = hot_texts(random.Random(4), 10_000)
    want = kept_by_force(texts)
    got = repeats.repeats_digest(frame(spark, texts)).collect()
    assert len(got) == len(texts) and all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)


def test_repeats_of_long_texts(spark):
    rng = random.Random(5)
    long = words(rng, 60_000)  # longer than several parts
    texts = [(1, long), (2, words(rng, 30) + long[100_000:180_000] + words(rng, 30)), (3, "ab" * 40_000)]
    want = kept_by_force(texts)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in repeats.repeats_digest(frame(spark, texts)).collect())


def test_secrets_with_a_full_filter_and_many_rules(spark, full_filter):
    rules = tuple(secret_scan.Rule(f"r{k}", rx) for k, rx in enumerate([r"abc(def[0-9]+ghi)", r"(?:alpha[0-9]+|beta[0-9]+)", r"key(?:word)?[0-9]+end", r"(?:x|yy)zz[0-9]+"]))
    want = [["abc", "def"], ["alpha", "beta"], ["key"], ["xzz", "yyzz"]]
    for rule, one in zip(rules, want):
        got = secret_scan.mandatory(rule.regex)
        assert all(any(s in m for s in got) for m in ["abcdef1ghi", "alpha7", "beta12", "key5end", "keyword5end", "xzz1", "yyzz22"] if __import__("re").fullmatch(rule.regex, m)), rule
        assert got and all(len(s) >= 3 for s in got) and one
    rng = random.Random(6)
    bits = ["abcdef12ghi", "beta5", "alpha", "key9end", "keyword1end", "yyzz3", "q ", "é"]
    texts = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for k in range(60)]
    for r in secret_scan.find_secrets(frame(spark, texts), rules).select("doc_id", "text", "_spans").collect():
        import re

        plain = sorted((m.start(), k, m.end()) for k, rule in enumerate(rules) for m in re.finditer(rule.regex, r["text"]))
        assert [tuple(s) for s in r["_spans"]] == plain
    assert secret_scan.secrets_digest(frame(spark, [])).collect() == []


def test_language_letters_and_empty_tables(spark):
    assert not any(language._LETTER.search(t) for t in ("½ ² ①", "12 !", "")) and language._LETTER.search("ª é")
    assert language.language_scores(frame(spark, [])).collect() == []


def test_pieces_of_a_long_text_without_spaces(spark):
    texts = [(1, "lorem" * 60_000), (2, "日本語" * 20_000), (3, "a b " * 50_000)]
    got = pieces.piece_counts(frame(spark, texts)).collect()
    assert all(r["round_trip"] for r in got) and len(got) == 3
    assert pieces.piece_counts(frame(spark, [])).collect() == []


def test_pii_and_quality_and_leaks_of_empty_tables(spark):
    assert pii.pii_digest(frame(spark, [])).collect() == [] and pii.redact(frame(spark, [])).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(frame(spark, []), labels).collect() == []
    items = spark.createDataFrame([(1, words(random.Random(1), 20))], "item_id long, text string")
    assert decontaminate.find_leaks(frame(spark, []), items).collect() == []
    assert decontaminate.find_leaks(frame(spark, EDGES), items.limit(0)).collect() == []
    assert decontaminate.without_leaks(frame(spark, EDGES), items.limit(0)).count() == len(EDGES)


def test_neighbours_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 12))
    x[100:300] = x[100]  # a group of copies
    data = spark.createDataFrame([(k, v.tolist(), "q", 1.0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, h string, score double")
    one = neighbours.nearest(data, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    several = neighbours.nearest(data, F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert one.equals(several) and len(one) == 50
    assert one[one.query_id == 100].vec_id.tolist() == [101, 102, 103, 104, 105]


def test_pii_by_the_words_on_both_sides(spark):
    """Planted identifiers between two words that mark them only together: all are found, and nothing else is."""
    rng = random.Random(12)
    texts = [f"{words(rng, 4)} the 10.{k}.7.{k} badge {words(rng, 4)}" for k in range(30)]
    texts += [f"{words(rng, 4)} the QX-{k}77{k} badge {words(rng, 4)}" for k in range(12)]
    texts += [f"{words(rng, 4)} the {w} {words(rng, 1)} of the {w} {words(rng, 4)}" for w in words(rng, 80).split()] + [f"the 55{k}21 dog ran" for k in range(9)]
    for r in pii.pii_digest(frame(spark, list(enumerate(texts)))).collect():
        planted = 30 <= r["doc_id"] < 42
        at = texts[r["doc_id"]].find("QX-")
        assert (r["spans"].split(",")[-1].startswith(f"id:{at}:") if planted else "id:" not in r["spans"]), (texts[r["doc_id"]], r["spans"])


def test_recall_of_tables_is_a_parameter():
    assert decontaminate.tables(0.98, 0.25) == 16 and decontaminate.tables(0.9, 0.25) < 16 < decontaminate.tables(0.999, 0.25)


# Pages.


def page(k, body):
    return f"<html><head><title>t{k}</title></head><body><nav><ul><li><a href='/'>Home {k}</a></li></ul></nav>{body}<footer>foot {k}</footer></body></html>"


def text_of(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def pages_of_hosts(rng):
    """Pages of three layouts with the text that they should give."""
    rows, want = [], {}
    for k in range(60):
        parts = [words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))]
        head = words(rng, 4)
        if k % 3 == 0:
            body = f"<div class='ad'>{words(rng, 5)}</div><article><h2 id='related-work'>{head}</h2>" + "".join(f"<p id='search'>{p}</p>" for p in parts) + "</article><div id='comments'><p>" + words(rng, 40) + "</p></div>"
        elif k % 3 == 1:
            body = "<div class='bar'><a href='/a'>menu one</a></div><div class='menu'>" + "".join(f"<a href='/{w}'>{w}</a> " for w in words(rng, 6).split()) + f"</div><div class='post-{k}'><h1>{head}</h1>" + "".join(f"<p>{p}" for p in parts) + "</div>"
        else:
            body = f"<div class='note'>Same on every page</div><table><tr><td><h3>{head}</h3>" + "".join(f"<div>{p}</div>" for p in parts) + "</td></tr></table>"
        rows.append((k, f"http://h{k % 3}.org/{k}", page(k, body)))
        want[k] = "\n".join([head, *parts])
    return rows, want


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_layouts_through_their_wrappers(spark, monkeypatch, most):
    monkeypatch.setattr(wrappers, "MOST_BYTES", most)
    rows, want = pages_of_hosts(random.Random(8))
    assert text_of(spark, rows + rows[:1]) == want


def test_many_streams_of_one_host(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "STREAMS", 3)
    rng = random.Random(9)
    rows, want = [], {}
    for k in range(40):
        shape = [rng.choice(["p", "h2", "ul", "pre"]) for _ in range(rng.randint(1, 6))]
        texts = [words(rng, 8) for _ in shape]
        body = "".join(f"<ul><li>{t}</li></ul>" if s == "ul" else f"<{s}>{t}</{s}>" for s, t in zip(shape, texts))
        rows.append((k, "http://one.org", page(k, f"<main>{body}</main><aside>{words(rng, 9)}</aside>")))
        want[k] = "\n".join(texts)
    assert text_of(spark, rows) == want


def test_alignment_takes_both_streams():
    """By force: each stream must be one of the words of the wrapper's regular expression, token by token."""
    import re

    rng = random.Random(10)
    for _ in range(200):
        streams = [[rng.choice("abcd") for _ in range(rng.randint(1, 7))] for _ in range(2)]
        wrapper = wrappers.aligned(*streams)
        assert all(re.fullmatch(r"[abcd]\+?\??", t) for t in wrapper)
        rx = "".join(f"(?:{t[0]}{'+' if '+' in t else ''}){'?' if '?' in t else ''}" for t in wrapper)
        for s in streams:
            assert re.fullmatch(rx, "".join(s)), (streams, wrapper)


def test_reader_is_linear_and_takes_broken_pages(spark):
    begin = time.time()
    for bad in ("<b>x" * 250_000, "<div>x" * 160_000, "<div><p>x</div></p>" * 50_000, "<a \"'>x" * 100_000, "<p class='x" * 90_000, "<!-- x" * 100_000):
        tokens, slots = wrappers.read(bad)
        wrappers.folded(tokens)
    assert time.time() - begin < 60
    rows = [(1, None, None), (2, "x", ""), (3, "http://a", "<div>open <p>text &amp; more<p>last"), (4, "http://a", "plain &lt;text&gt;"), (5, "http://b", "<div>x" * 30_000)]
    got = text_of(spark, rows)
    assert got[1] == got[2] == "" and got[3] == "open\ntext & more\nlast" and got[4] == "plain <text>" and got[5].count("x") == 30_000
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
