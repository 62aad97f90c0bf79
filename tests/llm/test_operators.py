"""The training-data operators against brute force, exact round trips and held-out rows, on small fixtures."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, language, neighbours, ngram_join, pieces, pii, quality, repeats, secret_scan, wrappers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double"


def frame(spark, texts, lang=None):
    """Documents with columns whose names clash with those that operators use inside."""
    rows = [(i, t, lang[k] if lang else "en", "s", 0, 7, 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


EDGES = [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (103, "one"), (None, "a text without an id of some words"), (104, "É é 😀 \x00 x")]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 90)) for _ in range(12)]
    texts = list(enumerate(base))
    for k in range(60):  # near copies of each other, chains of them, exact copies
        own = rng.choice(texts)[1].split(" ")
        for _ in range(rng.choice([0, 1, 2, 4])):
            own[rng.randrange(len(own))] = words(rng, 1)
        texts.append((len(texts), " ".join(own)))
    passage = words(rng, 60)
    return texts + [(80 + k, words(rng, 20) + " " + passage + " " + words(rng, 20)) for k in range(6)] + [(95, "x" * 400 + "y" * 400 + "x" * 300), (96, passage * 30)]


def components_by_force(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((find(a), find(b)))
                        root[q] = p
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join_against_all_pairs(spark, copies, size, percent):
    texts = copies + EDGES
    want, sets = components_by_force(texts, size, percent)
    got = ngram_join.ngram_join(frame(spark, texts), size, percent).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_join(frame(spark, [])).collect() == []


def test_fine_maps_bound_the_difference():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    b = np.concatenate([a[200:], rng.integers(0, 2**63, 1500).astype(np.uint64)])
    assert ngram_join._apart(ngram_join._fine(a), ngram_join._fine(b)) <= len(set(a.tolist()) ^ set(b.tolist()))
    assert ngram_join._apart(ngram_join._fine(a), ngram_join._fine(a)) == 0


def kept_by_force(texts):
    seen, out = set(), {}
    for i, t in sorted(((i, t or "") for i, t in texts if i is not None), key=lambda r: r[0]):
        raw = t.encode()
        if i in out:
            continue
        hit = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                hit[p] += 1
                hit[p + 100] -= 1
            seen.add(raw[p : p + 100])
        gone = np.cumsum(hit[:-1]) > 0
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        out[i] = len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()
    return out


def test_repeats_against_all_windows(spark, copies):
    texts = copies + EDGES
    want = kept_by_force(texts)
    got = repeats.repeats_digest(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert repeats.repeats_digest(frame(spark, [])).collect() == []


def test_run_length_index_steps():
    """LF steps over runs walk each context backwards from its closing sign."""
    contexts = [b"abracadabra" * 12, b"abracadabra" * 12 + b"x", b"banana" * 20]
    sizes = np.array([len(c) for c in contexts])
    index = repeats.RunLengthIndex(contexts, np.array([0, 1 << 34, 2 << 34]))
    assert len(index.run_row) < index.rows / 4
    marks = {(taken, int(w)): (bool(h), int(e)) for taken, who, held, early in index.stream(sizes) for w, h, e in zip(who, held, early)}
    joined = [c for c in contexts]
    for (taken, w), (held, early) in marks.items():
        window = joined[w][len(joined[w]) - taken :][:100]
        places = [(k << 34) + p for k, c in enumerate(joined) for p in range(len(c) - 99) if c[p : p + 100] == window]
        assert held == (len(places) > 1)
        if held:
            assert early == min(places)


def test_leaks_edits_and_edges(spark):
    rng = random.Random(3)
    items = [(k, words(rng, rng.randint(12, 40))) for k in range(20)] + [(50, None), (51, ""), (52, "tiny item")]
    docs, want = [], set()
    for k in range(60):
        own = words(rng, rng.randint(5, 200)).split(" ")
        if k % 3:
            item, text = items[k % 20]
            cut = text.split(" ")
            edits = rng.randint(0, int(0.25 * len(cut)))
            for _ in range(edits):
                at, kind = rng.randrange(len(cut)), rng.random()
                cut[at : at + 1] = [] if kind < 0.3 else [words(rng, 1)] if kind < 0.7 else [cut[at], words(rng, 1)]
            at = rng.randrange(len(own))
            own[at:at] = [w.upper() + "," for w in cut]
            want.add((k, item))
        docs.append((k, " ".join(own)))
    found = decontaminate.find_leaks(frame(spark, docs + EDGES), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert want <= got

    def distance(item, doc):  # whole item against any run of the document
        cost = [0] * (len(doc) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(doc, 1):
                new.append(min(cost[j] + 1, new[j - 1] + 1, cost[j - 1] + (x != y)))
            cost = new
        return min(cost)

    texts, names = dict(docs), dict(items)
    for r in found:
        own = [w.strip(",").lower() for w in texts[r["doc_id"]].split()]
        assert r["distance"] == distance(names[r["item_id"]].split(), own) <= 0.25 * len(names[r["item_id"]].split())
        assert 0 <= r["begin_word"] <= r["end_word"] <= len(own)
    left = decontaminate.without_leaks(frame(spark, docs + EDGES), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs + EDGES} - {d for d, _ in got}


def test_pii_base_and_contexts(spark):
    rng = random.Random(9)
    texts = []
    for k in range(40):
        lead = words(rng, 10)
        value = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}" if k % 2 else f"10.{k}.3.4"
        texts.append((k, f"{lead} customer-ref: {value} {words(rng, 4)}"))
    texts.append((60, "some words customer-ref: AB-99812-X, and more"))
    texts.append((61, "other AB-99812-X elsewhere; code 12345 here"))
    got = {r["doc_id"]: r for r in pii.pii_digest(frame(spark, texts + EDGES)).collect()}
    assert got[60]["spans"] == "id:25:35" and got[61]["spans"] == "id:6:16"
    assert got[0]["n_ip"] == 1 and got[1]["n_phone"] == 1
    assert got[100]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts + EDGES)).collect()}
    assert "[ID]" in clean[60] and "[ID]" in clean[61] and "12345" in clean[61] and clean[100] is None


def test_pii_contexts_of_discovered_values_alone(spark):
    rng = random.Random(19)
    codes = [[f"{step}-{k}8{k}71" for k in range(5)] for step in ("AB", "CD", "EF", "GH", "IJ")]
    leads = ["customer-ref:", "ticket=", "booking/", "parcel#", "voucher@"]
    texts = [f"{words(rng, 5)} {leads[0]} 10.{k}.3.4 {words(rng, 3)}" for k in range(30)]
    for step, (own, lead) in enumerate(zip(codes, leads)):  # each context holds the values of the one before, often, and new ones
        texts += [f"{words(rng, 5)} {lead} {v} {words(rng, 3)}" for v in own + (codes[step - 1] * 10 if step else [])]
    texts += [f"{words(rng, 3)} room {n} {words(rng, 3)}" for n in range(12000, 12040)] + [f"room {codes[4][0]}"]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        at = [t.index(v) for own in codes for v in own if v in t.split()]
        assert got[i].split(",") == [f"id:{a}:{a + 8}" for a in at] if at else "id:" not in got[i], (t, got[i])


def test_pii_base_rules_against_plain_regex():
    import re

    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "x.y@z-1.co.uk@q.r", "1.2.3.4", "300.1.1.1", "4539 1488 0343 6467", "4539148803436468", "+1 (555) 010-9999", "+12", " ", "word", "é", "4", "-", "00001.2.3.4.5"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        want = []
        for kind, rx in enumerate(plain):
            for m in re.finditer(rx, text):
                digits = [c for c in m.group() if c.isdigit()]
                ok = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and pii.luhn("".join(digits)) if kind == 2 else True, 9 <= len(digits) <= 15][kind]
                if ok:
                    want.append((kind, *m.span()))
        assert pii.base_spans(text) == want, text


def test_pieces_round_trip_and_best_path():
    raw = open(pieces.MODEL, "rb").read()
    p = pieces.Pieces(raw)
    encoder = pieces.Encoder(p)
    texts = ["a  b", " lead", "emoji 😀 ünï\n\ttab", "", "日本語 テキスト", "\x00a", "    ", "wordword<s></s>", "x" * 500, None]
    ids, counts = encoder.encode(texts)
    raw_bytes, sizes = p.decode(ids, counts)
    ends = np.cumsum(sizes)
    assert [bytes(raw_bytes[e - n : e]).decode() for e, n in zip(ends, sizes)] == [t or "" for t in texts]
    scores = {piece: float(s) for piece, s, k in zip(p.pieces, p.scores, pieces.read_model(raw)[2]) if k in (1, 4)}
    rng = random.Random(2)
    for _ in range(200):
        word = pieces.MARK + "".join(rng.choice("the aeinostré") for _ in range(rng.randint(1, 9))).replace(" ", "").encode()
        best = {0: 0.0}
        text = word.decode()
        for end in range(1, len(text) + 1):
            options = [best[s] + scores[text[s:end].encode()] for s in range(end) if text[s:end].encode() in scores]
            options += [best[end - 1] + p.least] if text[end - 1].encode() not in scores else []
            best[end] = max(options)
        own, _ = p.segment([word])
        got = sum(scores.get(p.pieces[i], 0.0) for i in own.tolist() if not p.pieces[i].startswith(b"<0x"))
        assert got == pytest.approx(best[len(text)]), word


def test_pieces_frame(spark):
    got = pieces.piece_counts(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r["round_trip"] for r in got)
    assert {r["doc_id"]: r["n_pieces"] for r in got}[100] is None


def test_language_code_lengths_and_frame(spark):
    counts = pd.DataFrame(
        [(lang, int(g), int(c)) for lang, text in (("a", b"abababac"), ("b", b"zzzzxzzy")) for g, c in zip(*np.unique(language.grams([text], 3)[0].view(np.int64), return_counts=True))], columns=["lang", "gram", "c"]
    )
    trees = language.Trees(counts)

    def bits(train, text):  # PPM, escape C, no exclusions, by dictionaries
        tables = {}
        padded = b"\0\0\0" + train
        for i in range(3, len(padded)):
            for k in range(4):
                row = tables.setdefault(padded[i - k : i], {})
                row[padded[i]] = row.get(padded[i], 0) + 1
        total, padded = 0.0, b"\0\0\0" + text
        for i in range(3, len(padded)):
            for k in (3, 2, 1, 0):
                row = tables.get(padded[i - k : i], {})
                if not row:
                    continue
                n, d = sum(row.values()), len(row)
                if padded[i] in row:
                    total += np.log2((n + d) / row[padded[i]])
                    break
                total += np.log2((n + d) / d)
            else:
                total += 8
        return total

    for text in (b"abac", b"zzxy", b"qabz", b""):
        got = trees.totals([b"zz", text, b"ab"])[1]
        assert got == pytest.approx([bits(b"abababac", text), bits(b"zzzzxzzy", text)])
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["der und die nicht", "the of and not"][k % 2].split()) for _ in range(30))) for k in range(80)]
    langs = [["de", "en"][k % 2] for k in range(80)] + [None] * len(EDGES)
    got = {r["doc_id"]: r for r in language.language_scores(frame(spark, texts + EDGES, langs)).collect()}
    assert all(got[k]["lang_pred"] == langs[k] for k in range(80)) and got[100]["lang_pred"] == got[102]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.language_scores(frame(spark, EDGES[:3])).where("lang_pred <> 'und'").count() == 0


def test_secrets_against_plain_regex(spark):
    import re

    rng = random.Random(6)
    bits = ["password: ", "TOKEN = \"", "abc", "secret=", "api_key='", "Abcdef123", "AKIA", "AKIA" + "X9" * 10, "0123456789abcdef" * 2, " ", "é", "token=token: abcdefgh", "\n", '"']
    texts = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(90)] + [(900, "password=abcdefg " * 3000)]
    got = {r["doc_id"]: r for r in secret_scan.secrets_digest(frame(spark, texts + EDGES)).collect()}
    plain = [(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    for i, text in texts:
        spans = sorted((m.start(), k, m.end()) for k, (rx, g, least) in enumerate(plain) for m in re.finditer(rx, text) if len(m.group(g)) >= least)
        listed = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
    assert secret_scan.mandatory(secret_scan.RULES[0].regex) == ["api_key", "apikey", "passwd", "password", "secret", "token"]
    assert secret_scan.mandatory("[0-9a-f]+") is None


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[300]  # a third are one vector
    rows = [(int(k), [float(v) for v in x[k]]) for k in range(900)] + [(901, None), (950, [0.0] * 16), (1000, [float("nan")] * 16), (1050, [1.0]), (None, [1.0] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert own.score.tolist() == pytest.approx(s[own.vec_id].tolist())
        hit += len(set(best) & set(own.vec_id))
    assert hit >= 0.97 * 18 * 5 and set(got.query_id) == set(range(0, 900, 50))
    assert neighbours.nearest(spark.createDataFrame(rows[900:903], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_repeated_queries(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    rows = [(k, x[k].tolist()) for k in range(60)] + [(50, x[50].tolist())] * 4 + [(0, x[7].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    every = np.vstack([u, [u[50]] * 4, u[7:8]])
    names = np.array([r[0] for r in rows])
    for q, y, times in ((50, u[50], 5), (0, u[0], 1), (0, u[7], 1)):
        s = np.where(names == q, -9, every @ y)
        best = names[np.lexsort((names, -np.round(s, 12)))[:5]]
        own = [g.sort_values("rank")["vec_id"].tolist() for _, g in got[got.query_id == q].groupby(got.groupby(["query_id", "rank", "vec_id"]).cumcount())] if q else None
        assert own is None or (own == [best.tolist()] * times)
        assert set(best) <= set(got[got.query_id == q]["vec_id"])
    assert len(got) == 5 * 5 + 2 * 5 and sorted(got[got.query_id == 0]["rank"]) == sorted([1, 2, 3, 4, 5] * 2)


def test_quality_takes_one_row_of_each_labelled_id(spark, monkeypatch):
    rng = random.Random(17)
    texts = [(k, words(rng, 30) if k % 2 else "###! " * 20) for k in range(20)] + [(3, words(rng, 30)) for _ in range(500)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    seen, fit = [], quality.fit_pairs
    monkeypatch.setattr(quality, "fit_pairs", lambda x, label: seen.append((x, label)) or fit(x, label))
    quality.train_ranker(frame(spark, texts), labels, F.lit(True))
    x, label = seen[0]
    assert len(x) == 20 and label.tolist() == [k % 2 for k in range(20)]
    assert x[3] == pytest.approx(np.mean([quality.features(t.encode()) for i, t in texts if i == 3], axis=0))
    assert x[4] == pytest.approx(quality.features(texts[4][1].encode()))


def test_quality_ranks_held_out(spark):
    rng = random.Random(7)
    texts = [(k, words(rng, 60) if k % 4 else "###! " * 30 + words(rng, 20)) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(200)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(frame(spark, texts + EDGES), labels).toPandas()
    assert len(got) == len(texts) + len(EDGES) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 100)]
    assert (held.predicted == (held.doc_id % 4 > 0)).mean() > 0.9
    assert quality.quality_scores(frame(spark, texts), labels.limit(0)).where("predicted = 0").count() == 0


def test_wrappers_main_text(spark):
    def page(k, body):
        return f"<html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body><header>Site</header><nav><a href='/'>Home</a></nav><!-- x -->{body}<div class='comments'><p>reader {k}</p></div><footer>&copy; all</footer>"

    rows = [(k, f"http://a.org/{k}", page(k, f"<article><h1>Head {k}</h1><p>One &amp;  <b>two</b>\n three<p>Four<br>five</article><aside>side</aside>")) for k in range(6)]
    rows += [(10 + k, f"http://b.org/{k}", page(k, f"<div class='box'><p>Same</p></div><div class='text'><p>Own {k}</p><ul><li>a{k}<li>b</ul></div>")) for k in range(6)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://a.org/9", "<p>broken <b>text"), (23, "http://c.org", "plain")]
    got = {r["page_id"]: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head 3\nOne & two three\nFour five"
    assert got[12]["text"] == "Own 2\na2\nb"
    assert [got[k]["text"] for k in (20, 21, 22, 23)] == ["", "", "broken text", "plain"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_alignment_makes_optional_and_repeated_groups():
    a, b = "html body p+ /p+ /body".split(), "html body div /div p /p /body".split()
    assert wrappers.aligned(a, b) == "html body div? /div? p+ /p+ /body".split()
    assert wrappers.folded("ul li a /a /li li a /a /li /ul".split())[0] == "ul li+ a+ /a+ /li+ /ul".split()


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = words(rng, 30)
    texts = [(k, words(rng, 60) if k % 4 else "###! " * 30 + words(rng, 20)) for k in range(120)]
    texts += [(200, texts[1][1]), (201, words(rng, 30) + " " + item), (202, words(rng, 40) + " mail a.b@c.org now")]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = {k for k in range(120) if k % 4}
    assert good <= set(got) and not {200, 201} & set(got) and 202 in got and all(r["round_trip"] for r in got.values())
    assert len(set(got) - good - {202}) <= 2


def test_stages_keep_rows_without_id_and_of_shared_ids(spark):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    # b without an id; a row thrice; 5 stands on c and on a copy of a.
    texts = [(1, a), (None, b), (None, b), (3, d), (3, d), (3, d), (5, c), (5, a), (None, d), (8, None), (None, "")]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in corpus_pipeline.one_of_each_group(spark, frame(spark, texts), "").where("text <> ''").collect())
    assert got == sorted([(1, a), (0, b), (3, d), (5, c)])
    assert corpus_pipeline.one_of_each_group(spark, frame(spark, texts), "").where("text is null or text = ''").count() == 2
    items = spark.createDataFrame([(1, " ".join(b.split()[10:40]))], "item_id long, text string")
    left = decontaminate.without_leaks(frame(spark, [(None, b), (None, a), (2, b), (2, c), (2, c), (None, None)]), items).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(0, a), (2, c), (2, c), (0, "")])
    known = [(k, f"{words(rng, 5)} customer-ref: 10.{k}.3.4 {words(rng, 3)}") for k in range(12)]
    clean = pii.redact(frame(spark, known + [(None, "x customer-ref: AB-99812-X here"), (70, "code AB-99812-X"), (70, "clean text of the same id"), (None, "mail a.b@c.org")])).collect()
    assert {(r["doc_id"], r["text"]) for r in clean if r["doc_id"] in (None, 70)} == {(None, "x customer-ref: [ID] here"), (70, "code [ID]"), (70, "clean text of the same id"), (None, "mail [EMAIL]")}
