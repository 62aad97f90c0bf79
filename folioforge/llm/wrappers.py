"""Main text of web pages by union-free wrappers of their hosts.

A page is a stream of structure tokens (block elements with their class or role) and text slots. Runs of a repeated token group fold
into one group (+). Spark counts the folded streams of each host; the streams of a host are then aligned, the most frequent first,
STREAMS at a time and their results in turn, level by level: what one of two streams lacks becomes optional (?), what one repeats
becomes repeated (+), and text stands in slots. The result is the host's wrapper, a union-free regular expression.

Each page is matched against its host's wrapper, so that each of its texts stands in one of the wrapper's slots. Spark gathers for each
slot on how many different pages it is filled, whether all of them fill it alike, how much text stands there and how much of it in
links. From these a host's main slots follow:

- slots in elements that are never main text (menus, footers, asides, forms and the like) are none, nor are those in containers whose
  class, role or (outside of article and main) id says so; such a container of no comments stays if it holds most of the host's text;
- if the wrapper's article or main groups hold at least REGION of the text that is left, their slots are the main text;
- else it is all slots that vary from page to page and aren't mostly links. A slot that MIN_PAGES or more different pages fill alike is template text.

Main text of a page are its texts in the main slots; if it has none there, its other texts outside of the elements named above.

Defined cases: null is empty; a page without a host shares the wrapper of the pages without one; broken or unclosed markup is read
as far as it goes, in time linear in the page; streams of any length shape their host's wrapper; ties between streams go by their
text; rows repeat as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import settle, sliced, slim_batches

MIN_PAGES, REGION = 4, 0.3
#: Streams that one task aligns into a wrapper at once, fewer (but two at least) if they have more tokens than this on average; the longest group that folds.
STREAMS, LONGEST, GROUP = 64, 4096, 6
#: Bytes of wrappers that may be broadcast; beyond it pages are joined to them by host.
MOST_BYTES = 32 << 20
#: Products of two streams' lengths from which runs are ranked instead of compared one by one, with the same result.
AT_ONCE = 1 << 19
#: Streams of which a task remembers the match.
MEMORY = 20_000

#: Elements by their part in a page.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("aside button datalist dialog footer form head iframe label map menu nav noscript object option script select style svg template textarea title video audio canvas".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("div section ul ol dl table header".split())
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
UNWANTED = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted related share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget complementary contentinfo search".split()
)

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)")
_WORDS = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


class Element:
    """An open element: the one around it, the number of its token, its name, whether it or one around it is never main text or a main region."""

    __slots__ = ("around", "at", "name", "tag", "skipped", "region")

    def __init__(self, around: Element | None, at: int, name: str, tag: str):
        self.around, self.at, self.name, self.tag = around, at, name, tag
        self.skipped = tag in SKIPPED or (around is not None and around.skipped)
        self.region = _is_region(name) or (around is not None and around.region)


class Slot:
    """One piece of text with its place: the number of its token, the element around it, whether it stands in a link, the block that it belongs to."""

    __slots__ = ("at", "inside", "link", "block", "text")

    def __init__(self, at: int, inside: Element | None, link: bool, block: int, text: str):
        self.at, self.inside, self.link, self.block, self.text = at, inside, link, block, text


def _name(tag: str, attributes: str) -> str:
    """A token: the element with its class and role, and with an id that says that it's no main text; numbers in them don't count."""
    names = {a.lower(): (b or c or d).lower() for a, b, c, d in _NAMES.findall(attributes)} if "=" in attributes else {}
    if "id" in names and not UNWANTED.intersection(_WORDS.findall(names["id"])):
        del names["id"]
    return tag + _NUMBER.sub("0", "".join(f"[{k}={'_'.join(v.split())}]" for k, v in sorted(names.items())))


def read(page: str) -> tuple[list[str], list[Slot]]:
    """(structure tokens, text slots) of one page; inline elements are no tokens."""
    tokens: list[str] = []
    slots: list[Slot] = []
    open_: list[Element] = []
    many: dict[str, int] = {}
    block = at = 0
    link = False

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            if not tokens or tokens[-1] != "#":
                tokens.append("#")
            slots.append(Slot(len(tokens) - 1, open_[-1] if open_ else None, link, block, html.unescape(raw)))
        elif raw and slots and slots[-1].block == block:
            last = slots[-1]
            slots.append(Slot(last.at, last.inside, last.link, block, " "))

    while True:
        m = _MARKUP.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if not m:
            return tokens, slots
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                text(m.group()[9:].removesuffix("]]>"))
            continue
        blocky = tag in BLOCKS or tag in SKIPPED or tag == "header"
        block += blocky
        if m.group(1) or m.group(4):
            link &= tag != "a"
            if blocky:
                tokens.append(f"/{tag}")
            if many.get(tag):
                while True:
                    gone = open_.pop().tag
                    many[gone] -= 1
                    if gone == tag:
                        break
            continue
        attributes = m.group(3) or m.group(6) or ""
        if tag == "br" and slots and slots[-1].block == block:
            text(" ")
        if tag == "a":
            link = True
        if not blocky:
            if tag not in RAW:
                continue
        name = _name(tag, attributes)
        tokens.append(name)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            tokens.append(f"/{tag}")
            continue
        if tag in CLOSED_BY_NEXT and open_ and open_[-1].tag == tag:
            open_.pop()
            many[tag] -= 1
        open_.append(Element(open_[-1] if open_ else None, len(tokens) - 1, name, tag))
        many[tag] = many.get(tag, 0) + 1


def folded(tokens: list[str]) -> tuple[list[str], list[int]]:
    """(the stream with runs of equal groups of up to GROUP tokens folded into one group whose tokens end in +, where each token went)."""
    names, marks, where = tokens, [False] * len(tokens), list(range(len(tokens)))
    for size in range(1, GROUP + 1):
        out: list[str] = []
        kept: list[bool] = []
        moved: list[int] = []
        i, n = 0, len(names)
        while i < n:
            group = names[i : i + size]
            j = i + size
            if j + size <= n and names[i] == names[j] and names[j : j + size] == group:
                while names[j : j + size] == group:
                    j += size
                moved += [len(out) + k % size for k in range(j - i)]
                out += group
                kept += [True] * size
                i = j
            else:
                moved.append(len(out))
                out.append(names[i])
                kept.append(marks[i])
                i += 1
        names, marks, where = out, kept, [moved[w] for w in where]
    return [f"{t}+" if m else t for t, m in zip(names, marks)], where


def bare(token: str) -> str:
    return token.rstrip("+?")


def aligned(wrapper: list[str], stream: list[str]) -> list[str]:
    """The wrapper that takes the stream too: tokens of one side only become optional, repeats of either side stay."""
    marks = lambda *ts: "".join(m for m in "+?" if any(m in t[len(bare(t)) :] for t in ts))
    optional = lambda ts: [bare(t) + marks(t, "?") if "?" not in t[len(bare(t)) :] else t for t in ts]
    out: list[str] = []
    i = j = 0
    for a, b, size in [*matching_blocks([bare(t) for t in wrapper], [bare(t) for t in stream]), (len(wrapper), len(stream), 0)]:
        out += optional(wrapper[i:a]) + optional(stream[j:b])
        i, j = a + size, b + size
        out += [bare(x) + marks(x, y) for x, y in zip(wrapper[a:i], stream[b:j])]
    return folded_optional(out)


def folded_optional(tokens: list[str]) -> list[str]:
    """Neighbouring equal tokens become one repeated token."""
    out: list[str] = []
    for t in tokens:
        if out and bare(out[-1]) == bare(t):
            optional = "?" if out[-1].endswith("?") and t.endswith("?") else ""
            out[-1] = bare(t) + "+" + optional
        else:
            out.append(t)
    return out


def matching_blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Blocks (place in a, place in b, size) that two streams share: the longest one, the first of equals, then those on either side of it.

    Long streams are compared by the ranks of their runs, so that the time of each block is about that of sorting them.
    """
    numbers = {t: i for i, t in enumerate(dict.fromkeys(a))}
    x, y = np.array([numbers[t] for t in a], np.int64), np.array([numbers.get(t, len(numbers)) for t in b], np.int64)
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if (ahi - alo) * (bhi - blo) < AT_ONCE:
            out += [(alo + m.a, blo + m.b, m.size) for m in SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks() if m.size]
            continue
        i, j, size = _longest(x[alo:ahi], y[blo:bhi])
        if size:
            i, j = i + alo, j + blo
            out.append((i, j, size))
            todo += [z for z in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)) if z[0] < z[1] and z[2] < z[3]]
    return sorted(out)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The longest run that a and b share: where it begins in either, and its length; the first in a, then in b, of equals.

    Runs of a length that doubles get ranks, equal for equal runs; a length between is two such runs that overlap.
    """

    def runs(size: int) -> tuple[np.ndarray, np.ndarray]:
        """A key for each run of size tokens in a and in b, from the ranks of runs of size half."""
        return tuple(r[: max(0, len(r) - (size - half))] * top + r[size - half :] for r in (x, y))

    half, x, y = 1, a, b
    if not np.isin(x, y).any():
        return 0, 0, 0
    while True:
        top = max(int(x.max()), int(y.max())) + 1
        p, q = runs(2 * half)
        if not np.isin(p, q).any():
            break
        ranks = np.unique(np.concatenate([p, q]), return_inverse=True)[1].astype(np.int64)
        half, x, y = 2 * half, ranks[: len(p)], ranks[len(p) :]
    low, high = half, 2 * half  # shared, not shared
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if np.isin(*runs(middle)).any() else (low, middle)
    p, q = runs(low)
    i = int(np.isin(p, q).argmax())
    return i, int((q == p[i]).argmax()), low


class Wrapper:
    """A host's wrapper with the elements around each of its slots."""

    def __init__(self, tokens: list[str]):
        self.tokens = [bare(t) for t in tokens]
        self.chains: dict[int, list[tuple[int, str]]] = {}
        open_: list[tuple[int, str]] = []
        for i, t in enumerate(self.tokens):
            if t == "#":
                self.chains[i] = list(open_)
            elif t.startswith("/"):
                for k in range(len(open_) - 1, max(-1, len(open_) - 8), -1):  # optional tokens need not be balanced
                    if _tag(open_[k][1]) == t[1:]:
                        del open_[k:]
                        break
            elif _tag(t) not in VOID and _tag(t) not in RAW:
                if open_ and _tag(t) in CLOSED_BY_NEXT and _tag(open_[-1][1]) == _tag(t):
                    open_.pop()
                open_.append((i, t))
        self.region = {i for i, chain in self.chains.items() if any(_is_region(name) for _, name in chain)}

    def match(self, stream: list[str]) -> list[int]:
        """The wrapper's token for each token of the stream; -1 for none."""
        out = [-1] * len(stream)
        for a, b, size in matching_blocks(self.tokens, [bare(t) for t in stream]):
            out[b : b + size] = range(a, a + size)
        return out

    def main_slots(self, filled: dict[int, tuple[int, bool, int, int]]) -> list[int]:
        """Slots of main text; filled: for each slot its pages, whether all fill it alike, and signs in all and in links."""
        mass = {i: max(0, filled[i][2] - filled[i][3]) for i in self.chains if i in filled}
        inside: dict[int, int] = {}
        for i, own in mass.items():
            for at, _ in self.chains[i]:
                inside[at] = inside.get(at, 0) + own
        total = sum(mass.values())

        def unwanted(i: int) -> bool:
            within = False
            for at, name in self.chains[i]:
                tag, words = _tag(name), set(_WORDS.findall(name[name.find("[") :] if "[" in name else ""))
                if tag in SKIPPED or (tag == "header" and not within):
                    return True
                if within:  # ids of an article's parts name its topics
                    words = set(_WORDS.findall(re.sub(r"\[id=[^\]]*\]", "", name[name.find("[") :]))) if "[" in name else set()
                if words & UNWANTED and (tag in CONTAINERS or tag == "article") and (words & COMMENTS or 2 * inside.get(at, 0) < total):
                    return True
                within |= _is_region(name)
            return False

        usable = [i for i in mass if not unwanted(i)]
        region = [i for i in usable if any(_is_region(name) for _, name in self.chains[i])]
        varying = [i for i in usable if not (filled[i][0] >= MIN_PAGES and filled[i][1])]
        if region and sum(mass[i] for i in region) >= REGION * sum(mass[i] for i in varying):
            return sorted(region)
        return sorted(i for i in varying if 2 * filled[i][3] < filled[i][2])


def _tag(name: str) -> str:
    return name.partition("[")[0]


def _is_region(name: str) -> bool:
    return _tag(name) in ("article", "main") or "[role=main]" in name


def _host(url: str | None) -> str:
    m = _HOST.match(url) if isinstance(url, str) else None
    return m.group(1).lower() if m else ""


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass")) - (1 << 63)


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, main): each host's wrapper and the numbers of its tokens that are slots of main text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in sliced(batches, "html"):
            rows = []
            for url, page in zip(b["url"], b["html"]):
                tokens, slots = read(page if isinstance(page, str) else "")
                stream, where = folded(tokens)
                texts: dict[int, list[Slot]] = {}
                for s in slots:
                    texts.setdefault(where[s.at], []).append(s)
                signs = lambda own: sum(len(s.text.strip()) for s in own)
                rows.append((_host(url), " ".join(stream), [(at, hash_text("".join(s.text for s in own)), signs(own), signs(s for s in own if s.link)) for at, own in texts.items()]))
            yield pd.DataFrame(rows, columns=["host", "stream", "slots"])

    # Rows that repeat a page count once.
    seen = pages.select("url", "html").mapInPandas(scan, "host string, stream string, slots array<struct<at: int, text: long, signs: int, link: int>>")
    seen = settle(seen.distinct())
    streams = settle(seen.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("n")))

    def align(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n", "stream"], ascending=[False, True])
        wrapper: list[str] | None = None
        for stream in own["stream"]:
            wrapper = stream.split(" ") if wrapper is None else aligned(wrapper, stream.split(" "))
        return pd.DataFrame({"host": own["host"].iloc[:1].tolist(), "stream": [" ".join(wrapper or [])], "n": [int(own["n"].sum())]})

    whole = streams
    tokens = F.length("stream") - F.length(F.replace("stream", F.lit(" "))) + 1
    # Long streams go to more tasks, though in two to one at least, so that each round leaves fewer.
    buckets = F.least(F.ceil(F.col("k") / 2), F.greatest(F.ceil(F.col("k") / STREAMS), F.ceil(F.col("tokens") / (STREAMS * LONGEST))))
    while True:
        sizes = settle(whole.groupBy("host").agg(F.count(F.lit(1)).alias("k"), F.sum(tokens).alias("tokens")))
        if sizes.where("k > 1").isEmpty():
            break
        dealt = whole.join(sizes.select("host", buckets.alias("buckets")), "host").withColumn("bucket", F.pmod(F.xxhash64("stream"), F.col("buckets")))
        whole = settle(dealt.groupBy("host", "bucket").applyInPandas(align, "host string, stream string, n long"))
    wrappers = whole.select("host", F.col("stream").alias("wrapper"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str, Wrapper] = {}
            found = []
            for wrapper, stream in zip(b["wrapper"], b["stream"]):
                if wrapper not in known:
                    known[wrapper] = Wrapper(wrapper.split(" "))
                found.append(known[wrapper].match(stream.split(" ")))
            yield pd.DataFrame({"host": b["host"], "stream": b["stream"], "match": found})

    matches = streams.join(wrappers, "host").select("host", "stream", "wrapper").mapInPandas(match, "host string, stream string, match array<int>")
    placed = seen.join(matches, ["host", "stream"]).select("host", "match", F.explode("slots").alias("s")).select("host", F.get("match", F.col("s.at")).alias("at"), "s.text", "s.signs", "s.link")
    filled = placed.where("at >= 0").groupBy("host", "at").agg(F.count(F.lit(1)).alias("pages"), (F.min("text") == F.max("text")).alias("alike"), F.sum("signs").alias("signs"), F.sum("link").alias("link"))
    # A row for each slot of a host's wrapper.
    filled = filled.groupBy("host").agg(F.collect_list(F.struct("at", "pages", "alike", "signs", "link")).alias("filled"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            main = [Wrapper(w.split(" ")).main_slots({f["at"]: (f["pages"], f["alike"], f["signs"], f["link"]) for f in own} if own is not None else {}) for w, own in zip(b["wrapper"], b["filled"])]
            yield pd.DataFrame({"host": b["host"], "wrapper": b["wrapper"], "main": main})

    return wrappers.join(filled, "host", "left").mapInPandas(decide, "host string, wrapper string, main array<int>")


class Extractor:
    """Main text of the pages of one host."""

    def __init__(self, wrapper: str, main):
        self.wrapper, self.main = Wrapper(wrapper.split(" ")), frozenset(int(i) for i in main)
        #: For each element of the wrapper: the slots inside, and the main ones among them.
        self.inside: dict[int, list[int]] = {}
        for i, chain in self.wrapper.chains.items():
            for at, _ in chain:
                counts = self.inside.setdefault(at, [0, 0])
                counts[0] += 1
                counts[1] += i in self.main
        self.known: dict[str, list[int]] = {}

    def is_main(self, slot: Slot, match: list[int], where: list[int]) -> bool | None:
        """Whether a text stands in a main slot; None if nothing of the wrapper says so.

        The matched slot decides if it lies in an element of the same name, and in a main region if the text does; else the innermost
        matched element around the text, by the most of its slots.
        """
        at = match[where[slot.at]]
        chain = self.wrapper.chains.get(at)
        inside = slot.inside
        if chain is not None and (chain[-1][1] if chain else "") == (inside.name if inside else "") and (at in self.wrapper.region) == (inside is not None and inside.region):
            return at in self.main
        while inside is not None:
            counts = self.inside.get(match[where[inside.at]])
            if counts is not None:
                return 2 * counts[1] >= counts[0]
            inside = inside.around
        return None

    def text(self, page: str) -> str:
        """Blocks of the main slots, white space inside each made one space, joined by newlines."""
        tokens, slots = read(page)
        stream, where = folded(tokens)
        key = " ".join(stream)
        if key not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[key] = self.wrapper.match(stream)
        match = self.known[key]
        slots = [s for s in slots if s.inside is None or not s.inside.skipped]
        chosen = [self.is_main(s, match, where) for s in slots]
        if not any(c and s.text.strip() for s, c in zip(slots, chosen)):
            chosen = [c is None for c in chosen]
        blocks: dict[int, list[str]] = {}
        for s, c in zip(slots, chosen):
            if c:
                blocks.setdefault(s.block, []).append(s.text)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    slim_batches(pages.sparkSession)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    known = settle(infer(pages))
    size = known.agg(F.coalesce(F.sum(F.length("host") + 64 + 2 * F.length("wrapper")), F.lit(0))).first()[0]
    if size <= MOST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: (r["wrapper"], r["main"]) for r in known.toLocalIterator()})

        @F.pandas_udf("string")
        def text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ready: dict[str, Extractor] = {}
            for urls, htmls in parts:
                out = []
                for u, h in zip(urls, htmls):
                    host = _host(u)
                    if host not in ready:
                        if len(ready) >= 1000:
                            ready.clear()
                        ready[host] = Extractor(*shared.value.get(host, ("", ())))
                    out.append(ready[host].text(h) if isinstance(h, str) else "")
                yield pd.Series(out, dtype=object)

        got = pages.withColumn("text", text("url", "html"))
    else:
        host = F.pandas_udf(lambda urls: urls.map(_host, na_action=None), "string")

        @F.pandas_udf("string")
        def text(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            ready: dict[str, Extractor] = {}
            for htmls, wrappers, mains in parts:
                out = []
                for h, w, m in zip(htmls, wrappers, mains):
                    w = w if isinstance(w, str) else ""
                    if w not in ready:
                        if len(ready) >= 1000:
                            ready.clear()
                        ready[w] = Extractor(w, m if m is not None else ())
                    out.append(ready[w].text(h) if isinstance(h, str) else "")
                yield pd.Series(out, dtype=object)

        got = pages.withColumn("host", host("url")).join(known, "host", "left").withColumn("text", text("html", "wrapper", "main"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
