"""N-gram Jaccard join by multiple-global-order prefix filtering.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of word shingles. Under any total order of the
shingles, two such sets share a shingle among the first n - ceil(percent * n / 100) + 1 of each; so a pair must share one under
every order. The orders are rarest first by the counts of sketches of fixed size (one sketch and hash for each order), so common
passages come last. The first shingle that they share lies still earlier in the smaller set, as both sizes bound the overlap from there.
Shingles that several prefixes of the first order hold give groups, of which those with the same members are one:

1. equal sets are one class from the start, and its document with the smallest id stands for it;
2. each member is compared with a few leaders of its group, chosen by a hash of their ids among those of about its size, and in a large
   group with the one that has the fewest rarer shingles (a star, not all pairs), and links give components;
3. what is left are pairs across components. A member outside its group's largest component meets those of about its size in a
   join that tests lengths and a bound on the overlap (hamming distance of 256-bit parity maps) inside the join condition, so only
   pairs that may link come out. Each member knows the largest groups in which it holds the shingle early and those in which it doesn't;
   a pair whose smaller set (or both of equals) knows a shingle early that the other knows comes out of the first such group only,
   other pairs come out of each of their groups;
4. links inside a component that neither step met count too. Each component's classes are dealt to blocks of bounded size, and each two
   blocks meet in a task of their own, which intersects all their sets at once and gives back counts, not pairs.

Pairs of 2 and 3 then have to share a shingle of their prefixes under the other order as well, and finer maps (4 bits a shingle)
must lie near each other. Only for pairs that pass all these filters are the texts read again and the sets intersected.

Steps 2 and 3 leave no pair out that may link unless its two members are already in one component; step 4 has all pairs of a component, and no
link leads out of one. So all links between documents count, those of copies by the number of their rows. Step 4 is quadratic in a
component's classes, as links are; its memory is bounded by the blocks, or by the two longest sets.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component; with fewer words than a
shingle the sequence is one shingle; rows with equal doc_id are one node, each keeps its own row and set size; a row without
doc_id keeps its row with a null component; ties in the order go by the shingle's hash; an empty table gives no rows; very long texts
are taken whole; other columns are ignored. Shingles are compared by 64-bit hashes, sets by 128-bit ones and their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import components, encoded, mix, only_maybe, settle, shingle_sets, sliced, slim_batches

#: Counters of each order's sketch, and the seeds that make the orders differ.
SLOTS = 1 << 18
SEEDS = (0x1234567, 0x89ABCDE)
MAPS = 4
#: Counters of a sketch that travel in one row.
PART = 1 << 14
#: Groups that each member knows, early and late, of those with several components. With fewer, pairs come out more often; none is lost.
KNOWN = 8
#: Members of one band beyond which a group has one more leader, as its pairs would cost more.
LARGE = 64
#: Classes and shingles of a block of a component, about; two blocks lie in memory at once. Columns of a block's matrix at once.
MEMBERS, SHINGLES = 512, 1 << 18
WIDTH = 2048


def _slot(tokens: np.ndarray, seed: int) -> np.ndarray:
    return (mix(tokens ^ np.uint64(seed * 0x10001)) % np.uint64(SLOTS)).astype(np.int64)


def _prefix(tokens: np.ndarray, counts: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The rarest shingles under one order: as many as any partner must share one of."""
    n = len(tokens)
    if not n:
        return tokens
    keep = n - -(-percent * n // 100) + 1
    return tokens[np.lexsort((tokens, counts[_slot(tokens, seed)]))[:keep]]


def _parity(tokens: np.ndarray) -> np.ndarray:
    """64 * MAPS bits: the parity of the set's shingles that fall on each. Two sets differ in no fewer shingles than their maps in bits."""
    bits = (mix(tokens ^ np.uint64(0xABCDEF)) % np.uint64(64 * MAPS)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=64 * MAPS) & 1).astype(np.uint8)).view(np.int64)


def _fine(tokens: np.ndarray) -> np.ndarray:
    """The parity map of a large set by some power of two times as many bits, 4 a shingle; folding its halves gives the smaller ones."""
    size = 64 * MAPS
    while size < 4 * len(tokens):
        size *= 2
    bits = (mix(tokens ^ np.uint64(0xABCDEF)) % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=size) & 1).astype(np.uint8)).view(np.int64)


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two fine maps differ, the longer folded to the shorter."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())  # of a signed number it would count the absolute value


def _sums(s: np.ndarray) -> tuple[int, int]:
    """128 bits that, with its size, tell a set from others."""
    return (int(s.sum().view(np.int64)), int(mix(s ^ np.uint64(77)).sum().view(np.int64))) if len(s) else (0, 0)


def _shared(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of xs with all of ys; without ys, of xs with each other (but not with themselves)."""

    def columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        known = np.isin(flat, common)
        at = np.searchsorted(common, flat[known])
        order = np.argsort(at, kind="stable")
        return row[known][order], at[order]

    if ys is None:
        values, counts = np.unique(np.concatenate(xs), return_counts=True)
        common = values[counts > 1]
    else:
        common = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    places = [columns(xs)] if ys is None else [columns(xs), columns(ys)]
    out = np.zeros((len(xs), len(xs if ys is None else ys)))
    for k in range(0, len(common), WIDTH):
        part = []
        for (row, at), n in zip(places, out.shape):
            lo, hi = np.searchsorted(at, [k, k + WIDTH])
            part.append(np.zeros((n, WIDTH), np.float32))
            part[-1][row[lo:hi], at[lo:hi] - k] = 1
        out += part[0] @ part[-1].T
    return out


def _links_of_blocks(b: pd.DataFrame, percent: int) -> pd.DataFrame:
    """For each class of the blocks lo and hi of a component, the rows of those classes of the other block (of the same one, if lo is hi) that link with it."""
    b = b.drop_duplicates(["n", "s1", "s2"])
    x, y = b[b["at"] == b["lo"]], b[b["at"] == b["hi"]]
    if not len(x) or not len(y):
        return pd.DataFrame({"n": [], "s1": [], "s2": [], "others": []}, dtype=np.int64)
    alone = b["lo"].iloc[0] == b["hi"].iloc[0]
    both = _shared(list(x["tokens"]), None if alone else list(y["tokens"]))
    link = both * (100 + percent) >= (x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None, :]) * percent
    if alone:
        np.fill_diagonal(link, False)
    out = [x.assign(others=link.astype(np.int64) @ y["w"].to_numpy())]
    if not alone:
        out.append(y.assign(others=link.T.astype(np.int64) @ x["w"].to_numpy()))
    return pd.concat(out)[["n", "s1", "s2", "others"]]


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (its set's size and hashes), and each task's sketch counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros((len(SEEDS), SLOTS), np.int32)
        for b in sliced(batches):
            sets = list(shingle_sets(encoded(b["text"]), size))
            tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
            for k, seed in enumerate(SEEDS):
                sketch[k] += np.bincount(_slot(tokens, seed), minlength=SLOTS).astype(np.int32)
            sums = [_sums(s) for s in sets]
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "n": [len(s) for s in sets], "s1": [x for x, _ in sums], "s2": [y for _, y in sums], "counts": None, "part": None})
        for k in range(len(SEEDS)):
            for part in range(0, SLOTS, PART):
                if sketch[k, part : part + PART].any():
                    yield pd.DataFrame({"id": pd.array([None], "Int64"), "n": -1, "s1": 0, "s2": 0, "counts": [sketch[k, part : part + PART]], "part": [k * SLOTS + part]})

    return settle(docs.mapInPandas(run, "id long, n long, s1 long, s2 long, counts array<int>, part int"))


def _counts(profile: DataFrame) -> np.ndarray:
    """The sketches, summed by Spark part by part as they stream in; 2 x 2^18 counters whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b["part"], b["counts"]):
                sums[part] = sums.get(part, 0) + np.asarray(counts, np.int64)
        if sums:
            yield pd.DataFrame({"part": list(sums), "counts": list(sums.values())})

    parts = len(SEEDS) * SLOTS // PART
    got = profile.where("n < 0").select("part", "counts").repartition(parts, "part").mapInPandas(run, "part int, counts array<long>").toArrow().to_pandas()
    out = np.zeros(len(SEEDS) * SLOTS, np.int64)
    for part, counts in zip(got["part"], got["counts"]):
        out[part : part + PART] = counts
    return out.reshape(len(SEEDS), SLOTS)


def _mixed(places: DataFrame, maps: DataFrame) -> DataFrame:
    """places (token, id, n, early, band, comp, main, c) with maps, known and late: the member's first groups by size, the largest first, in which it is early and in which it isn't."""
    own = F.collect_list(F.struct((-F.col("c")).alias("minus"), "token", "early", "main")).alias("own")

    def first(early: bool) -> F.Column:
        return F.slice(F.array_distinct(F.transform(F.array_sort(F.filter("own", lambda g: g["early"] if early else ~g["early"])), lambda g: g["token"])), 1, KNOWN)

    members = places.groupBy("id", "n", "band", "comp").agg(own).join(maps.hint("merge"), ["id", "n"]).withColumn("known", first(True)).withColumn("late", first(False))
    return members.withColumn("g", F.explode("own")).drop("own").withColumns({k: F.col(f"g.{k}") for k in ("token", "early", "main")}).drop("g")


def _across(mixed: DataFrame, near: F.Column) -> DataFrame:
    """Pairs (x, y) of members of a group that aren't in one component and pass near, a condition that holds alike in all groups in which the smaller set (both of equals) is early."""
    x = mixed.where("comp <> main").withColumn("at", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)]))).alias("x")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.at") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    smaller = F.col("x.n") < F.col("y.n")
    both = F.when(smaller, F.array_intersect("x.known", F.concat("y.known", "y.late"))).when(F.col("x.n") == F.col("y.n"), F.array_intersect("x.known", "y.known")).otherwise(F.array_intersect("y.known", F.concat("x.known", "x.late")))
    once = F.coalesce(F.get(both, F.lit(0)) == F.col("x.token"), F.lit(True))
    return x.join(mixed.alias("y").hint("merge"), met & near & once)


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): a row for each row of docs; n_links counts the other rows with an id whose sets link with its own."""
    return _joined(docs, size, percent, True)


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """ngram_join() without n_links, for callers that want components only."""
    return _joined(docs, size, percent, False)


def _joined(docs: DataFrame, size: int, percent: int, count: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    slim_batches(docs.sparkSession)
    profile = _profile(docs, size)
    counts = sc.broadcast(_counts(profile))
    rows = profile.where("n >= 0").select("id", "n", "s1", "s2")
    sets = rows.where("n > 0 and id is not null")
    classes = settle(sets.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")))

    def of_ids(ids: DataFrame, row, schema: str) -> DataFrame:
        """row(id, set) for each nonempty set of a document whose id is in ids, and for some others."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in sliced(batches):
                out = [row(int(i), s) for i, s in zip(b["id"], shingle_sets(encoded(b["text"]), size)) if len(s)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return only_maybe(docs, ids).mapInPandas(run, schema)

    def filters(i: int, s: np.ndarray) -> tuple:
        own, other = (_prefix(s, counts.value[k], seed, percent) for k, seed in enumerate(SEEDS))
        return i, len(s), own.view(np.int64), (other & np.uint64(0x7FFFFFFF)).astype(np.int32), _parity(s), _fine(s) if 2 * len(s) > 64 * MAPS else None

    held = settle(of_ids(classes.select("rep"), filters, "id long, n long, own array<long>, other array<int>, maps array<long>, fine array<long>"))
    # The first shingle that two linking sets share lies so early in the smaller one (in either of equals) that half of its prefix or so would do.
    early = (F.col("at") * (100 + percent) <= F.col("n") * (100 - percent)).alias("early")
    tokens = held.select("id", "n", F.posexplode("own").alias("at", "token"))
    by_size = Window.partitionBy("token").orderBy("n", "id")
    all_of = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beside = [F.min("id").over(all_of).alias("least"), F.max("id").over(all_of).alias("most"), F.bool_or(early).over(all_of).alias("any_early"), F.lag("n").over(by_size).alias("smaller"), F.lead("n").over(by_size).alias("larger")]
    # A member that links with none of the next sizes, as far as sizes go, links with none of its group.
    meets = (F.col("larger") * percent <= F.col("n") * 100) | (F.col("smaller") * 100 >= F.col("n") * percent)
    shared = tokens.select("*", *beside).where((F.col("most") > F.col("least")) & F.col("any_early") & meets)
    # Members that only repeat a class stay out; the filter of ids lets some through. Maps travel with the places in groups from here on.
    maps = held.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", *[F.col("maps")[k].alias(f"m{k}") for k in range(MAPS)]).distinct()
    # Sizes of one band, or of two that follow each other, hold all pairs that may link; the factor outweighs rounding.
    band = F.floor(F.log("n") / F.lit(float(np.log(100.1 / max(percent, 1))))).cast("int")
    maps = settle(maps)
    # Shingles with the same members give the same pairs, as those of a passage do that some documents share; one of them stands for all.
    places = settle(shared.select("token", "id", "n", "at"))
    hashed = [F.xxhash64("id", "n", early, F.lit(k)).cast("decimal(38,0)") for k in range(2)]
    alike_groups = places.groupBy("token").agg(F.count(F.lit(1)).alias("c"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(hashed)])
    kept = alike_groups.groupBy("c", "h0", "h1").agg(F.min("token").alias("token")).select("token")
    groups = settle(places.join(kept.hint("merge"), "token").join(maps.hint("merge"), ["id", "n"]).withColumns({"band": band, "early": early}))

    def alike(n: F.Column, m: F.Column) -> F.Column:
        """Whether sets of these sizes may link."""
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    def near(x: str, y: str) -> F.Column:
        """Whether two sets may link by the shingle's places, their sizes and maps: sets that link differ in at most this share of their sizes' sum, and their maps in no more bits."""
        apart = sum((F.bit_count(F.col(f"{x}.m{k}").bitwiseXOR(F.col(f"{y}.m{k}"))) for k in range(MAPS)), F.lit(0))
        first = ((F.col(f"{x}.n") > F.col(f"{y}.n")) | F.col(f"{x}.early")) & ((F.col(f"{y}.n") > F.col(f"{x}.n")) | F.col(f"{y}.early"))
        return alike(F.col(f"{x}.n"), F.col(f"{y}.n")) & first & (apart * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent))

    filter_rows = held.select("id", "n", "other", "fine")

    def closer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [(x is None or y is None) or _apart(x, y) * (100 + percent) <= (n + m) * (100 - percent) for x, y, n, m in zip(b["x"], b["y"], b["xn"], b["yn"])]
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    def finer(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that share a prefix under the other order too and whose fine maps aren't too far apart.

        An id that stands on several texts keeps its pair if one of them passes.
        """
        pairs = settle(pairs)
        rows = only_maybe(filter_rows, pairs.select("a").union(pairs.select("b")))  # the others needn't move
        x = rows.select(F.col("id").alias("a"), F.col("other").alias("xo"), F.col("fine").alias("x"), F.col("n").alias("xn"))
        y = rows.select(F.col("id").alias("b"), F.col("other").alias("yo"), F.col("fine").alias("y"), F.col("n").alias("yn"))
        both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(F.arrays_overlap("xo", "yo")).select("a", "b", "x", "y", "xn", "yn")
        return settle(both.mapInPandas(closer, "a long, b long").distinct())

    def whole_sets(ids: DataFrame) -> DataFrame:
        return of_ids(ids, lambda i, s: (i, len(s), *_sums(s), s.view(np.int64)), "id long, n long, s1 long, s2 long, tokens array<long>")

    read: list[DataFrame] = []  # the whole sets of all members of all pairs that were intersected, so of all that link

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that pass the exact intersection."""
        whole = settle(whole_sets(pairs.select("a").union(pairs.select("b"))))
        read.append(whole)
        x = whole.select(F.col("id").alias("a"), F.struct("n", "tokens").alias("x"))
        y = whole.select(F.col("id").alias("b"), F.struct("n", "tokens").alias("y"))
        both = F.size(F.array_intersect("x.tokens", "y.tokens")).cast("long")
        got = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(both * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
        return settle(got.select("a", "b").distinct())

    def pairs_of(both: DataFrame) -> DataFrame:
        return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    # The same hash in all groups, so that groups of the same members mostly agree on their leaders. A large group has one more, the member
    # with the fewest rarer shingles: it has few of its own and is near to most others.
    member, by = F.struct("id", "n", "early", *[f"m{k}" for k in range(MAPS)]), F.xxhash64("id", "n")
    chosen = groups.groupBy("token", "band").agg(F.min_by(member, by).alias("low"), F.max_by(member, by).alias("high"), F.when(F.count(F.lit(1)) > LARGE, F.min_by(member, F.struct("at", by))).alias("mid"))
    places = F.array(*[F.struct((F.col("band") + up).alias("band"), F.col(l).alias("l")) for l, up in (("low", 0), ("high", 0), ("low", 1), ("mid", 0), ("mid", 1))])
    leaders = chosen.select("token", F.explode(F.array_distinct(places)).alias("p")).where("p.l IS NOT NULL").select("token", "p.band", "p.l.*")
    star = groups.alias("x").join(leaders.alias("y").hint("merge"), (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.id") != F.col("y.id")) & near("x", "y"))
    links = verified(finer(pairs_of(star)))
    found = components(links)

    placed = groups.select("token", "id", "n", "early", "band").join(found.hint("merge"), "id", "left").select("token", "id", "n", "early", "band", F.coalesce("component", "id").alias("comp"))
    shares = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("c")).where("comps > 1")
    mixed = settle(_mixed(placed.join(shares.select("token", F.col("top.comp").alias("main"), "c").hint("merge"), "token"), maps))
    more = verified(finer(pairs_of(_across(mixed, near("x", "y")))))
    if not more.isEmpty():
        links = links.union(more)
        found = components(links)

    def counted() -> DataFrame:
        """(n, s1, s2, others): for classes with links the rows of other classes that link with them, by blocks of each component."""
        repeated = F.count(F.lit(1)).over(Window.partitionBy("rep")) > 1
        linked = classes.join(found.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").withColumn("repeated", repeated).where("component is not null or repeated")
        own = settle(linked.select(F.col("rep").alias("id"), "n", "s1", "s2", "w", "repeated", F.coalesce("component", "rep").alias("component")))
        needed = F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") / SHINGLES)).cast("int")
        large = own.groupBy("component").agg(needed.alias("blocks")).where("blocks > 1")
        dealt = own.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("n", "s1", "s2"), F.col("blocks")).cast("int"))
        whole = read[0].union(read[1])
        again = own.where("repeated").select("id")
        if not again.isEmpty():  # only where one doc_id stands on unlike texts, which may link with each other
            whole = whole.union(whole_sets(again))
        met = whole.join(dealt.hint("merge"), ["id", "n", "s1", "s2"]).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = met.select("component", F.least("at", "with").alias("lo"), F.greatest("at", "with").alias("hi"), "at", "n", "s1", "s2", "w", "tokens")
        links = units.groupBy("component", "lo", "hi").applyInPandas(lambda b: _links_of_blocks(b, percent), "n long, s1 long, s2 long, others long")
        return settle(links.groupBy("n", "s1", "s2").agg(F.sum("others").alias("others")))

    # A class hangs on its smallest id; ids with several texts join their classes.
    named = sets.join(classes, ["n", "s1", "s2"]).select("id", "rep").distinct()
    named = settle(named.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("component")))
    several = named.groupBy("id").agg(F.countDistinct("component").alias("c"), F.min("component").alias("low")).where("c > 1")
    if not several.isEmpty():  # only where one doc_id stands on unlike texts
        tied = named.join(several.select("id"), "id").select(F.col("id").alias("a"), F.col("component").alias("b"))
        roots = components(named.select(F.col("component").alias("a"), F.col("id").alias("b")).union(tied))
        named = named.drop("component").join(roots, "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    named = named.groupBy("id").agg(F.min("component").alias("component"))
    ours = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")]
    if not count:
        return rows.join(named, "id", "left").select(*ours)
    others = classes.join(counted(), ["n", "s1", "s2"], "left").select("n", "s1", "s2", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("others"))
    n_links = F.when(F.col("id").isNotNull() & F.col("others").isNotNull(), F.col("others")).otherwise(F.lit(0))
    return rows.join(others, ["n", "s1", "s2"], "left").join(named, "id", "left").select(*ours, n_links.alias("n_links"))
