"""The trie of all prefixes of conversations, by peeling truncated conversations from the deepest level upwards.

Each conversation becomes one row: the chained 16-byte hashes of its turns (so that its first k hashes name its prefixes, and no text
moves) and the turns' code points. Equal conversations merge at once. Then the deepest level is peeled: conversations that end there
merge with the nodes that survive from below, each merged group is a node, which is put out with its sums; its last turn is stripped
and it goes on as a child of the level above. Nodes are discovered and summed up in the same pass.

Levels are peeled in bands. All rows below level k that share their prefix of k + 1 turns meet in one task, which peels them down to
that prefix, level by level. A step takes the least k (so the most levels) of a doubling row at which no such group weighs more than
GROUP turns; if several rows still outweigh it at every k, one level alone is peeled by a Spark aggregation, with partial sums before
the shuffle. A group of one row is never too heavy: a long conversation is peeled alone. So neither a common first turn nor a
conversation with very many copies gathers in one task, and deep tries don't cost a job a level. Both ways give the same nodes.

The conversations that end at a node are hashed in ranges: bounded runs of ascending ids become strings, which one task streams in
order through SHA-256, as that hash has no parallel form.

Defined cases: turns come by turn number (null first), ties by role, then by the text's hash; null role or text is empty; repeated
rows are turns of their own; rows without a conversation id take no part; a conversation without turns ends at the root; an empty
table gives no rows, not even a root; a turn's text is hashed whole; other columns are ignored. A conversation is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import settle, slim_batches

#: Turns that one task's group of conversations holds at most, unless it is a single one.
GROUP = 1 << 18
#: Bytes of a prefix's hash; ids that are hashed as one string.
WIDE, RUN = 16, 4096
ROOT = bytes(WIDE)
ALIVE = "path binary, lens array<long>, n long, low long, kids long, leaves long, saved long, below boolean"
NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def own_turns(turns: DataFrame) -> DataFrame:
    """(conv, turns): each conversation's turns in order, as (hash, code points)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.struct(F.col("turn"), role.alias("role"), sha.alias("sha"), F.char_length(text).cast("long").alias("len")).alias("t"))
    return rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["sha"].alias("sha"), t["len"].alias("len"))).alias("turns"))


def rebuilt(turns: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """(conv, turns): the first h = crc32(conv) % heads turns of the first conversation of its family, then its own turns after its first h."""
    every = settle(own_turns(turns))
    h = (F.crc32(F.col("conv").cast("string")) % heads).cast("int")
    first = every.where(F.col("conv") % family == 0).select(F.col("conv").alias("first"), F.slice("turns", 1, heads - 1).alias("lead"))
    both = every.withColumns({"first": F.col("conv") - F.col("conv") % family, "h": h}).join(first, "first", "left")
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv", F.concat(lead, own).alias("turns"))


def _paths(convs: DataFrame) -> DataFrame:
    """(conv, path, lens): a conversation's chained hashes, WIDE bytes a turn, and its turns' code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = []
            for shas in b["shas"]:
                last, out = ROOT, []
                for s in shas:
                    last = hashlib.blake2b(last + bytes(s), digest_size=WIDE).digest()
                    out.append(last)
                paths.append(b"".join(out))
            yield pd.DataFrame({"conv": b["conv"], "path": paths, "lens": b["lens"]})

    return convs.select("conv", F.col("turns.sha").alias("shas"), F.col("turns.len").alias("lens")).mapInPandas(run, "conv long, path binary, lens array<long>")


def _depth(path: str = "path") -> F.Column:
    return F.octet_length(path) / WIDE


def _last(path: str = "path") -> F.Column:
    """A path's own node: its last hash, or the root."""
    return F.when(F.octet_length(path) == 0, F.lit(ROOT)).otherwise(F.substring(path, F.octet_length(path) - WIDE + 1, F.lit(WIDE)))


def _sums(rows: DataFrame) -> DataFrame:
    """Rows of one level, ended conversations and children, merged to that level's nodes: (node, path, lens, n, low, kids, leaves, saved)."""
    below = lambda c: F.sum(F.when(F.col("below"), F.col(c)).otherwise(0))
    merged = rows.groupBy(_last().alias("node")).agg(
        F.min(F.struct("low", "path", "lens")).alias("m"), F.sum("n").alias("n"), F.sum(F.col("below").cast("long")).alias("kids"), below("leaves").alias("leaves"), below("saved").alias("saved")
    )
    own = F.coalesce(F.try_element_at("m.lens", F.lit(-1)), F.lit(0)) * (F.col("n") - 1)
    return merged.select("node", "m.path", "m.lens", "n", "m.low", "kids", F.greatest("leaves", F.lit(1)).alias("leaves"), (F.col("saved") + own).alias("saved"))


def _one_level(rows: DataFrame) -> DataFrame:
    """The nodes of rows that all have the same depth, with their paths."""
    return settle(_sums(rows))


def _stripped(nodes: DataFrame) -> DataFrame:
    """Nodes as children of the level above."""
    path = F.substring("path", F.lit(1), F.octet_length("path") - WIDE)
    return nodes.select(path.alias("path"), F.slice("lens", F.lit(1), F.size("lens") - 1).alias("lens"), "n", "low", F.lit(0).cast("long").alias("kids"), "leaves", "saved", F.lit(True).alias("below"))


def _as_rows(nodes: DataFrame) -> DataFrame:
    parent = F.when(F.octet_length("path") == 0, F.lit(None)).otherwise(_last_but_one())
    return nodes.select("node", parent.alias("parent"), _depth().cast("long").alias("depth"), F.col("low").alias("conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def _last_but_one() -> F.Column:
    return F.when(F.octet_length("path") == WIDE, F.lit(ROOT)).otherwise(F.substring("path", F.octet_length("path") - 2 * WIDE + 1, F.lit(WIDE)))


def peel(rows: list[tuple], lo: int) -> Iterator[tuple]:
    """The nodes deeper than lo of rows (path, lens, n, low, leaves, saved, below) that share their prefix of lo + 1 turns.

    From the deepest level upwards: (node, parent, depth, low, n, kids, leaves, saved), the one of depth lo + 1 last.
    """
    waiting: dict[int, list[tuple]] = {}
    for r in rows:
        waiting.setdefault(len(r[0]) // WIDE, []).append(r)
    alive: dict[bytes, list] = {}
    for depth in range(max(waiting), lo, -1):
        for path, lens, n, low, leaves, saved, below in waiting.pop(depth, ()):
            node = path[-WIDE:]
            own = alive.get(node)
            if own is None:
                alive[node] = own = [path, lens, 0, low, 0, 0, 0]
            own[2] += n
            own[3] = min(own[3], low)
            if below:
                own[4], own[5], own[6] = own[4] + 1, own[5] + leaves, own[6] + saved
        above: dict[bytes, list] = {}
        for node, (path, lens, n, low, kids, leaves, saved) in alive.items():
            leaves, saved = leaves or 1, saved + (n - 1) * int(lens[depth - 1])
            up = path[(depth - 2) * WIDE : (depth - 1) * WIDE] if depth > 1 else ROOT
            yield node, up, depth, low, n, kids, leaves, saved
            if depth > lo + 1:
                own = above.get(up)
                if own is None:
                    above[up] = [path, lens, n, low, 1, leaves, saved]
                else:
                    own[2], own[3], own[4], own[5], own[6] = own[2] + n, min(own[3], low), own[4] + 1, own[5] + leaves, own[6] + saved
        alive = above
        for own in list(alive):  # a path may be longer than its node's depth; the node is its prefix
            alive[own][0] = alive[own][0][: (depth - 1) * WIDE]


def _band(rows: DataFrame, lo: int) -> DataFrame:
    """All nodes deeper than lo, from rows deeper than lo; those of depth lo + 1 carry their lens, to go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def put(group: list[tuple]) -> list[tuple]:
            out = list(peel(group, lo))
            lens, path = list(group[0][1][: lo + 1]), group[0][0][: (lo + 1) * WIDE]
            return [(*x, None, None) for x in out[:-1]] + [(*out[-1], path, lens)]

        key, group, out = None, [], []
        for b in batches:
            for path, lens, n, low, leaves, saved, below in zip(b["path"], b["lens"], b["n"].tolist(), b["low"].tolist(), b["leaves"].tolist(), b["saved"].tolist(), b["below"].tolist()):
                own = path[lo * WIDE : (lo + 1) * WIDE]
                if own != key and group:
                    out += put(group)
                    group = []
                key = own
                group.append((path, lens, n, low, leaves, saved, below))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if group:
            out += put(group)
        yield pd.DataFrame(out, columns=columns)

    schema = f"{NODE}, path binary, lens array<long>"
    columns = [c.split()[0] for c in schema.split(", ")]
    key = F.substring("path", lo * WIDE + 1, WIDE)
    dealt = rows.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key").drop("_key")
    return settle(dealt.mapInPandas(run, schema))


def _lowest(rows: DataFrame, deepest: int) -> int | None:
    """The least level of 0, 1, 2, 4, ... at which no group of several rows holds more than GROUP turns; none if there is none."""
    levels = [0, *[1 << k for k in range(deepest.bit_length()) if 1 << k < deepest]]
    size = _depth()
    cut = F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k < size))
    groups = rows.select("path", size.alias("size"), cut.alias("cut")).groupBy("cut", F.substring("path", F.col("cut") * WIDE + 1, F.lit(WIDE)).alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("size") - F.col("cut")).alias("turns"))
    heavy = {r["cut"] for r in groups.where((F.col("rows") > 1) & (F.col("turns") > GROUP)).select("cut").distinct().collect()}
    return next((k for k in levels if k not in heavy), None)


def peeled(paths: DataFrame) -> DataFrame:
    """All nodes (as NODE) of settled rows (conv, path, lens)."""
    ended = paths.groupBy("path").agg(F.min("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("low"))
    zero = F.lit(0).cast("long")
    alive = settle(ended.select("path", "lens", "n", "low", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.lit(False).alias("below")))
    found = None
    while True:
        deepest = int(alive.agg(F.max(_depth())).first()[0] or 0)
        if deepest == 0:
            return _as_rows(_one_level(alive)) if found is None else found.union(_as_rows(_one_level(alive)))
        lo = _lowest(alive, deepest)
        if lo is None:
            lo = deepest - 1
            nodes = _one_level(alive.where(_depth() > lo))
            put, up = _as_rows(nodes), _stripped(nodes)
        else:
            put = _band(alive.where(_depth() > lo), lo)
            top = put.where(F.col("path").isNotNull()).select("path", "lens", F.col("n_convs").alias("n"), F.col("conv_id").alias("low"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            put, up = put.drop("path", "lens"), _stripped(top)
        found = put if found is None else found.union(put)
        alive = settle(alive.where(_depth() <= lo).union(up))


def _end_hashes(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): for nodes at which conversations end, the hash of their ascending ids."""
    rows = paths.select(_last().alias("node"), F.col("conv"), F.floor(F.col("conv") / RUN).alias("run"))
    runs = rows.groupBy("node", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_set("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, digest = None, None
        for b in batches:
            out = []
            for node, ids in zip(b["node"], b["ids"]):
                if node == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((last, digest.hexdigest()))
                last, digest = node, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(last, digest.hexdigest())], columns=["node", "ends_sha256"])

    return runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids").mapInPandas(run, "node binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of conversations (conv, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    slim_batches(convs.sparkSession)
    paths = settle(_paths(convs))
    if paths.isEmpty():
        nodes = convs.sparkSession.createDataFrame([], NODE)
    else:
        nodes = settle(peeled(paths))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(parents, "parent", "left").join(_end_hashes(paths), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(turns))


def oracle_sql() -> str:
    """The same nodes in DuckDB SQL: prefixes are lists of turns, a node's sums go over all prefixes that start with it."""
    return """
        with recursive
        table8 as (
            select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
            from (select unnest(range(256))::bigint as i)
        ),
        turns as (
            select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as r,
                   coalesce(role, '') as role, coalesce(text, '') as text
            from conversations where conv_id is not null
        ),
        heads as (
            select conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
                                            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 6 as h
            from (select distinct conv_id from turns), table8
        ),
        parts as (
            select h.conv_id, t.r, t.role, t.text from heads h join turns t on t.conv_id = h.conv_id - h.conv_id % 100 and t.r <= h.h
            union all
            select h.conv_id, t.r + 1000000, t.role, t.text from heads h join turns t on t.conv_id = h.conv_id and t.r > h.h
        ),
        whole as (
            select h.conv_id, coalesce(p.w, []) as w
            from heads h left join (select conv_id, list({'role': role, 'text': text} order by r) as w from parts group by conv_id) p using (conv_id)
        ),
        prefixes as (select conv_id, len(w) as n, unnest(range(len(w) + 1)) as depth, w from whole),
        keyed as (select conv_id, depth, n, list_slice(w, 1, depth) as key, case when depth > 0 then length(w[depth].text) else 0 end as size from prefixes),
        nodes as (
            select key, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
                   coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') as ends
            from keyed group by key, depth
        ),
        links as (select c.*, p.key as up, p.conv_id as parent_conv_id from nodes c left join nodes p on c.depth = p.depth + 1 and list_slice(c.key, 1, p.depth) = p.key),
        children as (select up, count(*) as n_children from links where up is not null group by up),
        leaves as (select l.*, coalesce(k.n_children, 0) as n_children from links l left join children k on k.up = l.key),
        up as (select key, depth, n_children, (n_convs - 1) * size as own, unnest(range(depth + 1)) as top from leaves),
        sums as (select list_slice(key, 1, top) as key, sum((n_children = 0)::int)::bigint as n_leaves, sum(own)::bigint as saved_tokens from up group by 1)
        select l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, s.n_leaves, s.saved_tokens, sha256(l.ends) as ends_sha256
        from leaves l join sums s on s.key = l.key
    """
