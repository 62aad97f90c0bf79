"""A best-first walk over stored pages under a budget, as an iterated fold over each site's frontier.

A site's frontier holds the addresses that it may read next, ordered by (priority, when they were found). Reading a page takes the first
one off and adds the page's admissible links behind all equals. A round of the walk reads, at every site at once, the longest run of
addresses whose order no link of the pages before them in the run can change: a page's links come in between only if one of them has a
smaller priority than the next address. So a round needs one join with the links of the pages just read, and most walks end in
a few rounds; one page a round at worst, as many rounds as the budget.

A frontier never holds more addresses than the site may still read, since none further back will be reached; so the state is bounded by
the budget, whatever the number of links, and no site gathers its links in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import url_host, url_path
from folioforge.operators.pages import link_priority, link_related, skip_url
from folioforge.sources.shared import settle

#: Priorities of a site's first page and of further seeds; links have 10, 30 or 50.
HOME, SEED = 0, 5


def first_pages(pages: DataFrame) -> DataFrame:
    """(site, url) of each host's page with the smallest id."""
    first = pages.where("url is not null").groupBy(url_host(F.col("url")).alias("site")).agg(F.min(F.struct("page_id", "url")).alias("p"))
    return first.select("site", F.col("p.url").alias("url"))


def feed_seeds(homes: DataFrame, feed: DataFrame) -> DataFrame:
    """(site, url): the links that a feed (site, link) names for known sites, trimmed; blank ones, repeats and the first page itself are left out."""
    link = F.trim("link")
    named = homes.join(feed.select("site", link.alias("link")), "site", "left").where((F.col("link") != "") & (F.col("link") != F.col("url")))
    return named.select("site", F.col("link").alias("url")).distinct()


def _edges(links: DataFrame, homes: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(site, src, dst, priority, place, near): a site's links on its own host that aren't skipped; near ones count on every level, others from the first page on.

    Of several links to one address on a page, each stands for itself. With stored (url), links to other addresses are left out: reading them fails.
    """
    home = homes.select("site", url_host(F.col("url")).alias("host"), F.regexp_replace(url_path(F.col("url")), "/+$", "").alias("home_path"))
    own = settle(links.select("src", "dst", "anchor", "place"))  # so that the long expression of an address is compiled but once
    own = own.withColumn("host", url_host(F.col("dst"))).where(~skip_url(F.col("dst")))
    own = own if stored is None else own.join(stored.select(F.col("url").alias("dst")).distinct(), "dst", "left_semi")
    near = F.startswith(url_path(F.col("dst")), F.col("home_path")) | link_related(F.col("dst"), F.col("anchor"))
    return own.join(home, "host").select("site", "src", "dst", link_priority(F.col("dst"), F.col("anchor")).alias("priority"), F.col("place").cast("int").alias("place"), near.alias("near"))


def _ranked(entries: DataFrame, most: int) -> DataFrame:
    """Each address of a site once, as it was read (n) or else at its first place; rank counts on from the pages read. No more than the budget."""
    first = F.min(F.struct(F.col("n").isNull().alias("open"), "priority", "found", "place", "depth", "least", "n")).alias("e")
    one = entries.groupBy("site", "url").agg(first).select("site", "url", "e.*")
    order = Window.partitionBy("site").orderBy(F.asc_nulls_last("n"), "priority", "found", "place", "url")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("open")


def walk(homes: DataFrame, links: DataFrame, depth: int = 3, most: int = 15, seeds: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(site, url, depth, priority, place): the pages that each site's walk reads, in order from 1.

    homes: (site, url), one for each site; seeds: (site, url), read behind the first page; links: (src, dst, anchor, place);
    stored: (url) of the pages that can be read, all if it isn't given. A page counts once, at its first turn; a seed that is the
    site's first page isn't read again; a link to a page already read is left out, and so are links of pages at the last depth.
    """
    edges = settle(_edges(links, homes, stored))
    least = edges.groupBy("site", F.col("src").alias("url")).agg(F.min("priority").alias("least"))
    edges = settle(edges.join(least.withColumnRenamed("url", "dst"), ["site", "dst"], "left"))
    start = homes.select("site", "url", F.lit(HOME).alias("priority"), F.lit(0).alias("place"))
    if seeds is not None:
        start = start.union(seeds.select("site", "url", F.lit(SEED), F.row_number().over(Window.partitionBy("site").orderBy("url"))))
    if stored is not None:
        start = start.join(stored.select("url").distinct(), "url", "left_semi").select("site", "url", "priority", "place")
    zero = F.lit(0)
    start = start.join(least, ["site", "url"], "left").select("site", "url", "priority", zero.alias("found"), "place", zero.alias("depth"), "least", F.lit(None).cast("int").alias("n"))
    state = settle(_ranked(start, most))
    upto = Window.partitionBy("site").orderBy("rank")
    # Links of a page at the last depth don't count; without links nothing comes in between; pages read before are past.
    between = F.when(F.col("n").isNull() & (F.col("depth") < depth), F.col("least"))
    while not state.where("n is null").isEmpty():
        before = F.min(between).over(upto.rowsBetween(Window.unboundedPreceding, -1))
        run = state.withColumn("stays", (F.col("n").isNotNull() | F.coalesce(before >= F.col("priority"), F.lit(True))).cast("int"))
        taken = F.col("n").isNull() & (F.min("stays").over(upto.rowsBetween(Window.unboundedPreceding, 0)) == 1)
        run = run.withColumn("now", taken).withColumn("n", F.when(F.col("now"), F.col("rank")).otherwise(F.col("n")))
        new = run.where(F.col("now") & (F.col("depth") < depth)).select("site", F.col("url").alias("src"), F.col("depth").alias("d"), F.col("n").alias("found"))
        new = new.join(edges, ["site", "src"]).where((F.col("d") == 0) | F.col("near"))
        new = new.select("site", F.col("dst").alias("url"), "priority", "found", "place", (F.col("d") + 1).alias("depth"), "least", F.lit(None).cast("int").alias("n"))
        state = settle(_ranked(run.select(*new.columns).union(new), most))
    return state.select("site", "url", "depth", "priority", F.col("n").alias("place"))
