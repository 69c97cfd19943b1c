"""Which pages of a site to look at: seeds, links, budgets, breadth-first levels, robots, pacing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.config import PATHS, SHORT_PATHS
from sitewright.functions.text import hrefs
from sitewright.functions.urls import PATH_GATE, SITEMAP_GATE, SITEMAP_HINT, clean_host, hint_score, in_scope, origin, path, resolve_link
from sitewright.operators.robots import allowed  # noqa: F401 - beside the other gates
from sitewright.sources.tables import header_options, kept


def links(pages: DataFrame) -> DataFrame:
    """page_id, site, pos, url of every link of every page that leads to http(s); duplicates stay."""
    found = pages.select("page_id", "site", "url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    leads = F.filter(F.array(resolve_link(F.col("url"), F.col("href"))), lambda u: u.isNotNull())
    return found.select("page_id", "site", "pos", F.explode(leads).alias("url"))


def inner_links(found: DataFrame) -> DataFrame:
    """site, url, ord: links in the site whose path names a company page, without query, in the order first seen."""
    kept = found.filter(in_scope(clean_host(F.col("url")), F.col("site")) & path(F.col("url")).rlike(PATH_GATE))
    return kept.groupBy("site", F.concat(origin(F.col("url")), path(F.col("url"))).alias("url")).agg(F.min(F.struct("page_id", "pos")).alias("ord"))


def scored_links(found: DataFrame) -> DataFrame:
    """site, url, score: distinct links with the number of hint words."""
    return found.select("site", "url").distinct().withColumn("score", hint_score(F.col("url")))


def seeds(sites: DataFrame, paths: list[str] = PATHS, extra: tuple[str, ...] = ()) -> DataFrame:
    """site, url, ord: the well-known paths of each site, a fixed list that each row is exploded by."""
    listed = F.array(*[F.lit(p) for p in [*paths, *extra]])
    return sites.select("site", F.posexplode(listed).alias("ord", "path")).select("site", F.concat(F.lit("https://"), F.col("site"), F.col("path")).alias("url"), "ord")


def short_seeds(sites: DataFrame) -> DataFrame:
    return seeds(sites, SHORT_PATHS)


def top_sitemap(urls: DataFrame, k: int) -> DataFrame:
    """site, url, score, rank of the k best captured sitemap URLs of a site: hinted ones first, then by name."""
    fit = urls.filter(path(F.col("url")).rlike(SITEMAP_GATE)).withColumn("score", F.col("url").rlike(SITEMAP_HINT).cast("int"))
    w = Window.partitionBy("site").orderBy(F.desc("score"), "url")
    return fit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hinted_sitemap(urls: DataFrame, k: int) -> DataFrame:
    """The same by the number of hint words, without the test of the path."""
    w = Window.partitionBy("site").orderBy(F.desc("score"), "url")
    return urls.withColumn("score", hint_score(F.col("url"))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def budget(sources: list[DataFrame], max_pages: int) -> DataFrame:
    """site, url, src_rank, place: the first max_pages distinct URLs of each site, sources (site, url, ord) in their order."""
    ranked = [s.select("site", "url", F.lit(k).alias("src_rank"), F.to_json(F.struct("ord")).alias("_ord") if dict(s.dtypes)["ord"].startswith("struct") else F.lpad(F.col("ord").cast("string"), 20, "0").alias("_ord")) for k, s in enumerate(sources)]
    all_ = reduce(DataFrame.unionByName, ranked)
    first = all_.groupBy("site", "url").agg(F.min(F.struct("src_rank", "_ord")).alias("o"))
    w = Window.partitionBy("site").orderBy("o.src_rank", "o._ord", "url")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max_pages).select("site", "url", F.col("o.src_rank").alias("src_rank"), "place")


def breadth_first(roots: DataFrame, edges: DataFrame, depth: int, max_pages: int) -> DataFrame:
    """site, url, depth, place of what is reached from roots (site, url, ord) over edges (site, src, url), max_pages a site at most.

    A queue: roots in their order, then each page's links in the order in which the pages themselves came, those with more
    hint words first, then by name; a page counts where it comes first. Pages beyond the budget lead nowhere.

    Edges and each level are kept as tables, so links are found once, and a level's plan holds the level before it alone;
    its rows are max_pages a site at most. The number of levels is a parameter.
    """
    edges = kept(edges.select("site", "src", "url"), "edges")
    level = roots.groupBy("site", "url").agg(F.struct(F.min("ord").alias("ord"), F.lit(0).alias("hint")).alias("o"))
    levels: list[DataFrame] = []
    for d in range(depth + 1):
        w = Window.partitionBy("site").orderBy("o.ord", "o.hint", "url")
        placed = level.withColumn("place", F.row_number().over(w).cast("long"))
        if levels:
            seen = reduce(DataFrame.unionByName, levels)
            taken = seen.groupBy("site").agg(F.max("place").alias("taken"))
            placed = placed.join(taken, "site").withColumn("place", F.col("place") + F.col("taken")).drop("taken")
        placed = kept(placed.filter(F.col("place") <= max_pages).select("site", "url", F.lit(d).alias("depth"), "place"), f"level-{d}")
        levels.append(placed)
        if d < depth:
            reached = placed.select("site", F.col("url").alias("src"), F.col("place").alias("ord")).join(edges, ["site", "src"])
            found = reached.groupBy("site", "url").agg(F.min(F.struct("ord", (-hint_score(F.col("url"))).alias("hint"))).alias("o"))
            level = found.join(reduce(DataFrame.unionByName, levels).select("site", "url"), ["site", "url"], "left_anti")
    return reduce(DataFrame.unionByName, levels)


def pacing(urls: DataFrame, rate_ms: int, clock: DataFrame | None = None, headers: str = "") -> DataFrame:
    """host, url, seq, earliest_ms, headers: when each request of a host may start, the first at 0 or when its clock allows.

    clock: host, last_ms, the last start on the same scale, of an earlier run (see clock_after). headers: a JSON text of
    more headers for each request, as a map; none where it can't be read.
    """
    w = Window.partitionBy("host").orderBy("url")
    rows = urls.select(clean_host(F.col("url")).alias("host"), "url").distinct().withColumn("seq", F.row_number().over(w))
    free = F.lit(0).cast("long")
    if clock is not None:
        rows = rows.join(clock.select("host", "last_ms"), "host", "left")
        free = F.greatest(free, F.coalesce(F.col("last_ms") + rate_ms, F.lit(0)))
    planned = rows.withColumn("earliest_ms", free + (F.col("seq") - 1) * F.lit(rate_ms).cast("long")).withColumn("headers", header_options(F.lit(headers)))
    return planned.select("host", "url", "seq", "earliest_ms", "headers")


def clock_after(planned: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """host, last_ms: each host's last planned start, or the one it had; what the next run's pacing begins with."""
    last = planned.groupBy("host").agg(F.max("earliest_ms").alias("last_ms"))
    return last if clock is None else last.unionByName(clock.select("host", "last_ms")).groupBy("host").agg(F.max("last_ms").alias("last_ms"))


def backoff(retries: int, backoff_ms: int):
    """array<long>: waits before each retry, doubling; without the random part."""
    return F.transform(F.sequence(F.lit(1), F.lit(retries)), lambda n: (F.lit(backoff_ms) * F.pow(F.lit(2), n - 1)).cast("long"))
