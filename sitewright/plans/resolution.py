"""Whole runs over captured tables: a list of domains to records, and a list of domains to all addresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import PATHS, SHORT_PATHS, Config
from sitewright.functions.urls import clean_host, in_scope
from sitewright.operators import contacts as C
from sitewright.operators import dom, frontier, sinks, state
from sitewright.sources import tables as S


@dataclass
class Captured:
    """What was collected before: pages (page_id, url, html), and where there are such, sitemaps (site, xml), robots
    (origin, txt), cards (url, body), mx (domain)."""

    pages: DataFrame
    mx: DataFrame
    sitemaps: DataFrame | None = None
    robots: DataFrame | None = None
    cards: DataFrame | None = None
    suffixes: DataFrame | None = None


def chosen_pages(captured: Captured, sites: DataFrame, config: Config) -> DataFrame:
    """The captured pages of sites that the frontier's budget and robots rules let in: page_id, url, host, site, root.

    Bodies of home pages alone are read, for their links.
    """
    spark = captured.pages.sparkSession
    suffixes = captured.suffixes if captured.suffixes is not None else S.suffix_table(spark)
    urls = captured.pages.select("page_id", "url").withColumn("host", clean_host(F.col("url")))
    known = S.kept(S.registrable(urls.distinct(), suffixes), "page-sites").join(sites.select("site").distinct(), "site", "left_semi")
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^https?://(www\.)?", ""), "/$", "")
    home = captured.pages.select("page_id", "url", "html").join(known.filter(~F.contains(bare(F.col("url")), F.lit("/"))), ["page_id", "url"])
    sources = [frontier.seeds(sites, PATHS, config.extra_paths), frontier.inner_links(frontier.links(home))]
    if config.sitemap and captured.sitemaps is not None:
        sources.append(frontier.top_sitemap(S.sitemap_urls(captured.sitemaps), config.sitemap_budget()).select("site", "url", F.col("rank").alias("ord")))
    wanted = frontier.budget(sources, config.page_budget()).select("site", bare(F.col("url")).alias("_bare")).distinct()
    kept = known.withColumn("_bare", bare(F.col("url"))).join(wanted, ["site", "_bare"], "left_semi").drop("_bare")
    if captured.robots is not None:
        kept = frontier.allowed(kept, S.robot_rules(captured.robots, config.agent)).filter("allowed").drop("allowed")
    return kept


def people_of(pages: DataFrame, config: Config) -> DataFrame:
    """Hits of all channels in their order: role and name in the text, linked data, contact cards, blocks."""
    columns = ["site", "channel_ord", "page_id", "hit_ord", "title", "first", "last", "weight"]
    by_text = C.title_people(pages).withColumn("channel_ord", F.lit(0)).select(*columns)
    return by_text.unionByName(dom.dom_people(pages, config.strict).select(*columns))


def resolve_sites(captured: Captured, sites: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, pages, addresses) of sites (site, root): the pages looked at (page_id, site, url) and addresses found (site,
    email) are what evidence is made from.

    The numbers of the pages chosen and the addresses are kept as tables; page bodies are read where they are.
    """
    chosen = S.kept(chosen_pages(captured, sites, config).select("page_id", "site", "root", "url"), "chosen-pages")
    pages = captured.pages.select("page_id", "url", "html").join(chosen, ["page_id", "url"])
    found = C.page_emails(pages, config.mode).select("site", "email")
    if captured.cards is not None:
        found = C.card_emails(C.card_links(pages), captured.cards).select("site", "email").unionByName(found)
    named = C.site_company(pages)
    companies = sites.select("site", "root").distinct().join(named.select("site", "company"), "site", "left").withColumn("company", F.coalesce("company", F.concat(F.upper(F.substring("root", 1, 1)), F.expr("substring(root, 2)"))))
    owners = C.pick_owner(C.score_people(people_of(pages, config)), "UNICODE")
    found = S.kept(found.distinct(), "addresses")
    return C.resolve(companies, owners, found, captured.mx), chosen, found


def _sites_of(captured: Captured, domains: DataFrame) -> DataFrame:
    suffixes = captured.suffixes if captured.suffixes is not None else S.suffix_table(domains.sparkSession)
    return S.registrable(domains.select(F.lower("domain").alias("host")), suffixes).select("site", "root").distinct()


def run_batch(spark: SparkSession, captured: Captured, domains: DataFrame, out: str, kind: str = "csv", evidence_out: str = "", config: Config = Config()) -> DataFrame:
    """Resolves the domains (domain, line_no) that `out` does not have yet, appends them there, and returns their records.

    Results, evidence and the records that are returned come from one computation. The two folders are appended to one
    after the other; run_committed() commits them as one.
    """
    todo = sinks.to_do(spark, C.first_of_each(domains).select(F.lower("domain").alias("domain")), out, kind) if out else C.first_of_each(domains)
    records, looked, found = resolve_sites(captured, _sites_of(captured, todo), config)
    records = S.kept(records, "records")
    sinks.write_results(records, out, kind)
    if evidence_out:
        sinks.write_evidence(C.evidence(looked, found, records, config.hash_evidence), evidence_out)
    return records


RESULTS = "site string, company string, owner string, email string, email_origin string"
MARKS = "domain string"


def run_committed(spark: SparkSession, captured: Captured, domains: DataFrame, root: str, config: Config = Config(), answers: DataFrame | None = None) -> DataFrame:
    """Resolves the domains (domain, line_no) that the state at root has no mark of, and returns their records.

    Results, evidence, marks and, with answers, the cache are committed together: a run that ends before its commit has
    left none of them, and its domains are done by the next.
    """
    run = state.Run(spark, root)
    listed = C.first_of_each(domains).select(F.lower("domain").alias("domain"))
    todo = C.pending(listed, state.read(spark, root, "marks", MARKS))
    records, looked, found = resolve_sites(captured, _sites_of(captured, todo), config)
    records = run.write("results", records)
    run.write("evidence", C.evidence(looked, found, records, config.hash_evidence).withColumn("ts", F.current_timestamp()))
    run.write("marks", todo)
    if answers is not None:
        state.merge_cache(run, answers)
    run.commit()
    return records


def crawl_addresses(captured: Captured, domains: DataFrame, config: Config = Config()) -> DataFrame:
    """domain, email of every domain (domain): all addresses on captured pages within reach of its seeds, or an empty one."""
    pages = captured.pages.withColumn("host", clean_host(F.col("url"))).join(domains.select(F.col("domain").alias("host")), "host", "left_semi").withColumn("site", F.col("host"))
    edges = frontier.links(pages).join(pages.select("page_id", F.col("url").alias("src")), "page_id").filter(clean_host(F.col("url")) == F.col("site")).select("site", "src", "url").distinct()
    roots = frontier.short_seeds(domains.select(F.col("domain").alias("site"))).select("site", "url", "ord")
    if config.sitemap and captured.sitemaps is not None:
        roots = roots.union(frontier.hinted_sitemap(S.sitemap_urls(captured.sitemaps, whole_host=True), config.bfs_pages).select("site", "url", F.col("rank") + len(SHORT_PATHS)))
    # Seeds without a captured page lead nowhere and take no place in the budget.
    roots = roots.join(pages.select("url").distinct(), "url", "left_semi").select("site", "url", "ord")
    reached = frontier.breadth_first(roots, edges.join(pages.select("url").distinct(), "url", "left_semi").select("site", "src", "url"), config.max_depth, config.bfs_pages)
    read = pages.join(reached.select("site", "url"), ["site", "url"], "left_semi")
    found = C.all_addresses(read).join(read.select("page_id", F.col("site").alias("domain")), "page_id").select("domain", "email").distinct()
    if config.on_domain_only:
        found = found.filter(in_scope(F.lower(F.split_part("email", F.lit("@"), F.lit(2))), F.col("domain")))
    return C.with_sentinel(domains.select("domain"), found)
