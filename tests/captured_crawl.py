"""A small captured crawl of three invented sites, with the traps that pages hold, and what is run over it by name.

The engine's whole path runs on pages whose right results are known; these are typed out in captured_rows.py, not computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import Config
from sitewright.functions.text import hrefs, unescape
from sitewright.functions.urls import clean_host
from sitewright.operators import contacts as C
from sitewright.operators import dom, frontier, sinks
from sitewright.plans import resolution as R
from sitewright.sources import tables as S
from sitewright.streaming import arrivals

_HOME = """<html><head><title>Legno &amp; Co | Home</title><meta content="Rossi Legno — Mobili" property="og:site_name"></head><body><h1>Benvenuti</h1>
<a class=x href=/chi-siamo>Chi siamo</a> <a href="/contatti?x=1#y">c</a> <a href='mailto:info&#64;rossilegno.it?subject=Ciao'>scrivi</a>
<a title="a > b" href="/cards/anna.vcf">card</a> <a href="https://altro.it/about">altro</a> <!-- <a href="/team">no</a> -->
<p>Titolare Andr&eacute; Moreau</p></body></html>"""
_ABOUT = """<div class="h-card"><span class="p-name">Paola Verdi</span><span class="p-job-title">Founder</span></div>
<div class="team-member"><h3>Marco N&#101;ri, CEO</h3></div>
<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Legno","founder":[{"name":"Dora Lanza","jobTitle":"Fondatore"}]},null,{"@type":["Person"],"name":"Ugo Foscolo"}]}</script>
<script type="application/ld+json">{bad</script><a href="../cards/anna.vcf">v</a>"""
_CONTACT = """<p>Scrivi a vendite [at] rossilegno [dot] it</p> <p>paola.verdi&#64;rossilegno.it</p>
<a href=mailto:a.neri@rossilegno.it,ordini@rossilegno.it>m</a><a href="mailto:press@stampa.it">p</a>"""
_LAW_HOME = """<title>Bianchi &amp; Sons - Solicitors</title><body><p>Director Ugo Bianchi</p> <p>info@bianchi.co.uk</p> <p>ugo.bianchi@bianchi.co.uk</p></body>"""
PAGES = [
    (1, "https://rossilegno.it/", _HOME),
    (2, "https://rossilegno.it/chi-siamo", _ABOUT),
    (3, "https://rossilegno.it/contatti", _CONTACT),
    (4, "https://www.bianchi.co.uk/", _LAW_HOME),
    (5, "https://rossilegno.it/team/", "<p>capo (at) rossilegno (dot) it</p>"),
    (6, "https://vuoto.ch/", "<title></title><body>niente</body>"),
    (7, "https://vuoto.ch/about", None),
    (8, "https://rossilegno.it/privato", "never@rossilegno.it"),
]
SITEMAPS = [("rossilegno.it", "<urlset><url><LOC>https://rossilegno.it/team/</LOC></url><url><loc> https://rossilegno.it/x.html\n</loc></url><url><loc>https://rossilegno.it/y.pdf</loc></url><url><loc>https://nota.it/about/</loc></url></urlset>")]
ROBOTS = [("https://rossilegno.it", "User-agent: *\nDisallow: /\n\nUser-Agent: other\nUser-agent: SiteWright/2.0 # us\nDisallow: /privato\nAllow: /privato/si\nDisallow:"), ("https://vuoto.ch", "User-agent: sitewright\nUser-agent: *\nDisallow: /about$")]
CARD = "BEGIN:VCARD\nFN:Anna Rossi\nEMAIL:anna@rossilegno.it\nEMAIL:x@other.com\nEND:VCARD"
#: page_id, url, status, content_type, body, etag
ANSWERS = [
    (1, "https://a.it/1", 200, "text/html; charset=ISO-8859-1", "caffè".encode("latin-1"), "e1"),
    (2, "https://a.it/2", 200, "text/html", "però tanto testo".encode(), None),
    (3, "https://a.it/3", 304, None, None, None),
    (4, "https://a.it/4", 404, "text/html", b"no", None),
    (5, "https://a.it/5", 200, "application/pdf", b"no", None),
    (6, "https://a.it/6", 304, "text/html", None, None),
    (7, "https://a.it/anna.vcf", 200, "text/vcard", CARD.encode(), None),
]
_LAW, _EMPTY = "bianchi.co.uk", "vuoto.ch"
#: Records with quotes, line ends and nulls.
RECORDS = [(_LAW, ' Bianchi "&"\r\nSons ', "", "ugo.bianchi@bianchi.co.uk"), (_EMPTY, "Vuoto, sì", None, None)]
HOSTS = ["shop.example.ch", "a.b.example.pl", "x.example.co.nz", "www.example.co.uk", "example.sch.uk", "a.example.sch.uk", "city.kobe.jp", "a.city.kobe.jp", "b.c.kobe.jp", "www.ck", "a.b.ck", "example.com", "co.uk", "localhost", "a.example.unknowntop", "deep.name.com.br"]
LINES = ["https://www.A.it/x # note", "b.org", "B.org", "bad line", "# only", "", " c.co.uk ", "http://user@d.it:8080/y"]


def _pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def _known(spark: SparkSession) -> DataFrame:
    return S.registrable(_pages(spark).withColumn("host", clean_host(F.col("url"))), S.suffix_table(spark))


def _answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "page_id long, url string, status int, content_type string, body binary, etag string")


def _captured(spark: SparkSession) -> R.Captured:
    return R.Captured(
        _pages(spark),
        spark.createDataFrame([("rossilegno.it",), ("bianchi.co.uk",)], "domain string"),
        spark.createDataFrame(SITEMAPS, "site string, xml string"),
        spark.createDataFrame(ROBOTS, "origin string, txt string"),
        spark.createDataFrame([("https://rossilegno.it/cards/anna.vcf", CARD)], "url string, body string"),
    )


def _domains(spark: SparkSession) -> DataFrame:
    return S.one_domain(spark, "ROSSILEGNO.it", "www.bianchi.co.uk", "vuoto.ch", "rossilegno.it", " ")


def _sites(spark: SparkSession) -> DataFrame:
    return S.registrable(C.first_of_each(_domains(spark)).select(F.lower("domain").alias("host")), S.suffix_table(spark)).select("site", "root").distinct()


def captured_title_people(spark, sf_dir):
    return C.title_people(_known(spark))


def captured_heading_people(spark, sf_dir):
    return C.heading_people(_known(spark), strict=True)


def captured_dom_people(spark, sf_dir):
    return dom.dom_people(_known(spark))


def captured_jsonld_people(spark, sf_dir):
    return dom.dom_people(_known(spark), cards=False, blocks=False)


def captured_card_links(spark, sf_dir):
    return C.card_links(_known(spark))


def captured_card_emails(spark, sf_dir):
    return C.card_emails(C.card_links(_known(spark)), _captured(spark).cards)


def captured_page_emails(spark, sf_dir):
    return C.page_emails(_known(spark)).select("site", "page_id", "channel", "email")


def captured_mail_links(spark, sf_dir):
    return C.page_emails(_known(spark), "as_written").select("site", "page_id", "channel", "email")


def captured_addresses(spark, sf_dir):
    return C.all_addresses(_known(spark))


def captured_companies(spark, sf_dir):
    return C.site_company(_known(spark))


def captured_links(spark, sf_dir):
    return _known(spark).select("page_id", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def captured_inner_links(spark, sf_dir):
    return frontier.inner_links(frontier.links(_known(spark))).select("site", "url")


def captured_sitemap(spark, sf_dir):
    urls = S.sitemap_urls(_captured(spark).sitemaps)
    hinted = frontier.hinted_sitemap(urls, Config().bfs_pages).withColumn("by", F.lit("hints"))
    return frontier.top_sitemap(urls, Config().sitemap_budget()).withColumn("by", F.lit("words")).unionByName(hinted).select("by", "url", "score", "rank")


def captured_robots(spark, sf_dir):
    urls = spark.createDataFrame([(f"https://{u}",) for u in ("rossilegno.it/", "rossilegno.it/privato/x", "rossilegno.it/privato/si", "vuoto.ch/about", "vuoto.ch/about/us", "altro.it/x")], "url string")
    robots = _captured(spark).robots
    by = lambda agent: frontier.allowed(urls, S.robot_rules(robots, agent)).select(F.lit(agent).alias("agent"), "url", "allowed")
    return by("sitewright").unionByName(by("nobody")).unionByName(by("Other/1.0"))


def captured_scores(spark, sf_dir):
    return C.score_people(R.people_of(_known(spark), Config()))


def captured_pages_chosen(spark, sf_dir):
    return R.chosen_pages(_captured(spark), _sites(spark), Config()).select("site", "page_id")


def owner_run(spark, sf_dir):
    """The whole run over a list of domains: records."""
    return R.resolve_sites(_captured(spark), _sites(spark), Config())[0]


def owner_run_rows(spark, sf_dir):
    """The same as one line and one JSON object for each site."""
    records = owner_run(spark, sf_dir)
    return C.csv_rows(records).withColumnRenamed("row", "csv").join(C.json_rows(records).withColumnRenamed("row", "json"), "site")


def owner_run_evidence(spark, sf_dir):
    records, looked, found = R.resolve_sites(_captured(spark), _sites(spark), Config())
    log = C.evidence(looked, found, records, hashed=False)
    return log.select("domain", F.size("pages").alias("pages"), F.array_join("emailsFound", " ").alias("emails"), "result")


def crawl_run(spark, sf_dir):
    """The whole breadth-first run: all addresses of each domain, or an empty one, in order."""
    return R.crawl_addresses(_captured(spark), spark.createDataFrame([("rossilegno.it",), ("vuoto.ch",), ("nessuno.it",)], "domain string")).orderBy("domain", "email")


def crawl_order(spark, sf_dir):
    """The queue of a walk whose pages' order and budget tell it from a walk level by level."""
    edges = [("r1", "b"), ("r1", "a"), ("r2", "contact"), ("r2", "a"), ("a", "z"), ("b", "y"), ("b", "about"), ("contact", "x"), ("z", "deep"), ("r2", "r1")]
    roots = spark.createDataFrame([("s", "r1", 0), ("s", "r2", 1), ("s", "r1", 5)], "site string, url string, ord int")
    return frontier.breadth_first(roots, spark.createDataFrame([("s", *e) for e in edges], "site string, src string, url string"), 2, 8)


def answered_pages(spark, sf_dir):
    cache = spark.createDataFrame([("https://a.it/3", "vecchia", "t"), ("https://b.it/", "x", "t")], "url string, body string, etag string")
    cache = cache.select(F.sha2("url", 256).alias("url_sha"), F.col("body").cast("binary").alias("body"), "etag")
    return S.answer_pages(_answers(spark), 12, cache)


def answered_cards(spark, sf_dir):
    return S.card_bodies(_answers(spark), Config().body_limit)


def suffix_rules(spark, sf_dir):
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    return S.registrable(hosts, S.suffix_table(spark)).select("host", "site", "root")


def references(spark, sf_dir):
    texts = ["caff&egrave; &#8364;&#x41;", "&amp;lt;", "&notit; &unknown; &copy2", "&#150;&#0;&#x1F600;", "a & b"]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", unescape(F.col("text")).alias("plain"))


def listed_domains(spark, sf_dir):
    """Lists as files: domains, those processed, and the domains without regard to case."""
    path = S.work_folder(spark, "lists")
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(path)
    listed = S.domain_list(spark, path)
    out = listed.select(F.lit("listed").alias("kind"), "domain")
    out = out.unionByName(S.processed_list(spark, path).select(F.lit("processed").alias("kind"), "domain"))
    out = out.unionByName(C.first_of_each(listed).select(F.lit("first").alias("kind"), "domain"))
    return out.unionByName(_domains(spark).select(F.lit("named").alias("kind"), "domain"))


def written_results(spark, sf_dir):
    """Records written in every format by two runs, the second of which leaves out what the first has done, and the lines of the files."""
    records, parts = spark.createDataFrame(RECORDS, "site string, company string, owner string, email string"), []
    for kind in ("csv", "tsv", "jsonl"):
        path = S.work_folder(spark, f"results-{kind}")
        for sites in ([_LAW], [_LAW, _EMPTY]):
            left = sinks.to_do(spark, spark.createDataFrame([(x,) for x in sites], "domain string"), path, kind)
            sinks.write_results(records.join(left, records["site"] == left["domain"], "left_semi"), path, kind)
        sinks.back_up(path, "old")
        parts.append(spark.read.text(f"{path}.old").select(F.lit(kind).alias("kind"), F.col("value").alias("line")))
        parts.append(S.earlier_results(spark, f"{path}.old", kind).select(F.lit(f"{kind} done").alias("kind"), F.col("domain").alias("line")))
        left = sinks.to_do(spark, spark.createDataFrame([(_LAW,)], "domain string"), path, kind)
        parts.append(left.select(F.lit(f"{kind} after reset").alias("kind"), F.col("domain").alias("line")))
    return reduce(DataFrame.unionByName, parts)


def planned_requests(spark, sf_dir):
    """Requests of two runs: the second begins where the clocks of the first end."""
    urls = lambda *xs: spark.createDataFrame([(x,) for x in xs], "url string")
    first = frontier.pacing(urls("https://a.it/1", "https://www.a.it/2", "https://b.it/"), 900, headers='{"X-A": "1"}')
    second = frontier.pacing(urls("https://a.it/3", "https://c.it/"), 900, frontier.clock_after(first), headers="{bad")
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.select("run", "host", "url", "seq", "earliest_ms", F.to_json("headers").alias("headers"))


def streamed_addresses(spark, sf_dir):
    """Pages that arrive in two lots: each is taken in once, the second by a stream that is drained and ended."""
    folder, out, state = (S.work_folder(spark, n) for n in ("arrivals", "addresses", "stream"))
    pages = _pages(spark).filter("html is not null")
    pages.filter("page_id < 4").coalesce(1).write.parquet(folder)
    arrivals.append_addresses(arrivals.arriving_pages(spark, folder), out, state, once=True).awaitTermination()
    pages.filter("page_id >= 4").coalesce(1).write.mode("append").parquet(folder)
    arrivals.drain(arrivals.append_addresses(arrivals.arriving_pages(spark, folder), out, state))
    return spark.read.parquet(out).select("site", "page_id", "email")


_ALL = [
    captured_title_people, captured_heading_people, captured_dom_people, captured_jsonld_people, captured_card_links, captured_card_emails, captured_page_emails, captured_mail_links,
    captured_addresses, captured_companies, captured_links, captured_inner_links, captured_sitemap, captured_robots, captured_scores, captured_pages_chosen, owner_run, owner_run_rows,
    owner_run_evidence, crawl_run, crawl_order, answered_pages, answered_cards, suffix_rules, references, listed_domains, written_results, planned_requests, streamed_addresses,
]
QUERIES = {f.__name__: f for f in _ALL}
