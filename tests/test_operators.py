"""Operators on small pages, and the queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitewright.config import PATHS, Config
from sitewright.operators import contacts as C
from sitewright.operators import dom, frontier, sinks
from sitewright.plans import captured, captured_sql, oracle, queries
from sitewright.sources import tables as S
from sitewright.streaming.arrivals import append_addresses, append_new_addresses, arriving_pages
from tests import captured_crawl, captured_rows

SF = "/root/testdata/sf0.001"
PAGES = [
    (1, "https://www.acme.com/", '<title>Acme Srl | Home</title><a href="mailto:Anna.Rossi@acme.com?subject=x">m</a><a href="/card.vcf">v</a><h1>Marco Bianchi, CEO</h1><p>Owner of all: x. Founder here is Luisa Verdina today.</p>'),
    (2, "https://acme.com/team", '<div class="team-member h-card"><span class="p-name">Paola Neri</span><span class="role">Director</span></div><script>var a="zed@acme.com"</script>info [at] acme [dot] com'),
    (3, "https://beta.co.uk/", '<meta property="og:site_name" content="Beta Ltd"><script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Beta","founder":[{"name":"Dora Lanza","jobTitle":"Founder"}]},null,{"@type":["Person"],"name":"Ugo Foscolo"}]}</script><script type="application/ld+json">{bad</script><a href="https://notbeta.co.uk/about">o</a><a href="/about?x#y">a</a>'),
    (4, "https://gamma.it/x", ""),
    (5, "https://gamma.it/y", None),
    (6, "https://delta.org/", "<title></title>Owner Manager John Smitta. Titolare Nicolo Verdi"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", S.clean_host(F.col("url")))
    return S.registrable(rows, S.suffix_table(spark)).cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sites(pages):
    assert rows(pages.select("site", "root").distinct(), "site", "root") == [("acme.com", "acme"), ("beta.co.uk", "beta"), ("delta.org", "delta"), ("gamma.it", "gamma")]


def test_page_emails(pages):
    assert rows(C.page_emails(pages), "page_id", "email") == [(1, "Anna.Rossi@acme.com"), (1, "Anna.Rossi@acme.com"), (2, "info@acme.com"), (2, "zed@acme.com")]
    assert rows(C.page_emails(pages, "as_written"), "page_id", "email") == [(1, "Anna.Rossi@acme.com")]
    assert (2, "zed@acme.com") in rows(C.all_addresses(pages, strict=True), "page_id", "email")


def test_people(pages):
    assert rows(C.title_people(pages), "title", "first", "last") == [("Founder", "here", "is"), ("Owner", "Manager", "John"), ("Titolare", "Nicolo", "Verdi")]
    assert rows(C.heading_people(pages), "title", "first", "last") == [("Marco Bianchi, CEO", "Marco", "Bianchi")]
    found = rows(dom.dom_people(pages), "channel_ord", "title", "first", "last", "weight")
    assert (1, "Founder", "Dora", "Lanza", 3) in found and (1, "Person", "Ugo", "Foscolo", 1) in found and (2, "Director", "Paola", "Neri", 3) in found


def test_scores(spark):
    hits = [("a.it", 0, 1, 0, "Director", "Anna", "Rossi", 4), ("a.it", 1, 1, 0, "Managing Director", "anna", "rossi", 3), ("a.it", 1, 2, 0, "", "Anna", "Rossi", 1), ("b.it", 1, 1, 0, "Person", "Ugo", "Verdi", 1), ("c.it", 1, 1, 0, "CEO", "Bo", "Zanna", 1), ("c.it", 1, 2, 0, "CEO", "Al", "Zanna", 1)]
    scored = C.score_people(spark.createDataFrame(hits, "site string, channel_ord int, page_id long, hit_ord int, title string, first string, last string, weight int"))
    assert rows(scored, "site", "name_key", "weight", "title") == [("a.it", "anna rossi", 8, "Director"), ("b.it", "ugo verdi", 1, "Person"), ("c.it", "al zanna", 4, "CEO"), ("c.it", "bo zanna", 4, "CEO")]
    assert rows(C.pick_owner(scored), "site", "first") == [("a.it", "Anna"), ("c.it", "Al")]
    assert rows(C.pick_owner(scored, "UNICODE"), "site", "first") == [("a.it", "Anna"), ("c.it", "Al")]


def test_patterns(spark):
    cases = {"one": ["info"], "two": ["bob"], "three": ["anna.rossi"], "four": ["anna.rossi", "info"], "five": ["a-rossi"], "six": ["a_rossi"], "seven": ["j2"]}
    df = spark.createDataFrame([(s, f"{x}@{s}.it") for s, xs in cases.items() for x in xs], "site string, email string")
    assert {r.site: r.pattern for r in C.infer_patterns(df).collect()} == {"one": "fl", "two": "fl", "three": "f.l", "four": "fl", "five": "f-l", "six": "f_l", "seven": "f0l"}
    best = spark.createDataFrame([("x", f"{e}@x.it") for e in ("info", "anna.rossi", "ceo")] + [("y", "noreply@y.it"), ("y", "info@y.it")], "site string, email string")
    assert rows(C.best_email(best), "site", "email") == [("x", "ceo@x.it"), ("y", "info@y.it")]


def test_companies(pages):
    assert dict(rows(C.site_company(pages), "site", "company")) == {"acme.com": "Acme Srl", "beta.co.uk": "Beta Ltd", "delta.org": "Delta", "gamma.it": "Gamma"}


def test_resolution(spark):
    companies = spark.createDataFrame([(s, s.split(".")[0], c) for s, c in (("qqa.it", "Acme"), ("qqb.it", "Rossi Studio"), ("qqc.it", "Ceta"), ("qqd.it", "Deta"))], "site string, root string, company string")
    owners = spark.createDataFrame([("qqa.it", "Annà", "Verdi"), ("qqb.it", "Ugo", "Rossi"), ("qqc.it", "Olga", "Neri")], "site string, first string, last string")
    mails = spark.createDataFrame([("qqa.it", "x.y@qqa.it"), ("qqb.it", "info@qqb.it"), ("qqd.it", "info@qqd.it")], "site string, email string")
    mx = spark.createDataFrame([("qqa.it",), ("qqb.it",), ("qqc.it",)], "domain string")
    got = rows(C.resolve(companies, owners, mails, mx), "site", "owner", "email", "email_origin")
    assert got == [("qqa.it", "Annà Verdi", "anna.verdi@qqa.it", "synthesized"), ("qqb.it", "", "info@qqb.it", "observed"), ("qqc.it", "Olga Neri", "", "none"), ("qqd.it", "", "", "none")]


def test_frontier(spark, pages):
    sites = pages.select("site").distinct()
    seeds = frontier.seeds(sites, extra=("/extra",))
    assert seeds.count() == 4 * (len(PATHS) + 1)
    found = frontier.links(pages)
    inner = frontier.inner_links(found)
    assert rows(inner, "site", "url") == [("beta.co.uk", "https://beta.co.uk/about")]
    for k in (16, 40):
        cut = frontier.budget([seeds, inner], k)
        assert all(r["count"] <= k for r in cut.groupBy("site").count().collect())
        assert cut.filter("src_rank = 1").count() == 0
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "d"), ("s", "b", "a"), ("s", "a", "contact")], "site string, src string, url string")
    got = frontier.breadth_first(spark.createDataFrame([("s", "a", 0)], "site string, url string, ord int"), edges, 2, 3)
    assert rows(got, "place", "url", "depth") == [(1, "a", 0), (2, "contact", 1), (3, "b", 1)]


def test_robots(spark):
    txt = "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y$\nDisallow:\n\nUser-agent: b\nDisallow: /"
    rules = S.robot_rules(spark.createDataFrame([("https://h", txt)], "origin string, txt string"))
    urls = spark.createDataFrame([("https://h/x",), ("https://h/x/y",), ("https://h/x/yz",), ("https://h/z",), ("https://o/x",)], "url string")
    assert dict(rows(frontier.allowed(urls, rules), "url", "allowed")) == {"https://h/x": False, "https://h/x/y": True, "https://h/x/yz": False, "https://h/z": True, "https://o/x": True}
    assert S.robot_rules(spark.createDataFrame([("https://h", txt)], "origin string, txt string"), "b").collect() == [("https://h", "/", False)]


def test_sitemaps_and_cards(spark, pages):
    maps = spark.createDataFrame([("a.it", "<LOC> https://a.it/team/ </LOC><loc>https://nota.it/</loc><loc>https://www.a.it/z.html</loc><loc>https://a.it/q</loc>")], "site string, xml string")
    urls = S.sitemap_urls(maps)
    assert rows(frontier.top_sitemap(urls, 8), "rank", "url") == [(1, "https://a.it/team/"), (2, "https://www.a.it/z.html")]
    assert rows(frontier.hinted_sitemap(urls, 1), "url") == [("https://a.it/team/",)]
    cards = C.card_links(pages)
    assert rows(cards, "url") == [("https://acme.com/card.vcf",)]
    bodies = spark.createDataFrame([("https://acme.com/card.vcf", "EMAIL:boss@acme.com\nEMAIL:x@other.com")], "url string, body string")
    assert rows(C.card_emails(cards, bodies), "email") == [("boss@acme.com",)]


def test_lists_and_sinks(spark, tmp_path, pages):
    path = tmp_path / "domains.txt"
    path.write_text("https://www.A.it/x # note\r\nb.org\nB.org\nbad line\n#c\n")
    assert [r[0] for r in rows(C.first_of_each(S.domain_list(spark, str(path))), "domain")] == ["a.it", "b.org"]
    assert S.one_domain(spark, "x.it", " ").count() == 1
    assert rows(S.processed_list(spark, str(path)), "domain") == [("a.it/x",), ("b.org",)]
    results = spark.createDataFrame([("a.it", 'A "q"\nx', "", None), ("b.org", "B", "C D", "c@b.org")], "site string, company string, owner string, email string")
    for kind in ("csv", "tsv", "jsonl"):
        out = str(tmp_path / kind)
        todo = spark.createDataFrame([("a.it",), ("z.it",)], "domain string")
        assert sinks.to_do(spark, todo, out, kind).count() == 2
        sinks.write_results(results, out, kind)
        assert rows(S.earlier_results(spark, out, kind), "domain") == [("a.it",), ("b.org",)]
        assert rows(sinks.to_do(spark, todo, out, kind), "domain") == [("z.it",)]
    sinks.back_up(str(tmp_path / "csv"), "old")
    assert not (tmp_path / "csv").exists() and (tmp_path / "csv.old").exists()
    sinks.write_results(results, "")
    assert rows(C.csv_rows(results), "row") == [('"A ""q"" x","",""',), ('"B","C D","c@b.org"',)]
    found = C.page_emails(pages).select("site", "email")
    log = C.evidence(pages, found, C.best_email(found)).collect()
    assert all(len(x) == 64 for r in log for x in r.emailsFound) and all(len(p.u) == 64 for r in log for p in r.pages) and {r.domain for r in log} == {"acme.com", "beta.co.uk", "delta.org", "gamma.it"}


def test_pending_and_sentinel(spark):
    d = spark.createDataFrame([("a",), ("b",)], "domain string")
    assert rows(C.pending(d, spark.createDataFrame([("a",), ("a",)], "domain string")), "domain") == [("b",)]
    assert rows(C.with_sentinel(d, spark.createDataFrame([("b", "x@b")], "domain string, email string")), "domain", "email") == [("a", ""), ("b", "x@b")]


def test_streaming(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    page = lambda k: spark.createDataFrame([(k, "https://a.it/", f"m{k}@a.it")], "page_id long, url string, html string").coalesce(1)
    page(1).write.mode("append").parquet(folder)
    for k in (2, 3):
        append_addresses(arriving_pages(spark, folder), out, str(tmp_path / "state"), once=True).awaitTermination()
        page(k).write.mode("append").parquet(folder)
    append_addresses(arriving_pages(spark, folder), out, str(tmp_path / "state"), once=True).awaitTermination()
    assert rows(spark.read.parquet(out), "email") == [("m1@a.it",), ("m2@a.it",), ("m3@a.it",)]


def test_streamed_addresses_pass_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    page = lambda k, html: spark.createDataFrame([(k, "https://a.it/", html)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(folder)
    for k, html in enumerate(["x@a.it", "x@a.it y@a.it", "Y@a.it", None]):
        page(k, html)
        append_new_addresses(arriving_pages(spark, folder), out, str(tmp_path / "state"), once=True).awaitTermination()
    assert rows(spark.read.parquet(out), "site", "email") == [("a.it", "x@a.it"), ("a.it", "y@a.it")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame, columns):
    def cell(v):
        if v is None or v != v:
            return ""
        return str(v) if isinstance(v, str) else str(int(v))

    return sorted(tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(captured_rows.SQL))
def test_small_crawl_gives_what_was_written_down(spark, duck, name):
    got, want = captured_crawl.QUERIES[name](spark, SF).toPandas(), duck.execute(captured_rows.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(captured_sql.SQL))
def test_query_over_the_crawl_of_given_pages_equals_sql(spark, duck, name):
    got, want = captured.QUERIES[name](spark, SF).toPandas(), duck.execute(captured_sql.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert Config(max_pages=1).page_budget() == 3


def test_partitions_do_not_matter(spark):
    for name in ("human_names", "frontier_budget", "owner_pick"):
        once = sorted(map(str, queries.QUERIES[name](spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert sorted(map(str, queries.QUERIES[name](spark, SF).collect())) == once
        spark.conf.set("spark.sql.shuffle.partitions", "4")
