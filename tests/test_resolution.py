"""Whole runs over small captured tables."""

import dataclasses

from pyspark.sql import functions as F

from sitewright.config import Config
from sitewright.functions import text as X
from sitewright.plans.resolution import Captured, chosen_pages, crawl_addresses, run_batch
from sitewright.sources import tables as S

PAGES = [
    (1, "https://acme.com", "<title>Zenith | Home</title><a href='/about-us'>a</a><a href='mailto:info@acme.com'>m</a>"),
    (2, "https://www.acme.com/team", "<h2>Founder: Anna Rossi</h2><a href='mailto:p.neri@acme.com'>m</a>"),
    (3, "https://acme.com/private", "<a href='mailto:never@acme.com'>m</a>"),
    (4, "https://acme.com/contact", "<p>Write to sales (at) acme (dot) com</p><a href='/deep'>d</a>"),
    (5, "https://acme.com/deep", "deep@acme.com <a href='/deeper'>x</a>"),
    (6, "https://acme.com/deeper", "deeper@acme.com"),
    (7, "https://beta.org/", "<title></title>"),
]


def captured(spark):
    return Captured(
        spark.createDataFrame(PAGES, "page_id long, url string, html string"),
        spark.createDataFrame([("acme.com",)], "domain string"),
        robots=spark.createDataFrame([("https://acme.com", "User-agent: *\nDisallow: /contact")], "origin string, txt string"),
    )


def test_batch_and_resume(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    first = S.one_domain(spark, "ACME.com", "acme.com", "beta.org")
    got = {r.site: r for r in run_batch(spark, captured(spark), first, out, "jsonl", log).collect()}
    assert (got["acme.com"].company, got["acme.com"].owner, got["acme.com"].email_origin) == ("Zenith", "Anna Rossi", "synthesized")
    assert (got["beta.org"].company, got["beta.org"].owner, got["beta.org"].email) == ("Beta", "", "")
    assert spark.read.json(out).count() == 2 and spark.read.json(log).count() >= 1
    again = run_batch(spark, captured(spark), S.one_domain(spark, "acme.com", "gamma.it"), out, "jsonl")
    assert spark.read.json(out).count() == 3
    assert {r.domain for r in spark.read.json(out).collect()} == {"acme.com", "beta.org", "gamma.it"} and again is not None


def test_chosen_pages(spark):
    sites = spark.createDataFrame([("acme.com", "acme")], "site string, root string")
    assert sorted(r.page_id for r in chosen_pages(captured(spark), sites, Config()).collect()) == [1, 2]
    open_ = dataclasses.replace(captured(spark), robots=None)
    assert sorted(r.page_id for r in chosen_pages(open_, sites, Config()).collect()) == [1, 2, 4]
    assert sorted(r.page_id for r in chosen_pages(open_, sites, dataclasses.replace(Config(), max_pages=40, extra_paths=("/private",))).collect()) == [1, 2, 3, 4]


def test_crawl(spark):
    got = {(r.domain, r.email) for r in crawl_addresses(captured(spark), spark.createDataFrame([("acme.com",), ("none.it",)], "domain string")).collect()}
    assert ("acme.com", "deep@acme.com") in got and ("acme.com", "deeper@acme.com") in got and ("acme.com", "sales@acme.com") in got
    assert ("none.it", "") in got and not any("never" in e for _, e in got)


def test_references_are_those_of_the_library(spark):
    import html
    import random

    rng = random.Random(3)
    bits = "&amp; &lt; &notit; &not &eacute; &Eacute &#64; &#x40; &#0064; &#150; &#0; &#13; &#1114112; &#xD800; &#x1F600; &#99999999999; &unknown; & &copyx &nbsp; &ThickSpace; &NotEqualTilde; &#; &#x; x é &#11; &#65534; &#x80 &amp;lt; &ampx; &#12a".split()
    texts = ["".join(rng.choice([*bits, " ", "\n"]) for _ in range(rng.randrange(1, 8))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "x string")
    for r in df.select("x", X.unescape(F.col("x")).alias("y")).collect():
        assert r.y == (None if r.x is None else html.unescape(r.x))


def test_attributes_in_any_form(spark):
    page = """<a class=x href=/one>1</a><A title="a > b" HREF = '/two?a=1&amp;b=2'>2</A><a name=q>3</a><abbr href=no><!-- <a href=c> --><script>"<a href=s>"</script><a data-href="n" href="">e</a>
    <a href="mailto:info&#64;x.it?subject=x"><meta content=Foo property="og:site_name"><meta itemprop=name content='B"r'>"""
    metas = X.tags(X.without_scripts(F.col("h")), "meta")
    r = spark.createDataFrame([(page,)], "h string").select(X.hrefs(F.col("h")).alias("a"), X.mail_links(F.col("h")).alias("m"), X.meta_content(metas, "property", "og:site_name").alias("s"), X.meta_content(metas, "itemprop", "name").alias("n"), X.meta_content(metas, "itemprop", "none").alias("z")).first()
    assert r.a == ["/one", "/two?a=1&b=2", "", "mailto:info@x.it?subject=x"] and r.m == ["info@x.it"] and (r.s, r.n, r.z) == ("Foo", 'B"r', None)


def test_written_out_addresses_equal_a_plain_search(spark):
    import random
    import re

    from sitewright.functions import emails as E

    rng = random.Random(5)
    bits = ["at", "@", "dot", ".", "(", "]", " ", "\n", "data", "table", "it", "a", "x-y", "[at]", "(dot)", "é", "%", "com", "@b.co", "+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for strict, pattern in ((False, E.OBFUSCATED), (True, E.STRICT_OBFUSCATED)):
        for r in df.select("x", E.obfuscated(F.col("x"), strict).alias("y")).collect():
            assert r.y == list(dict.fromkeys(f"{a}@{b}.{c}".lower() for a, b, c in re.findall(pattern, r.x, re.ASCII)))


def test_suffix_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// names\n\ncom\n*.ck  // any\n!www.ck\nco.uk\n")
    rules = S.suffix_file(spark, str(tmp_path / "list.dat"))
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.ck",), ("z.www.ck",), ("a.b.zz",)], "host string")
    assert {r.host: r.site for r in S.registrable(hosts, rules).collect()} == {"a.b.co.uk": "b.co.uk", "x.y.ck": "x.y.ck", "z.www.ck": "www.ck", "a.b.zz": "b.zz"}


def test_captured_answers(spark):
    df = spark.createDataFrame([(bytearray("é".encode()), "text/html"), (bytearray(b"\xe9abc"), "text/html; charset=ISO-8859-1"), (bytearray(b"\xff"), None)], "body binary, kind string")
    assert [r.x for r in df.select(S.decoded_body(F.col("body"), F.col("kind"), 3).alias("x")).collect()] == ["é", "éab", "�"]
    h = spark.createDataFrame([('{"a":"b"}',), ("bad",), (None,)], "x string")
    assert [r.x for r in h.select(S.header_options(F.col("x")).alias("x")).collect()] == [{"a": "b"}, {}, {}]
    t = spark.createDataFrame([(200, "text/vcard"), (404, "text/vcard"), (200, "text/html")], "s int, k string")
    assert [r.x for r in t.select(S.is_card(F.col("s"), F.col("k")).alias("x")).collect()] == [True, False, False]


def test_addresses_in_a_body_equal_a_plain_search(spark):
    import random
    import re

    from sitewright.functions import emails as E

    rng = random.Random(8)
    bits = ["a", "@", ".", "b.co", "x-y", "[at]", " [dot] ", "(AT)", " dot ", " at ", "&#64;", "%40", "&amp;", "%2e", "é", " ", "\n", "+", "_", "it", "com", "@@", "..", "-", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", E.in_body(F.col("x")).alias("y")).collect():
        plain = r.x
        for pattern, sign in E.DECODINGS:
            plain = re.sub(pattern, sign, plain, flags=re.ASCII)
        assert r.y == list(dict.fromkeys(re.findall(E.BODY, plain))), r
