"""Runs committed as one, the cache that they leave, resets, robots in normal form, charsets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitewright.functions import charsets
from sitewright.functions.urls import normal_url
from sitewright.operators import state
from sitewright.operators.robots import _fits, allowed
from sitewright.plans import resolution as R
from sitewright.sources import tables as S
from tests.test_resolution import captured


def lines(spark, root, at=None):
    return sorted(r.site for r in state.read(spark, root, "results", R.RESULTS, at).collect())


def test_a_run_that_ends_between_the_sinks_is_done_anew(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    first, both = S.one_domain(spark, "acme.com"), S.one_domain(spark, "ACME.com", "acme.com", "beta.org")
    assert [r.site for r in R.run_committed(spark, captured(spark), first, root).collect()] == ["acme.com"]
    for kind in ("evidence", "marks"):
        write = state.Run.write

        def broken(self, k, table, kind=kind, write=write):
            if k == kind:
                raise OSError("killed")
            return write(self, k, table)

        with monkeypatch.context() as m:
            m.setattr(state.Run, "write", broken)
            with pytest.raises(OSError):
                R.run_committed(spark, captured(spark), both, root)
        assert lines(spark, root) == ["acme.com"] and state.version(spark, root) == 1
    with monkeypatch.context() as m:
        m.setattr(state.Run, "commit", lambda self: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            R.run_committed(spark, captured(spark), both, root)
    assert [r.site for r in R.run_committed(spark, captured(spark), both, root).collect()] == ["beta.org"]
    assert lines(spark, root) == ["acme.com", "beta.org"]
    assert sorted(r.domain for r in state.read(spark, root, "evidence", "domain string").collect()) == ["acme.com", "beta.org"]
    assert sorted(r.domain for r in state.read(spark, root, "marks", R.MARKS).collect()) == ["acme.com", "beta.org"]
    assert R.run_committed(spark, captured(spark), both, root).count() == 0 and lines(spark, root) == ["acme.com", "beta.org"]


def test_reset_is_one_step_and_keeps_what_was_there(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    assert state.version(spark, root) == 0 and lines(spark, root) == []
    R.run_committed(spark, captured(spark), S.one_domain(spark, "beta.org"), root)
    before = state.reset(spark, root)
    assert lines(spark, root) == [] and lines(spark, root, before) == ["beta.org"] and state.paths(spark, root, "marks") == []
    R.run_committed(spark, captured(spark), S.one_domain(spark, "beta.org"), root)
    assert lines(spark, root) == ["beta.org"]


def test_two_runs_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    one, two = state.Run(spark, root), state.Run(spark, root)
    for run in (one, two):
        run.write("marks", spark.createDataFrame([(run.id,)], "domain string"))
    one.commit()
    with pytest.raises(state.CommitConflict):
        two.commit()
    assert [r.domain for r in state.read(spark, root, "marks", R.MARKS).collect()] == [one.id]


ANSWER = "url string, status int, content_type string, etag string, last_modified string, fetched_at timestamp, body binary"


def answers(spark, *rows):
    return spark.createDataFrame([(u, s, "text/html; charset=windows-1252", tag, None, dt.datetime(2024, 1, day), None if body is None else bytearray(body)) for u, s, tag, day, body in rows], ANSWER)


def test_the_cache_of_one_run_answers_the_next(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    run = state.Run(spark, root)
    state.merge_cache(run, answers(spark, ("https://a.it/", 200, "t1", 1, b"old"), ("https://a.it/", 200, "t2", 2, b"caff\xe8 \x80"), ("https://b.it/", 404, "x", 1, b"no"), ("https://c.it/", 200, None, 1, b"c"), ("https://d.it/", 200, "n", 1, None)))
    assert state.cached(spark, root).count() == 0
    run.commit()
    assert sorted((r.url, r.etag) for r in state.cached(spark, root).collect()) == [("https://a.it/", "t2"), ("https://c.it/", None)]
    urls = spark.createDataFrame([("https://a.it/",), ("https://c.it/",), ("https://e.it/",)], "url string")
    assert {r.url: r.headers for r in state.conditional_headers(urls, state.cached(spark, root)).collect()} == {"https://a.it/": {"If-None-Match": "t2"}, "https://c.it/": {}, "https://e.it/": {}}
    second = answers(spark, ("https://a.it/", 304, None, 3, None), ("https://e.it/", 304, None, 3, None), ("https://c.it/", 200, "new", 3, b"c2")).withColumn("page_id", F.monotonically_increasing_id())
    pages = S.answer_pages(second, 100, state.cached(spark, root))
    assert sorted((r.url, r.html) for r in pages.collect()) == [("https://a.it/", "caffè €"), ("https://c.it/", "c2")]
    run = state.Run(spark, root)
    state.merge_cache(run, second.drop("page_id"))
    run.commit()
    assert sorted((r.url, bytes(r.body)) for r in state.cached(spark, root).collect()) == [("https://a.it/", b"caff\xe8 \x80"), ("https://c.it/", b"c2")]
    assert sorted((r.url, bytes(r.body)) for r in state.cached(spark, root, 1).collect()) == [("https://a.it/", b"caff\xe8 \x80"), ("https://c.it/", b"c")]
    run = state.Run(spark, root)
    state.merge_cache(run, answers(spark, ("https://c.it/", 200, "late", 1, b"older than what is there")))
    run.commit()
    assert sorted(bytes(r.body) for r in state.cached(spark, root).collect()) == [b"c2", b"caff\xe8 \x80"]


def test_robots_compare_normal_forms(spark):
    rules = [("https://a.it", "/a%20b", False), ("https://A.it:443", "/caf%C3%A9", False), ("https://a.it", "/x/*/y$", False), ("https://a.it", "/x/1/", True), ("https://a.it", "*.pdf$", False), ("https://a.it", "/%7eme", False), ("https://a.it", "/q%2A", False), ("https://a.it", None, False)]
    cases = {
        "https://a.it/a b": False, "https://A.it/a%20b": False, "https://a.it/café": False, "https://a.it/caf%c3%a9/x": False, "https://a.it/x/2/y": False, "https://a.it/x/2/yz": True, "https://a.it/x/1/z": True,
        "https://a.it/x/1/y": False, "https://u:p@a.it/z/../a b?q": False, "https://a.it/d.pdf": False, "https://a.it/d.pdf?x": True, "https://a.it/~me": False, "HTTPS://a.it:443/%7Eme": False, "http://a.it/a b": True,
        "nonsense": True, "https://b.it/a b": True, "https://a.it/q*": True, "https://a.it/q%2a1": False, "https://a.it": True,
    }
    urls = spark.createDataFrame([(u, "x") for u in [*cases, None]], "url string, origin string")
    got = allowed(urls, spark.createDataFrame(rules, "origin string, rule string, allow boolean"))
    assert got.columns == ["url", "origin", "allowed"] and {r.url: r.allowed for r in got.collect()} == cases | {None: True}
    assert normal_and(spark, "HTTP://U@Ex.it:80\\a/./b/../c%2fd?x y#z") == "http://ex.it/a/c%2Fd?x%20y"


def normal_and(spark, url):
    return spark.createDataFrame([(url,)], "u string").select(normal_url(F.col("u")).alias("u")).first().u


def test_robots_equal_a_plain_search(spark, rng_rules):
    import re

    rules, paths = rng_rules
    urls = spark.createDataFrame([(f"https://{o}{p}", o, p) for o in ("a.it", "b.it") for p in paths], "url string, o string, p string")
    got = allowed(urls, spark.createDataFrame([(f"https://{o}", r, a) for o, r, a in rules], "origin string, rule string, allow boolean")).collect()
    for x in got:
        fit = [(len(r), a) for o, r, a in rules if o == x.o and re.match("^" + re.escape(r.removesuffix("$")).replace(r"\*", ".*") + ("$" if r.endswith("$") else ""), x.p)]
        assert x.allowed == (max(fit)[1] if fit else True), x


@pytest.fixture()
def rng_rules():
    import random

    rng = random.Random(9)
    some = lambda n, signs: "".join(rng.choice(signs) for _ in range(rng.randrange(n)))
    return [(rng.choice(["a.it", "b.it"]), "/" + some(5, "ab/*") + rng.choice(["", "", "$"]), rng.random() < 0.5) for _ in range(60)], sorted({"/" + some(8, "ab/") for _ in range(300)} - {"/"})


def test_fits():
    assert _fits(["/a"], False, "/abc") and not _fits(["/a"], True, "/abc") and _fits(["/a", "c"], True, "/abc") and not _fits(["/ab", "b"], True, "/ab") and _fits(["/a", "", "c"], False, "/abcd")


def test_charsets(spark):
    import codecs

    text = {"cp1252": "caffè € “x”", "iso8859-2": "zażółć gęślą", "cp1251": "Привет", "koi8-r": "Привет", "iso8859-7": "αβγ", "cp1255": "שלום", "gb18030": "中文", "big5": "中文", "euc-jp": "日本", "cp932": "日本", "cp949": "한국", "utf-16": "é日", "utf-16-be": "é", "latin-1": "é\x80", "ascii": "abc"}
    rows = [(bytearray(x.encode(t)), name, x) for t, x in text.items() for name in (charsets.SINGLE | charsets.MULTIPLE)[t].split()]
    rows += [(bytearray("é€".encode()), n, "é€") for n in (None, "utf-8", "unheard-of", " UTF8 ")] + [(bytearray(b"\xff"), None, "�"), (None, "cp1252", None), (None, "gbk", None), (bytearray(codecs.BOM_UTF8 + b"x"), "utf-8", "x"), (bytearray(b"\x81"), "windows-1252", "\x81"), (bytearray(b"\xff"), "gbk", "�")]
    df = spark.createDataFrame([(b, n and n.upper(), x) for b, n, x in rows], "b binary, n string, x string")
    for r in df.select("n", "x", charsets.decode_bytes(F.col("b"), F.col("n")).alias("y")).collect():
        assert r.y == r.x, r
    back = spark.createDataFrame([("Привет é",)], "t string").select(charsets.encode_text(F.col("t"), "cp1251").alias("b")).first()
    assert bytes(back.b) == "Привет ?".encode("cp1251")
