"""Golden cases of the column expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitewright.functions import emails as E
from sitewright.functions import names as N
from sitewright.functions import text as X
from sitewright.functions import urls as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def each(spark, make, inputs):
    df = spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(inputs)], "k int, a string" + (", b string" if isinstance(inputs[0], tuple) else "") + (", c string" if isinstance(inputs[0], tuple) and len(inputs[0]) > 2 else ""))
    return [r.x for r in df.select("k", make(*[F.col(c) for c in df.columns[1:]]).alias("x")).orderBy("k").collect()]


def test_hosts_and_lines(spark):
    assert each(spark, U.clean_host, ["https://www.Shop.Example.com/x?y", "example.com", "http://u:p@a.b:80/c", "HTTP://X.org"]) == ["shop.example.com", "example.com", "a.b", "x.org"]
    assert each(spark, U.domain_line, ["https://www.Shop.Example.com/x # c", "localhost", "not a domain", "# only", "a.it"]) == ["shop.example.com", None, None, None, "a.it"]
    assert each(spark, U.shell_line, ["https://www.Shop.Example.com/x", "  WWW.a.b  tail", "nodot", "a.b#c"]) == ["shop.example.com/x", "a.b", None, "a.b"]
    assert each(spark, U.net_location, ["https://www.A.com:8080/x", "b.org/y", "c.net"]) == ["a.com:8080", "b.org", "c.net"]


def test_links(spark):
    cases = {
        ("https://h/a/", "#x"): None, ("https://h/a/", "mailto:a@b"): None, ("https://h/a/", "b#f"): "https://h/a/b", ("https://h/a/c", "b"): "https://h/a/b",
        ("https://h/a", "//o/x"): "https://o/x", ("http://h/a?q", "/r?s"): "http://h/r?s", ("https://h/a/b/c", "../d"): "https://h/a/d", ("https://h/a/b", "./d/./e"): "https://h/a/d/e",
        ("https://h", "x"): "https://h/x", ("https://h/a", "ftp://z"): None, ("https://h/a?q=1", "?p=2"): "https://h/a?p=2", ("https://h/a/", "javascript:x()"): None, ("https://h/a/", ""): None,
    }
    assert each(spark, U.resolve_link, list(cases)) == list(cases.values())


def test_scope(spark):
    assert each(spark, U.in_scope, [("mail.acme.com", "acme.com"), ("notacme.com", "acme.com"), ("acme.com", "acme.com")]) == [True, False, True]
    assert each(spark, U.hint_score, ["https://x/contact-about", "https://x/"]) == [2, 0]


def test_emails(spark):
    assert each(spark, E.direct, ["Write ANN@Shop.it, or bob@x.co.uk.", "none"]) == [["ann@shop.it", "bob@x.co.uk"], []]
    assert each(spark, E.obfuscated, ["ann (at) shop (dot) it", "data.table", "me@x.com. Thanks"]) == [["ann@shop.it"], ["d@a.table"], ["me@x.com.thanks"]]
    assert each(spark, lambda x: E.obfuscated(x, strict=True), ["ann (at) shop (dot) it", "data.table", "ann at shop dot it"]) == [["ann@shop.it"], [], ["ann@shop.it"]]
    assert each(spark, E.in_body, ["a&#64;b.it c [at] d [dot] org e%40f%2ecom"]) == [["a@b.it", "c@d.org", "e@f.com"]]
    assert each(spark, E.rank, ["ceo@x.it", "anna.rossi@x.it", "a1-b@x.it", "thedirector@x.it", "info@x.it", "bob@x.it"]) == [6, 5, 4, 3, 2, 1]


@pytest.mark.parametrize("pattern,local", [("f.l", "anna.rossi"), ("fl", "annarossi"), ("f_l", "anna_rossi"), ("f-l", "anna-rossi"), ("f0l", "arossi"), ("l", "rossi"), ("f", "anna")])
def test_written_locals(spark, pattern, local):
    assert one(spark, E.write_local(F.lit(pattern), F.lit("anna"), F.lit("rossi"))) == local


def test_names(spark):
    yes = [("Anna", "Rossi"), ("Jürgen", "Müller"), ("Manager", "John")]
    no = [("John", "Williams"), ("Mark", "Fleming"), ("ANNA", "Rossi"), ("Our", "Approach"), ("Li", "Wu"), ("Lynn", "Byrd"), ("Élodie", "Roche"), ("", "Rossi"), ("Low", "Cost")]
    assert each(spark, N.is_human_name, yes + no) == [True] * len(yes) + [False] * len(no)
    assert each(spark, N.looks_like_company, [("Anna Rossi", "Rossi Studio", "acme"), ("Anna Rossi", "Acme", "acme"), ("Anna Acme", "Zed", "acme"), ("", "Acme", "acme"), ("Team Rossi", "Acme", "acme")]) == [True, False, True, False, True]


def test_text(spark):
    assert each(spark, X.company_name, ["Acme Srl | Home", "Coca-Cola", "A — B"]) == ["Acme Srl", "Coca", "A"]
    assert each(spark, X.csv_field, ['He said "hi"\nthere', None, " a "]) == ['"He said ""hi"" there"', '""', '"a"']
    assert each(spark, X.fold, ["Müller", "Élodie", "O'Neil", "ß"]) == ["muller", "elodie", "oneil", ""]
    assert each(spark, X.visible_text, ['<p>a</p><script>var t="</p>";</script><!-- x --><b>c'])== ["a c"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abW.:/# -é", max_size=20), min_size=1, max_size=6))
def test_domain_line_is_idempotent(spark, lines):
    once = each(spark, U.domain_line, lines)
    kept = [x for x in once if x]
    assert not kept or each(spark, U.domain_line, kept) == kept
