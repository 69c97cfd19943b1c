"""Queries on small tables with odd values against their SQL in DuckDB."""

import duckdb

import __spark_entry__ as entry
from sitewright.operators import contacts as C

#: Titles as they are written, some cut within a reference, and the companies that they give.
TITLES = {
    "Legno &amp; Co | Home": "Legno & Co", "Legno&amp;&amp;&amp": "Legno&&&amp", "A &quot;B&quot": 'A "B&quot', "Cut &am": "Cut &am", "Sign &": "Sign &", "&amp;lt;b": "&lt;b",
    "&ampx y": "&ampx y", "A&lt;B&gt - x": "A<B&gt", "No &#39": "No &#39", "O&#39;Neil": "O'Neil", "&notit; z": "&notit; z", " a\n b&amp;\t": "a b&", "&amp": "&amp", " | x": None, "": None,
}


def both(spark, folder, name, pages):
    """Sorted rows of a query and of its SQL over pages (page_id, url, html)."""
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def test_answered_pages_keep_long_numbers(spark, tmp_path):
    firsts = [0, 79_992, 80_000, 7_999_992, 8_000_000, 8_000_000_000]
    got, want = both(spark, tmp_path, "answered_pages", [(n + k, "https://www.acme.com/", None) for n in firsts for k in range(8)])
    assert got == want and len(got) == 24
    html = {r[0]: r[2] for r in got}
    assert html[79_994] == "vecchia 9999" and html[80_002] == "vecchia 10000" and html[8_000_000] == "caffè 1000000" and html[8_000_000_007] == "€ 1000000000"
    assert html[1] == html[8_000_000_001] == "però tanto "


def titled():
    return [(k, f"https://www.s{k}.com/", f"<html><head><title>{t}</title></head></html>") for k, t in enumerate(TITLES)] + [(99, "https://no.org/", None)]


def test_companies_keep_references_that_were_cut(spark, tmp_path):
    got, want = both(spark, tmp_path, "page_company", titled())
    assert got == want and [c for _, _, c in sorted(got, key=lambda r: r[1])] == [c for c in TITLES.values() if c]
    for name in ("site_company", "csv_rows"):
        got, want = both(spark, tmp_path / name, name, titled())
        assert got == want and len(got) == len(TITLES) + 1


def test_companies_by_the_rules_of_html(spark):
    pages = spark.createDataFrame([(1, "a.it", "<title>Legno &amp</title>"), (2, "a.it", "<title>&notit; z</title>")], "page_id long, site string, html string")
    assert sorted(r.company for r in C.page_company(pages).collect()) == ["Legno &", "¬it; z"]


def test_quoted_titles_keep_references_that_were_cut(spark, tmp_path):
    got, want = both(spark, tmp_path, "quoted_titles", titled())
    assert got == want and [f for _, f in got] == ['"' + c.replace('"', '""') + '"' for c in TITLES.values() if c]
