"""python -m sitewright resolve|emails|reset: runs over captured tables."""

from __future__ import annotations

import argparse
import dataclasses
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import Config
from sitewright.functions.text import csv_field
from sitewright.operators import contacts as C
from sitewright.operators import frontier, sinks, state
from sitewright.plans.resolution import Captured, crawl_addresses, run_batch, run_committed
from sitewright.sources import tables as S


def main() -> None:
    p = argparse.ArgumentParser(prog="sitewright")
    p.add_argument("what", choices=["resolve", "emails", "plan", "reset"])
    p.add_argument("--domain", action="append", default=[])
    p.add_argument("--file", help="a list of domains")
    p.add_argument("--pages", help="captured pages: page_id, url, html")
    p.add_argument("--answers", help="captured answers, in place of pages: page_id, url, status, content_type, body, etag")
    p.add_argument("--cache", help="bodies for answers of status 304: url_sha, body, etag")
    p.add_argument("--suffixes", help="a file in the form of the public suffix list")
    p.add_argument("--agent", default=Config.agent, help="the name by which robots.txt addresses this engine")
    p.add_argument("--headers", default="", help="more request headers for the plan, as JSON")
    p.add_argument("--no-headers", action="store_true", help="printed lines without a header")
    p.add_argument("--json", action="store_true", help="with one domain and without --out: a JSON object instead of a quoted line")
    p.add_argument("--mx", help="domains that take mail: domain")
    p.add_argument("--sitemaps", help="captured sitemaps: site, xml")
    p.add_argument("--robots", help="captured robots.txt: origin, txt")
    p.add_argument("--cards", help="captured contact cards: url, body")
    p.add_argument("--out", default="", help="where results go; without it they are printed")
    p.add_argument("--format", default="")
    p.add_argument("--evidence", default="")
    p.add_argument("--state", default="", help="with resolve: a folder that results, evidence and marks are committed to as one; with reset: the state that begins anew")
    p.add_argument("--plain-evidence", action="store_true")
    p.add_argument("--max-pages", type=int, default=Config.max_pages)
    p.add_argument("--paths", default="")
    p.add_argument("--no-sitemap", action="store_true")
    p.add_argument("--not-strict", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName("sitewright").getOrCreate()
    if a.what == "reset" and a.state:
        print(f"the state before is version {state.reset(spark, a.state)}")
        return
    if a.what == "reset":
        sinks.back_up(a.out, time.strftime("%Y%m%d-%H%M%S"))
        return
    config = dataclasses.replace(Config(), max_pages=a.max_pages, extra_paths=tuple(x for x in a.paths.split(",") if x), sitemap=not a.no_sitemap, strict=not a.not_strict, hash_evidence=not a.plain_evidence, agent=a.agent, headers=a.headers)
    read = lambda path: spark.read.parquet(path) if path else None
    mx = read(a.mx) if a.mx else spark.createDataFrame([], "domain string")
    answers = read(a.answers)
    pages = S.answer_pages(answers, config.body_limit, read(a.cache)) if answers is not None else read(a.pages)
    cards = S.card_bodies(answers, config.body_limit) if answers is not None and not a.cards else read(a.cards)
    captured = Captured(pages, mx, read(a.sitemaps), read(a.robots), cards, S.suffix_file(spark, a.suffixes) if a.suffixes else None)
    domains = S.domain_list(spark, a.file) if a.file else S.one_domain(spark, *a.domain)
    kind = a.format or spark.range(1).select(sinks.format_of(F.lit(a.out))).first()[0]
    if a.what == "plan":
        sites = C.first_of_each(domains).select(F.lower("domain").alias("site"))
        planned = frontier.pacing(frontier.seeds(sites, extra=config.extra_paths).select("url"), config.rate_ms, headers=config.headers)
        _out(planned.withColumn("headers", F.to_json("headers")).orderBy("host", "seq"), a.out)
    elif a.what == "resolve":
        if a.state:
            records = run_committed(spark, captured, domains, a.state, config)
        else:
            records = run_batch(spark, captured, domains, a.out, kind, a.evidence, config)
        if not a.out:
            if not a.json and not a.no_headers:
                print('"company","owner","email"')
            for r in (C.json_rows(records) if a.json else C.csv_rows(records)).orderBy("site").toLocalIterator():
                print(r["row"])
    else:
        _out(crawl_addresses(captured, domains, config).orderBy("domain", "email"), a.out)


def _out(rows: DataFrame, path: str) -> None:
    """Rows in their order, as quoted lines with a header: to files, or printed."""
    if path:
        rows.write.mode("overwrite").option("quoteAll", True).option("header", True).csv(path)
        return
    print(",".join(f'"{c}"' for c in rows.columns))
    for r in rows.select(F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in rows.columns]).alias("row")).toLocalIterator():
        print(r["row"])


if __name__ == "__main__":
    main()
