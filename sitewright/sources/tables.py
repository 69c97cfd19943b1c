"""Captured pages and lists as DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import ANY_NAME, EXCEPTIONS, SECOND_LEVEL
from sitewright.functions.charsets import decode_bytes
from sitewright.functions.urls import clean_host, domain_line, host_suffixes, in_scope, shell_line

#: Rules of a public suffix list; the whole list has some ten thousand.
MOST_RULES = 100_000
ROBOT_LINE = r"(?i)^[ \t]*(user-agent|allow|disallow)[ \t]*:[ \t]*([^#]*)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """domain, line_no of a text file's lines that are domain names, in the file's order within each of its parts."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))
    return lines.select("line_no", domain_line(F.col("line")).alias("domain")).filter(F.col("domain").isNotNull())


def one_domain(spark: SparkSession, *domains: str) -> DataFrame:
    """The domains given by name; blank ones are left out."""
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(domains)], "line_no long, line string")
    return rows.select("line_no", domain_line(F.trim("line")).alias("domain")).filter(F.col("domain").isNotNull())


def processed_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct domains of a list of those done, in the looser form."""
    return spark.read.text(path).select(shell_line(F.col("value")).alias("domain")).filter(F.col("domain").isNotNull()).distinct()


def earlier_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Domains in results written before, in any of the formats; lines that can't be read are skipped."""
    schema = "domain string, company string, owner string, email string"
    if kind == "jsonl":
        found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    else:
        found = spark.read.schema(schema).option("quote", '"').option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return found.select(F.lower("domain").alias("domain")).filter(F.col("domain").isNotNull() & (F.col("domain") != "domain")).distinct()


def suffix_table(spark: SparkSession) -> DataFrame:
    """suffix: the rules of config, as the public suffix list writes them: names, *.names and !exceptions."""
    rules = [f"{name}.{country}" for country, names in SECOND_LEVEL.items() for name in names.split()]
    return spark.createDataFrame([(s,) for s in [*rules, *ANY_NAME, *EXCEPTIONS]], "suffix string")


def suffix_file(spark: SparkSession, path: str) -> DataFrame:
    """suffix: the rules of a file in the form of the public suffix list; comments and blank lines are left out."""
    rule = F.regexp_extract("value", r"^(\S+)", 1)
    return spark.read.text(path).select(F.lower(rule).alias("suffix")).filter((F.col("suffix") != "") & ~F.startswith("suffix", F.lit("//")))


def registrable(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds site (a label and the public suffix, else the host) and root (that label, else the first) to rows with host.

    The suffix is that of the longest rule that fits, an exception before all: *.x takes any name under x, !y.x takes y.x
    out of that again. A host that no rule fits has its last label as suffix. The rules, a list of at most MOST_RULES, are
    hashed sets in the plan, which each of a host's tails is looked up in; rows with their page bodies stay where they are.
    """
    given = [r["suffix"] for r in suffixes.select("suffix").distinct().limit(MOST_RULES + 1).collect()]
    if len(given) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} suffix rules")
    listed = lambda xs: ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in sorted(xs)) or "''"
    names = listed(x for x in given if x[:1] != "!" and x[:2] != "*.")
    under, excepted = listed(x[2:] for x in given if x[:2] == "*."), listed(x[1:] for x in given if x[:1] == "!")
    rest = "regexp_replace({}, '^[^.]*\\\\.?', '')"
    out = hosts.withColumn("_tails", host_suffixes(F.col("host")))
    first = lambda test: f"get(filter(_tails, t -> {test}), 0)"
    longest = first(f"t IN ({names}) OR {rest.format('t')} IN ({under})")
    out = out.withColumn("_suffix", F.expr(f"coalesce({rest.format(first(f't IN ({excepted})'))}, {longest}, element_at(_tails, -1))"))
    out = out.withColumn("_label", F.regexp_extract(F.expr("left(host, length(host) - length(_suffix))"), r"([^.]+)\.$", 1))
    whole = F.col("_label") != ""
    out = out.withColumn("site", F.when(whole, F.concat_ws(".", "_label", "_suffix")).otherwise(F.col("host")))
    return out.withColumn("root", F.when(whole, F.col("_label")).otherwise(F.split_part(F.col("host"), F.lit("."), F.lit(1)))).drop("_tails", "_suffix", "_label")


def pages(spark: SparkSession, sf_dir: str, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, url, html, host, site, root; no page is moved for it."""
    rows = table(spark, sf_dir, "pages").withColumn("host", clean_host(F.col("url")))
    return registrable(rows, suffixes if suffixes is not None else suffix_table(spark))


def is_page(status: Column, content_type: Column) -> Column:
    """A captured answer counts as a page: status 200 to 299 and HTML or XHTML."""
    return F.coalesce(status.between(200, 299) & content_type.rlike(r"(?i)text/html|application/xhtml\+xml"), F.lit(False))


def is_text_page(status: Column, content_type: Column) -> Column:
    """The looser test: text or html in the type, or no type."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.coalesce((status < 400) & (F.contains(kind, F.lit("text")) | F.contains(kind, F.lit("html")) | (kind == "")), F.lit(False))


def charset(content_type: Column) -> Column:
    return F.lower(F.regexp_extract(content_type, r"(?i)charset=[\"']?([^;\"' ]+)", 1))


def with_cache(answers: DataFrame, cache: DataFrame) -> DataFrame:
    """answers (url, status, body, etag) with the cached body where the status is 304."""
    old = cache.select("url_sha", F.col("body").alias("_body"), F.col("etag").alias("_etag"))
    both = answers.withColumn("url_sha", F.sha2("url", 256)).join(old, "url_sha", "left")
    fresh = F.col("status") != 304
    return both.select("url", "url_sha", "status", F.when(fresh, F.col("body")).otherwise(F.col("_body")).alias("body"), F.when(fresh, F.col("etag")).otherwise(F.coalesce("etag", "_etag")).alias("etag"))


def sitemap_urls(sitemaps: DataFrame, whole_host: bool = False) -> DataFrame:
    """site, url of every loc of captured sitemaps (site, xml) that lies in the site (whole_host: on its own host); duplicates fall out."""
    locs = sitemaps.select("site", F.explode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>[ \t\r\n]*([^<\s]+)[ \t\r\n]*</loc>"), F.lit(1))).alias("url"))
    host = clean_host(F.col("url"))
    return locs.filter(host == F.col("site") if whole_host else in_scope(host, F.col("site"))).distinct()


def robot_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """origin, rule, allow of captured robots.txt (origin, txt): the rules of the groups that name the agent, or, where none does, those for all agents.

    Names count in any case and without what follows a slash. A group without a rule line names nobody; a rule line without
    a path makes the group count, but rules nothing out.
    """
    lines = robots.select("origin", F.posexplode(F.split("txt", r"\r?\n", -1)).alias("k", "line"))
    told = lines.select("origin", "k", F.lower(F.regexp_extract("line", ROBOT_LINE, 1)).alias("field"), F.trim(F.regexp_extract("line", ROBOT_LINE, 2)).alias("value")).filter("field <> ''")
    lists = told.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("k", "field", "value"))).alias("lines"))
    # A group's agents come before its rules; an agent line after a rule begins a new group.
    start = F.struct(F.expr("cast(array() as array<string>)").alias("names"), F.lit(True).alias("open"), F.expr("cast(array() as array<struct<agent:string,rule:string,allow:boolean>>)").alias("rules"))

    def read(s: Column, x: Column) -> Column:
        names = x["field"] == "user-agent"
        who = F.array(F.lower(F.trim(F.regexp_replace(x["value"], "/.*$", ""))))
        group = F.when(names, F.when(s["open"], F.concat(s["names"], who)).otherwise(who)).otherwise(s["names"])
        said = F.transform(s["names"], lambda a: F.struct(a.alias("agent"), x["value"].alias("rule"), (x["field"] == "allow").alias("allow")))
        return F.struct(group.alias("names"), names.alias("open"), F.when(names, s["rules"]).otherwise(F.concat(s["rules"], said)).alias("rules"))

    mine = F.lower(F.trim(F.regexp_replace(F.lit(agent), "/.*$", "")))
    all_ = lists.select("origin", F.aggregate("lines", start, read, lambda s: s["rules"]).alias("rules"))
    who = F.when(F.exists("rules", lambda r: r["agent"] == mine), mine).otherwise(F.lit("*"))
    chosen = all_.withColumn("_who", who).select("origin", F.explode(F.filter("rules", lambda r: (r["agent"] == F.col("_who")) & (r["rule"] != ""))).alias("r"))
    return chosen.select("origin", "r.rule", "r.allow")


def decoded_body(body: Column, content_type: Column, limit: int | Column) -> Column:
    """At most `limit` bytes of a captured body as text, by the type's charset if it is a known one, else UTF-8."""
    return decode_bytes(F.substring(body, 1, limit), charset(content_type))


def answer_pages(answers: DataFrame, limit: int | Column, cache: DataFrame | None = None) -> DataFrame:
    """page_id, url, html of captured answers (page_id, url, status, content_type, body binary, etag) that are pages.

    Bodies are cut to `limit` bytes, one for all or by the answers' columns, and decoded by their type's charset. With a cache (url_sha, body, etag, content_type if it
    has one), an answer of status 304 has the cached body and its type, HTML where that is not known; one that is not cached
    is no page.
    """
    rows = answers
    if cache is not None:
        kind = F.col("content_type") if "content_type" in cache.columns else F.lit(None).cast("string")
        old = cache.select(F.col("url_sha").alias("_sha"), F.col("body").alias("_old"), kind.alias("_kind"))
        again = F.col("status") == 304
        rows = rows.join(old, F.when(again, F.sha2("url", 256)) == F.col("_sha"), "left")
        rows = rows.withColumn("body", F.when(again, F.col("_old")).otherwise(F.col("body")))
        rows = rows.withColumn("content_type", F.when(again, F.coalesce("_kind", "content_type", F.lit("text/html"))).otherwise(F.col("content_type")))
        rows = rows.withColumn("status", F.when(again & F.col("body").isNotNull(), 200).otherwise(F.col("status")))
    return rows.filter(is_page(F.col("status"), F.col("content_type"))).select("page_id", "url", decoded_body(F.col("body"), F.col("content_type"), limit).alias("html"))


def card_bodies(answers: DataFrame, limit: int) -> DataFrame:
    """url, body of captured answers that are contact cards."""
    return answers.filter(is_card(F.col("status"), F.col("content_type"))).select("url", decoded_body(F.col("body"), F.col("content_type"), limit).alias("body"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of a run, where spark.checkpoint.dir says; on a local master one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sitewright-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the folder that driver and executors share, so that what is made from them is made from the same, once."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def header_options(x: Column) -> Column:
    """A JSON text of headers as a map; empty where it can't be read."""
    return F.coalesce(F.from_json(x, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def is_card(status: Column, content_type: Column) -> Column:
    """A captured answer counts as a contact card: vCard types, or plain text."""
    return F.coalesce(status.between(200, 299) & content_type.rlike(r"(?i)text/(x-)?vcard|text/directory|text/plain"), F.lit(False))
