"""Addresses, people and companies out of captured pages, and one record for each site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import emails as E
from sitewright.functions.names import PAIR, ROLE_AND_NAME, has_role, is_human_name, looks_like_company
from sitewright.functions.text import HEADING, JSON_LD, TITLE, all_matches, body_text, capitalised, company_name, csv_field, fold, hrefs, mail_links, meta_content, squeeze, tags, unescape, unescape_each, visible_text, without_scripts
from sitewright.functions.urls import clean_host, in_scope, resolve_link

#: At least this much for a person to count.
MIN_WEIGHT = 4


def page_emails(pages: DataFrame, mode: str = "intended") -> DataFrame:
    """site, page_id, channel, hit_ord, email in the site's scope: mail links, then the decoded body.

    In mode "as_written" mail links alone are found.
    """
    links = F.transform(mail_links(F.col("html")), lambda x: F.struct(F.lit(1).alias("channel"), x.alias("email")))
    body = F.transform(E.in_body(F.col("html")), lambda x: F.struct(F.lit(2).alias("channel"), F.trim(x).alias("email")))
    found = F.concat(links, body) if mode == "intended" else links
    hits = pages.filter(F.col("html").isNotNull()).select("site", "page_id", F.posexplode(found).alias("hit_ord", "x")).select("site", "page_id", "x.channel", "hit_ord", "x.email")
    return hits.filter((F.col("email") != "") & in_scope(E.mail_domain(F.col("email")), F.col("site")))


def card_links(pages: DataFrame, most: int = 3) -> DataFrame:
    """site, page_id, url, rank of links to contact cards in the site, the first `most` of a site; relative ones are the site's."""
    found = pages.select("site", "page_id", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    base = F.concat(F.lit("https://"), F.col("site"), F.lit("/"))
    cards = found.filter(F.endswith("href", F.lit(".vcf")) | F.contains("href", F.lit("vcard"))).select("site", "page_id", "pos", resolve_link(base, F.col("href")).alias("url"))
    cards = cards.filter(in_scope(clean_host(F.col("url")), F.col("site")))
    first = cards.groupBy("site", "url").agg(F.min(F.struct("page_id", "pos")).alias("o"))
    w = Window.partitionBy("site").orderBy("o")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("site", "o.page_id", "url", "rank")


def card_emails(cards: DataFrame, bodies: DataFrame) -> DataFrame:
    """site, page_id, channel, hit_ord, email out of captured contact cards (url, body), in scope."""
    hits = cards.join(bodies, "url").select("site", "page_id", F.lit(0).alias("channel"), F.posexplode(F.regexp_extract_all("body", F.lit(E.BODY), F.lit(0))).alias("hit_ord", "email"))
    return hits.filter(in_scope(E.mail_domain(F.col("email")), F.col("site")))


def all_addresses(pages: DataFrame, strict: bool = False) -> DataFrame:
    """page_id, email: every address of a page's mail links, visible text and markup, plain or written out, lower case.

    Text and markup are decoded before they are searched, text a second time, as it may hold references that were escaped.
    """
    listed = F.filter(F.flatten(F.transform(mail_links(F.col("html")), lambda x: F.split(x, r"[,\s;]+"))), lambda x: x != "")
    whole = F.transform(F.filter(listed, lambda x: x.rlike("^" + E.DIRECT + "$")), F.lower)
    rest = F.array_join(F.filter(listed, lambda x: ~x.rlike("^" + E.DIRECT + "$")), "\n\n")
    rows = pages.filter(F.col("html").isNotNull()).select("page_id", whole.alias("_whole"), unescape(rest).alias("_rest"), unescape(visible_text(F.col("html"))).alias("_text"), unescape(F.col("html")).alias("_html"))
    found = F.flatten(F.array("_whole", *[f(F.col(c)) for c in ("_rest", "_text", "_html") for f in (E.direct, lambda x: E.obfuscated(x, strict))]))
    return rows.select("page_id", F.explode(F.array_distinct(found)).alias("email"))


def title_people(pages: DataFrame) -> DataFrame:
    """site, page_id, hit_ord, title, first, last, weight: a role and the two words of a name that come next."""
    found = pages.select("site", "page_id", F.posexplode(all_matches(body_text(F.col("html")), ROLE_AND_NAME, 0)).alias("hit_ord", "_m"))
    title, first, last = (F.regexp_extract("_m", ROLE_AND_NAME, k) for k in (1, 2, 3))
    return found.select("site", "page_id", "hit_ord", title.alias("title"), first.alias("first"), last.alias("last"), F.lit(4).alias("weight"))


def heading_people(pages: DataFrame, strict: bool = True) -> DataFrame:
    """site, page_id, hit_ord, title, first, last, weight: the first name in a heading; in strict mode one with a role."""
    blocks = F.transform(unescape_each(F.transform(all_matches(without_scripts(F.col("html")), HEADING), lambda x: F.regexp_replace(x, "<[^>]*>", ""))), squeeze)
    rows = pages.select("site", "page_id", F.posexplode(blocks).alias("hit_ord", "block"))
    first, last = F.regexp_extract("block", PAIR, 1), F.regexp_extract("block", PAIR, 2)
    named = rows.select("site", "page_id", "hit_ord", F.substring("block", 1, 160).alias("title"), first.alias("first"), last.alias("last"), has_role(F.col("block")).alias("_role"))
    kept = named.filter(is_human_name(F.col("first"), F.col("last")))
    return (kept.filter("_role") if strict else kept).drop("_role").withColumn("weight", F.lit(2))


def score_people(hits: DataFrame) -> DataFrame:
    """site, name_key, weight, title, first, last of each person: hits by folded name, roles adding 3, the longest title kept.

    hits: site, channel_ord, page_id, hit_ord, title, first, last, weight. Of titles alike in length the first counts.
    """
    people = hits.filter(is_human_name(F.col("first"), F.col("last")))
    key = F.concat_ws(" ", fold(F.col("first")), fold(F.col("last")))
    order = F.struct("channel_ord", "page_id", "hit_ord")
    by_title = F.struct(-F.length(F.coalesce("title", F.lit(""))), "channel_ord", "page_id", "hit_ord")
    return people.groupBy("site", key.alias("name_key")).agg(
        F.sum(F.col("weight") + F.when(has_role(F.col("title")), 3).otherwise(0)).alias("weight"),
        F.min_by("title", by_title).alias("title"),
        F.min_by("first", order).alias("first"),
        F.min_by("last", order).alias("last"),
    )


def pick_owner(scored: DataFrame, collation: str | None = None) -> DataFrame:
    """The site's person of the most weight, MIN_WEIGHT at least; then by last and first name, by code point unless a collation is given."""
    by = lambda c: F.collate(F.col(c), collation) if collation else F.col(c)
    w = Window.partitionBy("site").orderBy(F.desc("weight"), by("last"), by("first"))
    return scored.filter(F.col("weight") >= MIN_WEIGHT).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def infer_patterns(addresses: DataFrame) -> DataFrame:
    """site, pattern, score, n of distinct addresses (site, email): how local parts are made; ties by the fixed order."""
    local = E.local_part(F.col("email"))
    points = E.pattern_points(local)
    sums = addresses.select("site", "email").distinct().groupBy("site").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_{k}") for k, c in enumerate(points.values())])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"_{k}")).alias("s"), F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(points)]))
    return sums.select("site", F.get(ranked, F.lit(0))["p"].alias("pattern"), (-F.get(ranked, F.lit(0))["s"]).alias("score"), "n")


def best_email(addresses: DataFrame) -> DataFrame:
    """site, email, rank: the most personal mailbox of a site, then by name."""
    w = Window.partitionBy("site").orderBy(F.desc("rank"), "email")
    ranked = addresses.select("site", "email").distinct().withColumn("rank", E.rank(F.col("email")))
    return ranked.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _json_name(html: Column) -> Column:
    """The name of the first Organization in a page's linked data, at the top of a script or of its list."""
    docs = F.transform(all_matches(html, JSON_LD), lambda x: F.regexp_replace(x, r"[\r\n]+", " "))
    flat = F.flatten(F.transform(docs, lambda x: F.when(F.trim(x).rlike(r"^\["), F.coalesce(F.from_json(x, "array<string>"), F.array())).otherwise(F.array(x))))
    named = F.filter(F.transform(flat, lambda x: F.when(F.coalesce(F.get_json_object(x, "$['@type']"), F.lit("")).rlike(r'(^|")Organization("|$)'), F.get_json_object(x, "$.name"))), lambda n: n.isNotNull() & (n != ""))
    return F.get(named, F.lit(0))


def page_company(pages: DataFrame, ended: bool = False) -> DataFrame:
    """site, page_id, company: linked data, site name, item name, or title, cut at a bar, long dash or hyphen.

    A title's character references are decoded by the rules of HTML; with `ended` those that lack their semicolon, as where a
    title was cut within one, are left as they are.
    """
    html, metas = F.col("html"), F.col("_metas")
    some = lambda x: F.nullif(squeeze(x), F.lit(""))
    pick = F.coalesce(_json_name(html), some(meta_content(metas, "property", "og:site_name")), some(meta_content(metas, "itemprop", "name")), some(unescape(F.regexp_extract(html, TITLE, 1), ended)))
    rows = pages.filter(html.isNotNull()).select("site", "page_id", "html", tags(without_scripts(html), "meta").alias("_metas"))
    # A filter on the name would be pushed below it, and the name found twice.
    return rows.select("site", "page_id", F.explode(F.filter(F.array(company_name(pick)), lambda c: c != "")).alias("company"))


def site_company(pages: DataFrame, ended: bool = False) -> DataFrame:
    """site, company: of the first page that gives one, else the site's own label with a capital. ended: as in page_company()."""
    named = page_company(pages, ended).groupBy("site").agg(F.min_by("company", "page_id").alias("company"))
    sites = pages.select("site", "root").distinct()
    return sites.join(named, "site", "left").select("site", "root", F.coalesce("company", capitalised(F.col("root"))).alias("company"))


def resolve(companies: DataFrame, owners: DataFrame, addresses: DataFrame, mx: DataFrame) -> DataFrame:
    """site, company, owner, email, email_origin: one record for each site.

    companies: site, root, company. owners: site, first, last. addresses: site, email, in scope. mx: domain (takes mail).
    An owner who looks like the company is none. With an owner, an address is made by the site's pattern if one was seen
    and the site takes mail ("synthesized"); without, the best one seen counts ("observed"); else there is none.
    """
    picked = companies.join(owners.select("site", "first", "last"), "site", "left")
    person = F.concat_ws(" ", "first", "last")
    owner = F.when(F.col("first").isNotNull() & ~looks_like_company(person, F.col("company"), F.col("root")), person)
    picked = picked.withColumn("owner", owner)
    joined = picked.join(infer_patterns(addresses), "site", "left").join(best_email(addresses).withColumnRenamed("email", "seen"), "site", "left")
    joined = joined.join(mx.select(F.col("domain").alias("site")).distinct().withColumn("has_mx", F.lit(True)), "site", "left")
    mails = F.coalesce("has_mx", F.lit(False))
    made = F.concat(E.write_local(F.col("pattern"), fold(F.col("first")), fold(F.col("last"))), F.lit("@"), F.col("site"))
    email = F.when(mails & F.col("owner").isNotNull() & F.col("n").isNotNull(), made).when(mails & F.col("owner").isNull(), F.col("seen"))
    origin = F.when(email.isNull(), "none").when(F.col("owner").isNotNull(), "synthesized").otherwise("observed")
    return joined.select("site", "company", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce(email, F.lit("")).alias("email"), origin.alias("email_origin"))


def evidence(pages: DataFrame, addresses: DataFrame, results: DataFrame, hashed: bool = True) -> DataFrame:
    """domain, pages array<struct<u>>, emailsFound, patternHint, result: what a record rests on; addresses hashed by default.

    pages are those of a run, whose page budget bounds a site's list.
    """
    h = (lambda c: F.sha2(c, 256)) if hashed else (lambda c: c)
    looked = pages.groupBy("site").agg(F.array_sort(F.collect_set(F.sha2("url", 256))).alias("u"))
    found = addresses.groupBy("site").agg(F.array_sort(F.collect_set(h(F.col("email")))).alias("emailsFound"))
    hints = infer_patterns(addresses).select("site", F.array("pattern").alias("patternHint"))
    none = F.expr("cast(array() as array<string>)")
    out = looked.join(found, "site", "left").join(hints, "site", "left").join(results.select("site", "email"), "site", "left")
    return out.select(F.col("site").alias("domain"), F.transform("u", lambda x: F.struct(x.alias("u"))).alias("pages"), F.coalesce("emailsFound", none).alias("emailsFound"), F.coalesce("patternHint", none).alias("patternHint"), F.when(F.coalesce("email", F.lit("")) == "", F.lit("")).otherwise(h(F.col("email"))).alias("result"))


def csv_rows(results: DataFrame, sep: str = ",") -> DataFrame:
    """site, row: company, owner and email as one quoted line."""
    return results.select("site", F.concat_ws(sep, *[csv_field(F.col(c)) for c in ("company", "owner", "email")]).alias("row"))


def json_rows(results: DataFrame) -> DataFrame:
    """site, row: company, owner and email as one JSON object."""
    return results.select("site", F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("company", "owner", "email")])).alias("row"))


def first_of_each(lines: DataFrame) -> DataFrame:
    """domain, line_no: domains without regard to case, the first line's spelling kept."""
    return lines.groupBy(F.lower("domain").alias("_key")).agg(F.min_by("domain", "line_no").alias("domain"), F.min("line_no").alias("line_no")).drop("_key")


def pending(domains: DataFrame, processed: DataFrame) -> DataFrame:
    """Domains that are not done yet."""
    return domains.join(processed.select("domain").distinct(), "domain", "left_anti")


def with_sentinel(domains: DataFrame, addresses: DataFrame) -> DataFrame:
    """domain, email: every domain's addresses, or an empty one."""
    return domains.join(addresses, "domain", "left").select("domain", F.coalesce("email", F.lit("")).alias("email"))
