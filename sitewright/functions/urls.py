"""Hosts, domains and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.config import HINTS, LINK_WORDS, SITEMAP_WORDS
from sitewright.functions.text import let

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)"
LINE = r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
PATH_GATE = r"(?i)^/(" + "|".join(LINK_WORDS) + r")([^0-9A-Za-z_]|$)"
SITEMAP_GATE = r"(/|.html?)$"
SITEMAP_HINT = "(?i)" + "|".join(SITEMAP_WORDS)


def clean_host(x: Column) -> Column:
    """Host of a URL or bare name: lower case, without port, credentials and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(x), HOST, 1)), r"^www\.", "")


def domain_line(x: Column) -> Column:
    """A line of a domain list without comment, as a host; null where it is no domain name."""
    host = clean_host(F.trim(F.regexp_replace(x, "#.*$", "")))
    return F.when(host.rlike(LINE), host)


def shell_line(x: Column) -> Column:
    """The looser form of a line: first word without scheme and www., lower case, path kept; null without a dot."""
    word = F.regexp_extract(F.regexp_replace(x, "#.*$", ""), r"^[ \t]*([^ \t]*)", 1)
    bare = F.lower(F.regexp_replace(F.regexp_replace(word, r"(?i)^https?://", ""), r"(?i)^www\.", ""))
    return F.when(F.contains(bare, F.lit(".")), bare)


def net_location(x: Column) -> Column:
    """Net location with port, or the head of a path; lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(x), r"^(?:[^:/]+://)?([^/?#]+)", 1)), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, ORIGIN, 1)


def path(url: Column) -> Column:
    """Path of an absolute URL; / where there is none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute http(s) URL of a link without its fragment; null for fragments, mail, telephone and script links.

    Absolute, scheme-relative, root-relative, query and plain relative links; segments . and .. of relative paths are
    taken out one by one from the left.
    """
    link = F.struct(F.trim(href).alias("whole"), F.regexp_replace(F.trim(href), "#.*$", "").alias("h"), F.regexp_replace(base, "[?#].*$", "").alias("base"), base.alias("page"))

    def resolved(x: Column) -> Column:
        h, clean = x["h"], x["base"]
        folder = F.when(clean.rlike("^[^/]*//[^/]*/?$"), F.concat(origin(clean), F.lit("/"))).otherwise(F.regexp_replace(clean, "[^/]*$", ""))
        return (
            F.when(x["whole"].rlike("^(#|$)") | h.rlike("^(mailto:|tel:|javascript:)"), F.lit(None))
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.rlike("^//"), F.concat(F.regexp_extract(x["page"], "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
            .when(h.rlike("^/"), F.concat(origin(x["page"]), h))
            .when(h.rlike(r"^\?"), F.concat(clean, h))
            .otherwise(F.concat(folder, h))
        )

    return let(let(link, resolved), lambda url: F.when(url.rlike("^https?://"), without_dots(url)))


def without_dots(url: Column) -> Column:
    """The URL with the dot segments of its path resolved, by one pass over the segments."""

    def resolved(u: Column) -> Column:
        segments = F.slice(F.split(path(u), "/", -1), 2, 1 << 20)
        kept = F.aggregate(
            segments,
            F.expr("cast(array() as array<string>)"),
            lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
        )
        slash = F.when(u.rlike(r"^[^?#]*/\.\.?([?#]|$)"), F.lit("/")).otherwise(F.lit(""))
        joined = let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(F.size(k) > 0, slash).otherwise(F.lit(""))))
        return F.concat(origin(u), joined, F.regexp_extract(u, r"([?].*)$", 1))

    return let(url, lambda u: F.when(u.rlike(r"^[^?#]*//[^?#]*/\.\.?([/?#]|$)"), resolved(u)).otherwise(u))


#: Percent codes, runs of characters that a URL's path and query hold as they are, and single others.
_URL_PIECE = r"(?s)%[0-9A-Fa-f]{2}|[!#$&-;=?-\[\]_a-z~]+|."
#: Codes of letters, digits and -._~, which mean the same as the characters.
_PLAIN_CODE = "(?i)^%(2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])$"


def normal_path(x: Column) -> Column:
    """A path with query in normal form: percent codes in capitals, none where a character means the same, and for all
    characters that a URL does not hold."""

    def piece(p: Column) -> Column:
        plain = F.char(F.conv(F.substring(p, 2, 2), 16, 10).cast("int"))
        coded = F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
        return F.when(p.rlike(_PLAIN_CODE), plain).when(p.rlike("^%..$"), F.upper(p)).when(p.rlike(r"^[!#$&-;=?-\[\]_a-z~]"), p).otherwise(coded)

    def normal(v: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(v, F.lit(_URL_PIECE), F.lit(0)), piece)
        return F.when(v.rlike(r"[^!#$&-;=?-\[\]_a-z~]"), F.array_join(pieces, "")).otherwise(v)

    return let(x, normal)


def normal_url(x: Column) -> Column:
    """An absolute http(s) URL in normal form without its fragment; null for anything else.

    Scheme and host in lower case, credentials and default ports off, backslashes as slashes, line ends and tabs out, / for
    an empty path, path and query as normal_path() has them, dot segments resolved.
    """
    start = r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]*"

    def parts(flat: Column) -> Column:
        host = F.lower(F.regexp_replace(normal_path(F.regexp_extract(flat, start + r"([^/\\?#]*)", 1)), "^.*@", ""))
        p = F.translate(F.regexp_extract(flat, start + r"[^/\\?#]*([^?#]*)", 1), "\\", "/")
        return F.struct(F.lower(F.regexp_extract(flat, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), host.alias("host"), p.alias("path"), F.regexp_extract(flat, r"^[^?#]*([?][^#]*)", 1).alias("query"))

    def whole(u: Column) -> Column:
        port = F.when(u["scheme"] == "http", ":(80)?$").otherwise(":(443)?$")
        url = F.concat(u["scheme"], F.lit("://"), F.regexp_replace(u["host"], port, F.lit("")), F.when(u["path"] == "", "/").otherwise(normal_path(u["path"])), normal_path(u["query"]))
        return F.when(u["scheme"].isin("http", "https") & (u["host"] != ""), without_dots(url))

    return let(let(F.regexp_replace(F.trim(x), r"[\t\r\n]", ""), parts), whole)


def in_scope(host: Column, site: Column) -> Column:
    """Host of the site or under it, at a dot."""
    return (host == site) | F.endswith(host, F.concat(F.lit("."), site))


def hint_score(url: Column) -> Column:
    """How many hint words the URL holds."""
    low, score = F.lower(url), F.lit(0)
    for h in HINTS:
        score = score + F.contains(low, F.lit(h)).cast("int")
    return score


def host_suffixes(host: Column) -> Column:
    """array<string>: the host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
