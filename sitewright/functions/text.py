"""HTML and plain text as column expressions."""

from __future__ import annotations

import html as _html
import re
import unicodedata
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>"
JSON_LD = r"(?is)<script[^>]*\stype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
#: One attribute of a tag, or the tag's name.
ATTRIBUTE = r"[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"
#: Letters of Latin-1 and Latin Extended-A and what is left of them by compatibility decomposition in a to z.
_FOLD = {chr(c).lower(): d for c in range(0xC0, 0x180) if len(d := "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if "a" <= x <= "z")) == 1}


def squeeze(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def without_scripts(html: Column) -> Column:
    """Comments, scripts and styles taken out."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")


def visible_text(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments, character references decoded; a space for each tag."""
    return squeeze(unescape(F.regexp_replace(without_scripts(html), "<[^>]*>", " ")))


def body_text(html: Column) -> Column:
    """Text of the page without its head and title, as the tree has it: nothing stands between the texts of adjacent elements."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<title[^>]*>.*?</title>", "")
    return squeeze(unescape(F.regexp_replace(body, "<[^>]*>", "")))


def tags(markup: Column, name: str) -> Column:
    """array<string>: the start tags of a name in markup without scripts. Quoted values may hold any character."""
    pattern = rf"(?i)<{name}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){{0,400}}+>"
    return F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The value, as it is written, of a tag's first attribute of a name, in any place, quoted or not; null where there is none."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*="))
    value = F.regexp_replace(F.get(found, F.lit(0)), r"^[^=]*=\s*", "")
    return F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")


def hrefs(html: Column) -> Column:
    """array<string>: what the links of a page lead to, references decoded; links without a target are left out."""
    return unescape_each(F.filter(F.transform(tags(without_scripts(html), "a"), lambda t: attribute(t, "href")), lambda h: h.isNotNull()))


def mail_links(html: Column) -> Column:
    """array<string>: what the mail links of a page hold before their parameters."""
    return F.transform(F.filter(hrefs(html), lambda h: F.startswith(h, F.lit("mailto:"))), lambda h: F.trim(F.regexp_extract(h, r"^mailto:([^?]*)", 1)))


def meta_content(metas: Column, key: str, value: str) -> Column:
    """The content of the first of a page's meta tags whose attribute key is value; null where there is none."""
    keys = unescape_each(F.transform(metas, lambda t: attribute(t, key)))
    at = F.array_position(keys, F.lit(value)).cast("int")
    return F.trim(unescape(F.when(at > 0, attribute(F.get(metas, at - 1), "content"))))


def all_matches(x: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def let(value: Column, use) -> Column:
    """use(value) with value taken once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.arrow_udf(StringType())
def _plain(x: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _html.unescape(t) for t in x.to_pylist()], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def _plain_each(x: pa.Array) -> pa.Array:
    return pa.array([None if ts is None else [None if t is None else _html.unescape(t) for t in ts] for ts in x.to_pylist()], pa.list_(pa.string()))


_ENDED = re.compile("&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[0-9A-Za-z]+;)")


@F.arrow_udf(StringType())
def _plain_ended(x: pa.Array) -> pa.Array:
    plain = lambda m: _html.unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0]
    return pa.array([None if t is None else _ENDED.sub(plain, t) for t in x.to_pylist()], pa.string())


def unescape(x: Column, ended: bool = False) -> Column:
    """All numeric and named character references decoded once, by the rules of HTML; ended: those alone that a semicolon ends.

    The 2231 names are a hashed table of each Python worker; only texts that have the sign of a reference are handed to it.
    """
    some = F.contains(x, F.lit("&"))
    return F.when(some, (_plain_ended if ended else _plain)(F.when(some, x))).otherwise(x)


def unescape_each(x: Column) -> Column:
    """unescape() of an array's texts; not to be used inside another function's lambda, as no function in Python is."""
    some = F.exists(x, lambda t: F.coalesce(F.contains(t, F.lit("&")), F.lit(False)))
    return F.when(some, _plain_each(F.when(some, x))).otherwise(x)


def fold(x: Column) -> Column:
    """Lower case, accents off, letters a to z alone. Letters beyond Latin Extended-A fall out."""
    return F.regexp_replace(F.translate(F.lower(x), "".join(_FOLD), "".join(_FOLD.values())), "[^a-z]", "")


def csv_field(x: Column) -> Column:
    """Line ends as spaces, trimmed, quotes doubled, in quotes."""
    clean = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " "))
    return F.concat(F.lit('"'), F.replace(clean, F.lit('"'), F.lit('""')), F.lit('"'))


def company_name(x: Column) -> Column:
    """Cut at the first bar, long dash or hyphen."""
    return F.trim(F.regexp_extract(x, "^([^|—-]*)", 1))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
