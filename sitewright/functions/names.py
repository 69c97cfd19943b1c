"""Names of people as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.config import BLOCKED_PHRASES, STOPWORDS, TITLES
from sitewright.functions.text import fold

ROLE = "(?iu)" + "|".join(TITLES)
# A name's form, and two names by a space; after the second no ASCII word character may follow.
NAME = "^[A-Z][a-zÀ-ÖØ-öø-ÿ'’-]+$"
PAIR = r"\b([A-Z][\p{L}'’-]+)\s([A-Z][\p{L}'’-]+)(?![A-Za-z0-9_])(?<=[A-Za-z0-9_])"
WHOLE = r"^([A-Z][\p{L}'’-]+)\s+([A-Z][\p{L}'’-]+)$"
#: A role, at most 200 characters of the same sentence, two words of a name. Letters of either case: the nearest two count.
ROLE_AND_NAME = r"(?iu)(?<![A-Za-z0-9_])(" + "|".join(TITLES) + r")(?![A-Za-z0-9_])[^.\n:]{0,200}?(?<![A-Za-z0-9_])([A-Z][\p{L}'’-]+)\s([A-Z][\p{L}'’-]+)(?![A-Za-z0-9_])(?<=[A-Za-z0-9_])"


def has_role(x: Column) -> Column:
    return F.coalesce(x.rlike(ROLE), F.lit(False))


def is_human_name(first: Column, last: Column) -> Column:
    """Two capitalised names with vowels that are no stop words and do not end like plain words."""
    f, l = fold(first), fold(last)  # noqa: E741
    return F.coalesce(
        (first != F.upper(first))
        & (last != F.upper(last))
        & first.rlike(NAME)
        & last.rlike(NAME)
        & f.rlike("[aeiou]")
        & l.rlike("[aeiou]")
        & (F.length(l) >= 3)
        & ~l.rlike("(s|ing)$")
        & ~f.isin(STOPWORDS)
        & ~l.isin(STOPWORDS)
        & ~F.concat_ws(" ", f, l).isin(BLOCKED_PHRASES),
        F.lit(False),
    )


def looks_like_company(person: Column, company: Column, root: Column) -> Column:
    """The person's name is the company's, the site's, or plain words."""
    p, c, r = F.lower(F.trim(person)), F.lower(F.trim(F.coalesce(company, F.lit("")))), F.lower(F.coalesce(root, F.lit("")))
    words = F.split(c, "[^a-z]+")
    names = F.split(p, r"\s+")
    first, last = F.get(names, F.lit(0)), F.coalesce(F.get(names, F.lit(1)), F.lit(""))
    named = lambda x: (x != "") & F.array_contains(words, x)
    like = (p == c) | (p == r) | named(p) | named(first) | named(last) | ((c != "") & (F.contains(c, p) | F.contains(p, c))) | ((r != "") & F.contains(p, r)) | first.isin(STOPWORDS) | last.isin(STOPWORDS) | p.isin(BLOCKED_PHRASES)
    return F.coalesce((p != "") & like, F.lit(False))
