"""Addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns must be so for results to agree.
DIRECT = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
BODY = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_S = r"[ \t\r\n\f\x0B]*"
OBFUSCATED = rf"(?i)([a-z0-9._%+\-]+){_S}(?:\(|\[)?{_S}(?:at|@){_S}(?:\)|\])?{_S}([a-z0-9.\-]+){_S}(?:\(|\[)?{_S}(?:dot|\.){_S}(?:\)|\])?{_S}([a-z]{{2,}})"
# End of the fixed values that are not listed below.
#: White space is spelled out in the pattern above because engines differ in what their class of it holds.
#: A match begins where a run of the local part's signs begins, or where the last match ended: a run whose start fails
#: fails from its later signs too, so these need no try.
_RUN_START = r"(?i)(?:(?<![a-z0-9._%+\-])|\G)(?=[a-z0-9._%+\-])"
_B = r"[ \t\r\n\f\x0B]+"
#: The same, but at and dot stand in brackets or between spaces.
STRICT_OBFUSCATED = rf"(?i)([a-z0-9._%+\-]+)(?:{_S}[(\[]{_S}at{_S}[)\]]{_S}|{_B}at{_B})([a-z0-9\-]+)(?:{_S}[(\[]{_S}dot{_S}[)\]]{_S}|{_B}dot{_B})([a-z]{{2,}})"
# Fixed values, in the order that they apply.
DECODINGS = [
    (r"(?i)&#64;|&commat;|%40", "@"),
    (r"(?i)\s*\[at\]\s*|\s*\(at\)\s*|\s+at\s+", "@"),
    (r"(?i)\s*\[dot\]\s*|\s*\(dot\)\s*|\s+dot\s+", "."),
    (r"(?i)&#46;|&period;|%2e", "."),
    (r"(?i)&amp;", "&"),
]


#: Signs that a match of the decodings begins with, so that one look passes over all other places of a text.
_FIRST = ["[&%]", r"[\s\[(]", r"[\s\[(]", "[&%]", "&"]


def decode_obfuscations(x: Column) -> Column:
    """Entities, percent codes and written-out signs of addresses, in this order."""
    for (pattern, plain), first in zip(DECODINGS, _FIRST, strict=True):
        x = F.regexp_replace(x, f"(?i)(?={first})(?:{pattern.removeprefix('(?i)')})", plain)
    return x


def direct(x: Column) -> Column:
    """array<string>: distinct addresses written plainly, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(DIRECT), F.lit(0)), F.lower))


#: BODY, tried where a run of the local part's signs begins, or the last match ended: the same sign @ follows all of a run.
_BODY_RUN = r"(?:(?<![A-Za-z0-9._%+-])|\G)" + BODY.replace("]+@", "]++@", 1)


def in_body(x: Column) -> Column:
    """array<string>: distinct addresses after decoding, as written."""
    return F.array_distinct(F.regexp_extract_all(decode_obfuscations(x), F.lit(_BODY_RUN), F.lit(0)))


def obfuscated(x: Column, strict: bool = False) -> Column:
    """array<string>: distinct addresses put together from local part, domain and top domain, lower case.

    The text is searched once; a match is taken apart by the same pattern, which ends where the match does.
    """
    pattern = STRICT_OBFUSCATED if strict else OBFUSCATED
    found = F.regexp_extract_all(x, F.lit(_RUN_START + pattern.removeprefix("(?i)")), F.lit(0))
    part = lambda m, k: F.regexp_extract(m, pattern, k)
    return F.array_distinct(F.transform(found, lambda m: F.lower(F.concat(part(m, 1), F.lit("@"), part(m, 2), F.lit("."), part(m, 3)))))


def local_part(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(1)))


def mail_domain(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2)))


def rank(email: Column) -> Column:
    """6 for an owner's mailbox down to 1; the first that fits. The words and forms are fixed values."""
    x = local_part(email)
    return (
        F.when(x.rlike("^(owner|founder|ceo|titolare|amministratore|admin(istratore)?unico)$"), 6)
        .when(x.rlike(r"^[a-z]+\.[a-z]+$"), 5)
        .when(x.rlike("^[a-z][a-z0-9]*[.-][a-z]+$"), 4)
        .when(x.rlike("director|managing|partner|principal"), 3)
        .when(x.rlike("^(hello|info|contact|team|enquiries|support|office)$"), 2)
        .otherwise(1)
    )


# Patterns of local parts in the order that ties are settled.
PATTERNS = ["f.l", "fl", "f_l", "f-l", "f0l", "l", "f"]


def pattern_points(local: Column) -> dict[str, Column]:
    """Points that a local part gives each pattern."""
    letters = local.rlike("^[a-z]+$").cast("int")
    return {
        "f.l": F.contains(local, F.lit(".")).cast("int"),
        "fl": letters + local.rlike("^[a-z]{4,}$").cast("int"),
        "f_l": F.contains(local, F.lit("_")).cast("int"),
        "f-l": F.contains(local, F.lit("-")).cast("int"),
        "f0l": local.rlike("^[a-z][a-z0-9]+$").cast("int"),
        "l": letters,
        "f": letters,
    }


def write_local(pattern: Column, first: Column, last: Column) -> Column:
    """A local part by pattern from folded names."""
    return (
        F.when(pattern == "f.l", F.concat_ws(".", first, last))
        .when(pattern == "fl", F.concat(first, last))
        .when(pattern == "f_l", F.concat_ws("_", first, last))
        .when(pattern == "f-l", F.concat_ws("-", first, last))
        .when(pattern == "f0l", F.concat(F.substring(first, 1, 1), last))
        .when(pattern == "l", last)
        .otherwise(first)
    )
