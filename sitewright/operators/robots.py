"""Robots rules: which URLs of an origin its rules let in, by one sorted pass over rules and paths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.urls import normal_path, normal_url, origin

#: Parts that an origin's paths are dealt to; its rules go to each, so no origin is one task's.
PIECES = 16


def _fits(parts: list[str], ends: bool, path: str) -> bool:
    """Whether the pieces between the stars of a rule come in path one after the other; path begins with the first."""
    at = len(parts[0])
    if len(parts) == 1:
        return not ends or at == len(path)
    for part in parts[1:-1]:
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return len(path) - len(parts[-1]) >= at and path.endswith(parts[-1]) if ends else path.find(parts[-1], at) >= 0


def _decided(batches):
    """origin, path, allow of paths that a rule decides. Rows come sorted by origin, piece and text, rules first.

    A rule's text is what it begins with, up to its first star, so the rules that may fit a path are those whose text it
    begins with: they lie on a stack, from which a text takes those off that it does not begin with. It is as deep as rules
    of an origin begin with one another.
    """
    now, stack = None, []
    for b in batches:
        out = []
        for host, piece, text, rule, allow in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (host, piece) != now:
                now, stack = (host, piece), []
            while stack and not text.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                ends = rule.endswith("$")
                if not stack or stack[-1][0] != text:
                    stack.append((text, []))
                stack[-1][1].append((len(rule), allow, rule.removesuffix("$").split("*"), ends))
                continue
            best = None
            for _, rules in stack:
                for size, allowed, parts, ends in rules:
                    if (best is None or (size, allowed) > best) and _fits(parts, ends, text):
                        best = size, allowed
            if best is not None:
                out.append((host, text, best[1]))
        kinds = [pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names=["origin", "path", "allow"])


def decisions(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """origin, path, allow of the distinct targets (origin, path, both in normal form) that one of the rules (origin, rule, allow) decides.

    The longest rule that fits decides, counted in its normal form, allow on ties. A rule may hold * for any characters and
    end in $; an escaped %2A or %24 is the sign itself.
    """
    rule = normal_path(F.trim("rule"))
    head = F.regexp_replace(F.regexp_extract(rule, r"^([^*]*)", 1), r"\$$", "")
    pieces = F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece")
    said = rules.filter(F.col("rule").isNotNull()).select(F.regexp_extract(normal_url(F.concat("origin", F.lit("/"))), "^(.*)/$", 1).alias("origin"), rule.alias("rule"), head.alias("text"), "allow").distinct()
    said = said.select("origin", pieces, "text", "rule", "allow")
    asked = targets.distinct().select("origin", F.pmod(F.xxhash64("path"), F.lit(PIECES)).cast("int").alias("piece"), F.col("path").alias("text"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("allow"))
    both = said.unionByName(asked).repartition("origin", "piece").sortWithinPartitions("origin", "piece", "text", F.col("rule").isNull())
    return both.mapInArrow(_decided, "origin string, path string, allow boolean")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds allowed to rows with url: false where a rule of its origin rules it out; true where none fits, or url is no URL.

    URLs and rules are compared in normal form: scheme and host in lower case, default ports off, dot segments resolved,
    letters, digits and -._~ without percent codes, all else that URLs do not hold with them.
    """
    whole = normal_url(F.col("url"))
    named = urls.withColumn("_origin", origin(whole)).withColumn("_path", F.regexp_extract(whole, r"^[^/]*//[^/?#]*([^#]*)", 1))
    ruled_out = decisions(named.select(F.col("_origin").alias("origin"), F.col("_path").alias("path")).filter("path <> ''"), rules).filter("not allow")
    ruled_out = ruled_out.select(F.col("origin").alias("_origin"), F.col("path").alias("_path"), F.lit(False).alias("allowed"))
    return named.join(ruled_out, ["_origin", "_path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).drop("_origin", "_path")
