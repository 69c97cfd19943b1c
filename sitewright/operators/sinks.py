"""Results as files, and resuming on what is there."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.operators.contacts import csv_rows, pending
from sitewright.sources.tables import earlier_results


def format_of(path: Column, explicit: Column | None = None) -> Column:
    """csv, tsv or jsonl: as asked for, else by the path's ending, else csv."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    by_path = F.when(end.isin("json", "jsonl"), "jsonl").when(end == "tsv", "tsv").otherwise("csv")
    return by_path if explicit is None else F.when(F.lower(explicit).isin("csv", "tsv", "jsonl"), F.lower(explicit)).otherwise(by_path)


def write_results(results: DataFrame, path: str, kind: str = "csv") -> None:
    """Appends site (as domain), company, owner, email to a folder of files; a blank path writes nothing.

    Every format has the domain, so each can be resumed from; the commit of the job is the mark that they are done.
    """
    if not path:
        return
    out = results.select(F.col("site").alias("domain"), "company", "owner", "email")
    if kind == "jsonl":
        out.fillna("").write.mode("append").json(path)
        return
    clean = out.select(*[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")).alias(c) for c in out.columns])
    clean.write.mode("append").option("quoteAll", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)


def write_plain_rows(results: DataFrame, path: str, sep: str = ",") -> None:
    """Lines of company, owner and email alone, without a domain."""
    csv_rows(results, sep).select("row").write.mode("append").text(path)


def write_evidence(evidence: DataFrame, path: str) -> None:
    evidence.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def _place(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def to_do(spark: SparkSession, domains: DataFrame, path: str, kind: str) -> DataFrame:
    """Domains (domain) that the results at path do not have yet; all where there are none."""
    try:
        done = earlier_results(spark, path, kind)
        done.schema  # noqa: B018 - a path that is not there shows when the plan is made
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return domains
    return pending(domains, done)


def back_up(path: str, stamp: str) -> None:
    """Moves results aside under a stamp, so that a run begins anew."""
    from pyarrow.fs import FileType

    system, place = _place(path)
    if system.get_file_info(place).type != FileType.NotFound:
        system.move(place, f"{place}.{stamp}")
