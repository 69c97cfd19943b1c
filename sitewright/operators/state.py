"""What runs leave behind, committed as one: results, evidence, marks of what is done, and the cache of answers.

A state is a folder. A run writes its tables into a folder of its own under data/, and then one file of the manifest that
names them; what no manifest names was never committed. That file is written last and by one task, so a run that ends
before has left nothing that a later one sees, and is done anew without a double or a lost line. A reset is a line of the
manifest too: what came before it stays on disk and can be read by its version.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitewright.sources.tables import work_folder

_LINE = "version long, run string, kind string, bucket int, path string"
#: Parts of the cache that are replaced whole, by the first bytes of the URL's hash.
BUCKETS = 64
CACHE = "url_sha string, url string, status int, content_type string, etag string, last_modified string, fetched_at timestamp, body binary"
_RESET, _CACHE = "reset", "cache"


class CommitConflict(RuntimeError):
    """Another run has committed since this one began."""


def _manifest(spark: SparkSession, root: str) -> list:
    """The manifest's lines, those of one run for each version: a few for each run that was committed."""
    try:
        lines = spark.read.schema(_LINE).json(f"{root}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    first: dict[int, str] = {}
    for line in lines:
        first[line.version] = min(first.get(line.version, line.run), line.run)
    return [line for line in lines if line.run == first[line.version]]


def version(spark: SparkSession, root: str) -> int:
    """The number of the last commit; 0 where there is none."""
    return max((line.version for line in _manifest(spark, root)), default=0)


def paths(spark: SparkSession, root: str, kind: str, at: int | None = None) -> list[str]:
    """The folders that hold a kind of table, as of version `at`: all since the last reset; of the cache the newest of each bucket."""
    lines = [line for line in _manifest(spark, root) if at is None or line.version <= at]
    since = max((line.version for line in lines if line.kind == _RESET), default=0)
    own = sorted((line for line in lines if line.kind == kind and line.version > since), key=lambda line: line.version)
    return list({line.bucket: line.path for line in own}.values()) if kind == _CACHE else [line.path for line in own]


def read(spark: SparkSession, root: str, kind: str, schema: str, at: int | None = None) -> DataFrame:
    """A kind of table as it was committed; empty where there is none."""
    there = paths(spark, root, kind, at)
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


class Run:
    """Tables of one run: write() as many as there are, then commit()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.id = spark, root.rstrip("/"), uuid.uuid4().hex
        self.version = version(spark, self.root) + 1
        self.lines: list[tuple] = []

    def path(self, kind: str) -> str:
        return f"{self.root}/data/{self.id}/{kind}"

    def write(self, kind: str, table: DataFrame) -> DataFrame:
        """Writes a table and returns it as it was written, so that what is made from it is made from those rows."""
        table.write.parquet(self.path(kind))
        self.lines.append((self.version, self.id, kind, 0, self.path(kind)))
        return self.spark.read.schema(table.schema).parquet(self.path(kind))

    def write_cache(self, cache: DataFrame) -> None:
        """Writes the buckets that hold any of the rows; they take the place of the same buckets of before."""
        parts = cache.withColumn("bucket", _bucket())
        parts.repartition("bucket").write.partitionBy("bucket").parquet(self.path(_CACHE))
        there = self.spark.read.parquet(self.path(_CACHE)).select("bucket").distinct().collect()  # BUCKETS at most
        self.lines += [(self.version, self.id, _CACHE, r.bucket, f"{self.path(_CACHE)}/bucket={r.bucket}") for r in there]

    def commit(self) -> int:
        """Names the run's tables in the manifest. Where another run has committed since this one began, that one counts."""
        lines = self.lines or [(self.version, self.id, "nothing", 0, "")]
        if version(self.spark, self.root) >= self.version:
            raise CommitConflict(f"version {self.version} is there already")
        self.spark.createDataFrame(lines, _LINE).coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        if not any(line.run == self.id for line in _manifest(self.spark, self.root)):
            raise CommitConflict(f"version {self.version} is another run's")
        return self.version


def reset(spark: SparkSession, root: str) -> int:
    """Begins anew, in one step; returns the version that the state can still be read by."""
    run = Run(spark, root)
    run.lines.append((run.version, run.id, _RESET, 0, ""))
    return run.commit() - 1


def _bucket():
    return F.pmod(F.conv(F.substring("url_sha", 1, 4), 16, 10).cast("int"), F.lit(BUCKETS))


def cached(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """The cache: CACHE, one row for each URL's hash."""
    return read(spark, root, _CACHE, CACHE, at)


def newest(answers: DataFrame) -> DataFrame:
    """Of answers (CACHE) the last fetched of each URL; of several at once the one whose body has the largest hash."""
    columns = [c for c in answers.columns if c != "url_sha"]
    return answers.groupBy("url_sha").agg(F.max_by(F.struct(*columns), F.struct("fetched_at", F.xxhash64("body"))).alias("a")).select("url_sha", "a.*")


def merge_cache(run: Run, answers: DataFrame) -> None:
    """Takes answers (url, status, content_type, etag, last_modified, fetched_at, body) into the state's cache with the run's commit.

    Answers of status 200 to 299 count, the newest of each URL, also against what is cached. Buckets without a new answer
    are not touched; the others are read and written once.
    """
    names = [f.name for f in StructType.fromDDL(CACHE)]
    fresh = newest(answers.filter(F.col("status").between(200, 299) & F.col("body").isNotNull()).withColumn("url_sha", F.sha2("url", 256)).select(*names))
    fresh_path = work_folder(run.spark, "fresh-answers")
    fresh.write.parquet(fresh_path)
    fresh = run.spark.read.schema(fresh.schema).parquet(fresh_path)
    touched = [r[0] for r in fresh.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS at most
    old = cached(run.spark, run.root).filter(_bucket().isin(touched))
    if touched:
        run.write_cache(newest(old.select(*names).unionByName(fresh.select(*names))))


def conditional_headers(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """url, headers: what a request of each URL says of its cached answer, so that it need not be sent again."""
    known = cache.select("url_sha", "etag", "last_modified")
    asked = urls.select("url").distinct().withColumn("url_sha", F.sha2("url", 256)).join(known, "url_sha", "left")
    pairs = F.filter(F.array(F.struct(F.lit("If-None-Match").alias("k"), F.col("etag").alias("v")), F.struct(F.lit("If-Modified-Since").alias("k"), F.col("last_modified").alias("v"))), lambda p: p["v"].isNotNull())
    return asked.select("url", F.map_from_entries(pairs).alias("headers"))
