"""Captured pages that keep arriving as files: addresses of each batch appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitewright.functions.urls import clean_host
from sitewright.operators.contacts import all_addresses
from sitewright.sources.tables import registrable, suffix_table

PAGES = "page_id long, url string, html string"


def arriving_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_addresses(pages: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends site, page_id, email of each batch in a folder of its own, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = registrable(batch.withColumn("host", clean_host(F.col("url"))), suffix_table(batch.sparkSession))
        found = all_addresses(known, strict=True).join(known.select("page_id", "site"), "page_id")
        found.select("site", "page_id", "email").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_new_addresses(pages: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends each site, email once over all batches, however many pages and batches repeat it.

    What was passed on is kept as the stream's state, by site and address, in the checkpoint; the file sink commits each
    batch once. The suffix rules are read when the stream starts.
    """
    known = registrable(pages.withColumn("host", clean_host(F.col("url"))), suffix_table(pages.sparkSession))
    found = known.select("site", "html", F.col("site").alias("page_id"))
    new = all_addresses(found, strict=True).select(F.col("page_id").alias("site"), "email").dropDuplicates(["site", "email"])
    writer = new.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(query: StreamingQuery) -> None:
    """Ends a stream without losing what has arrived: pages that are there are taken in, the batch that runs is finished."""
    query.processAllAvailable()
    query.stop()
