"""Documents to packed token sequences: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the table it returns is written and read again as the next
stage's docs. All but the last return the columns that documents has. Columns of other names in docs are kept by the
stages that filter. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import langid, minhash, packing, suffixes
from sitewright.llm.common import stored, table, tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null text, or not one letter. Learns from the labelled ones that are not held out.

    Where none is labelled, no language can be told, and documents with a letter stay.
    """
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.filter(langid.has_letter("text"))
    told = langid.predict(docs, model, *docs.columns, label="_language", points="_points")
    return told.filter(F.col("_language") != langid.UNKNOWN).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of shingle similarity 0.8 and more: that of the smallest doc_id (null last), then text.

    Of equal rows one stays. Rows of one doc_id whose texts are not near are groups of their own.
    """
    if docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        kept = minhash.near_groups(docs, percent=80).filter("kept").select(F.col("doc_id").alias("_kept"))
        return docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    names = [f"_c{k}" for k in range(len(docs.columns))]
    rows = stored(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "rows")
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    groups = minhash.near_groups(rows.select(F.col("_row").alias("doc_id"), text.alias("text")), percent=80).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(doc_id.isNull(), doc_id, text, "_row")
    kept = rows.join(groups, "_row").groupBy("component_id").agg(F.min(order)["_row"].alias("_kept"))
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").drop("_row").toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes byte strings that occur more than once out of the texts; documents stay, if with less text, and null text stays null.

    Where a cut runs through a code point, the rest of that code point goes too.
    """
    return suffixes.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of at most 4096: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: SQL can express neither the trained stages nor the tokenizer's ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
