"""The corpus pipeline against its stages done by brute force."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sitewright.llm.common import tokenizer_file
from tests.llm.test_operators import brute_groups, library


def removed(texts, n=200):
    blobs = {k: t.encode() for k, t in texts.items()}
    seen = collections.Counter(b[i : i + n] for b in blobs.values() for i in range(len(b) - n + 1))
    out = {}
    for k, b in blobs.items():
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                cover[i : i + n] = b"\1" * n
        out[k] = bytes(x for x, c in zip(b, cover) if not c).decode("utf-8", "ignore")
    return out


def test_pipeline(spark, documents, tmp_path):
    documents = documents.withColumn("lang", F.coalesce("lang", F.lit("en")))
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    texts = {k: t for k, t in texts.items() if t is not None and re.search(r"[^\W\d_]", t)}
    near = brute_groups(texts, 80)
    texts = {k: t for k, t in texts.items() if near[k][2]}
    texts = removed(texts)
    ids = library("word_bpe_49k.json")
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for k, t in texts.items():
        whole = b"".join(bytes(r.ids) for r in sorted(by[k], key=lambda r: r.piece))
        assert np.frombuffer(whole, "<u4").tolist() == [*ids(t), 1]


def test_stages_return_the_columns_of_documents(spark, documents, no_documents):
    for docs in (documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
    assert tokenizer_file("word_bpe_49k.json")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeated_passages", "packed"]


def test_one_of_repeated_rows_stays(spark, prose, tmp_path):
    twice, lost, near, apart = (prose(90) for _ in range(4))
    other = " ".join([*near.split()[:-1], "changed"])
    rows = [(1, twice), (1, twice), (None, lost), (None, lost), (None, lost), (4, near), (4, other), (None, near), (6, apart), (6, "short words")]
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    want = [(0, lost), (1, twice), (4, min(near, other)), (6, apart), (6, "short words")]
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted(want) and {r.lang for r in kept} == {"en"}
    docs.filter("doc_id is null or doc_id <> 6").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = library("word_bpe_49k.json")
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array([*ids(t), 1], "<u4").tobytes() for t in (lost, twice, min(near, other)))


def test_documents_stay_where_no_language_is_learned(spark):
    rows = [(1, "clean text", None), (2, "ясный текст", None), (3, "12 34 !!", None), (4, None, None), (None, "no id", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 3 == 1)
    for some in (docs, docs.union(spark.createDataFrame([(held, "labelled but held out", "en")], docs.schema))):
        want = [r for r in some.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
        got = corpus_pipeline.language(spark, some, "").collect()
        assert sorted(got, key=str) == sorted(want, key=str)
