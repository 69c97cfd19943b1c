"""Exact dedup in two passes: a counting Bloom filter tells which texts may occur twice, and only those rows are shuffled."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sitewright.llm.common import small_batches, split_join, stored

#: Cells of a segment of the filter (a row that all cells of a text lie in), cells for each text, cells that a text marks.
SEGMENT, ROOM, MARKS = 1 << 16, 16, 3
#: Segments at most: 8 KB each, so the filter that is broadcast has 128 MB at most whatever the number of texts. Beyond a
#: billion cells more texts share them, so more rows are shuffled; results are the same.
MOST_SEGMENTS = 1 << 14
#: Digests that a task marks before it hands its cells on.
FLUSH = 1 << 20

@F.arrow_udf(BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    """32 bytes of SHA-256 of the normalised text: null as empty, A-Z lower-cased, all other characters as they are."""
    return pa.array([hashlib.sha256(x.as_buffer().to_pybytes().lower() if x.is_valid else b"").digest() for x in text], pa.binary())


def _places(digest: Column, segments: int) -> list[Column]:
    """The segment of a digest, and its cells there."""
    cells = F.xxhash64(digest, F.lit(1))
    segment = F.pmod(F.xxhash64(digest), F.lit(segments)).cast("int").alias("segment")
    return [segment, *(F.shiftrightunsigned(cells, 16 * k).bitwiseAND(F.lit(SEGMENT - 1)).cast("int").alias(f"cell{k}") for k in range(MARKS))]


def _marks(batches):
    """Rows (segment, once, more): cells that a task's texts mark, and those of them that they mark more than once."""

    def cells(held):
        at, n = np.unique(np.concatenate(held), return_counts=True)
        segment = at // SEGMENT
        cut = np.flatnonzero(np.diff(segment, prepend=-1))
        parts = zip(np.split(at % SEGMENT, cut[1:]), np.split(n > 1, cut[1:]), strict=True)
        rows = [(x.astype("<u2").tobytes(), x[again].astype("<u2").tobytes()) for x, again in parts]
        return pa.RecordBatch.from_arrays([pa.array(segment[cut], pa.int32()), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], names=["segment", "once", "more"])

    held, n = [], 0
    for b in batches:
        segment = b.column(0).to_numpy().astype(np.int64) * SEGMENT
        held.extend(segment + b.column(1 + k).to_numpy() for k in range(MARKS))
        n += b.num_rows
        if n >= FLUSH:
            yield cells(held)
            held, n = [], 0
    if n:
        yield cells(held)


def _merged(batches):
    """Rows (segment, bits) of the cells marked more than once, from marks that come sorted by segment."""

    def row(segment, twice):
        words = np.packbits(twice, bitorder="little").view("<i8")
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([words.tolist()], pa.list_(pa.int64()))], names=["segment", "bits"])

    now, seen, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
    for b in batches:
        for segment, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if segment != now:
                if now is not None and twice.any():
                    yield row(now, twice)
                now = segment
                seen[:], twice[:] = False, False
            once = np.frombuffer(once, "<u2")
            twice[once[seen[once]]] = True
            seen[once] = True
            twice[np.frombuffer(more, "<u2")] = True
    if now is not None and twice.any():
        yield row(now, twice)


def segments_for(n_texts: int) -> int:
    return min(MOST_SEGMENTS, max(1, math.ceil(n_texts * ROOM / SEGMENT)))


def repeat_filter(digests: DataFrame, segments: int) -> DataFrame:
    """First pass over a column of digests: segment, bits (array of long) of the cells that were marked more than once.

    A digest that occurs twice finds all its cells marked; of the others about one in 250 does, while segments follow
    their number. Tasks hand on the cells that they marked, two bytes each, at most twice whatever the number of copies.
    """
    marks = digests.select(*_places(digests[digests.columns[0]], segments)).mapInArrow(_marks, "segment int, once binary, more binary")
    bits = marks.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, bits array<long>")
    return stored(bits, "repeat-filter")


def _seen_twice(digest: Column, segments: int, filters: DataFrame) -> Column:
    segment, *cells = _places(digest, segments)
    found = segment == filters["segment"]
    for cell in cells:
        found = found & (F.getbit(F.get(filters["bits"], F.shiftright(cell, 6)), cell.bitwiseAND(F.lit(63))) == 1)
    return found


def split_suspects(rows: DataFrame, filters: DataFrame, segments: int, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """Second pass: rows whose digest may occur twice, and the rest, which occur once for certain. Nothing is shuffled."""
    filters = F.broadcast(filters)  # MOST_SEGMENTS rows of 8 KB at most
    test = _seen_twice(rows[digest], segments, filters)
    return rows.join(filters, test, "left_semi"), rows.join(filters, test, "left_anti")


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row: which of equal texts stays.

    docs: doc_id, text; other columns are not used, whatever their names. Texts are equal when they are after A-Z are
    lower-cased; null counts as empty. Of equal texts the row of the largest doc_id stays (null is smaller than any), of
    several such rows one; keep_id is its doc_id, null where no row of the group has one. An empty table gives an empty
    table.

    Digests of 256 bits stand for the texts, which are read once and never move. Rows whose digest is in the repeat filter
    are grouped; groups of many copies are summed before they move and dealt to many tasks. All others pass straight through.
    """
    small_batches(docs)
    named = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_digest(F.col("text")).alias("digest")), "text-digests")
    segments = segments_for(named.count())
    suspects, rest = split_suspects(named, repeat_filter(named.select("digest"), segments), segments)
    suspects = stored(suspects, "suspects")
    groups = suspects.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
    groups = stored(groups, "copy-groups")
    judged = split_join(suspects, groups, "digest", "group_size", "row", suspects.count())
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    judged = judged.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), sha)
    return judged.unionByName(rest.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha))


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without copies: the rows that exact_copies() keeps, in all their columns.

    Rows that may be copies are moved with their columns, one for each task and text; of equal texts and doc_ids that
    differ in other columns, the one of the largest hash of these stays.
    """
    small_batches(docs)
    names = [f"_c{k}" for k in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = renamed.withColumn("_digest", text_digest(text))
    named = stored(rows.select("_digest"), "text-digests")
    segments = segments_for(named.count())
    suspects, rest = split_suspects(rows, repeat_filter(named, segments), segments, "_digest")
    order = F.struct(doc_id, F.xxhash64(*names))
    kept = suspects.groupBy("_digest").agg(F.max_by(F.struct(*names), order).alias("_row")).select("_row.*")
    return rest.select(*names).unionByName(kept).toDF(*docs.columns)
