"""Repeated windows of documents: content-defined shards of the corpus in which equal windows meet.

A window is `size` successive units (bytes or words) of one document. Its mark is the place of the smallest hash among
the `gram`-unit strings that it holds; equal windows have equal marks at equal offsets, so all of a window's occurrences
lie in the shard of its mark's hash. Successive windows of one mark are a segment: its units (from its first window's
start to its last window's end) decide about all its windows at once, and segments of equal content are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.blocks import paired_blocks
from sitewright.llm.common import span_hashes, split_join, stored, text_slices

#: Low bits of a mark's key hold its place in the chunk, so the leftmost of equal hashes is the mark.
_PLACE = np.uint64(28)
#: Windows of one pass; far fewer than _PLACE has room for.
CHUNK = 1 << 20


@dataclass
class Units:
    """Texts laid end to end: unit k is data[start[k] : end[k]], or the byte k where start is None; at: offsets of the texts' units."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def bounds(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in data of the units from first to stop."""
        return (first, stop) if self.start is None else (self.start[first], self.end[stop - 1])

    def cut(self, first: np.ndarray, stop: np.ndarray) -> list[memoryview]:
        view = memoryview(np.ascontiguousarray(self.data))
        return [view[a:b] for a, b in zip(*(x.tolist() for x in self.bounds(first, stop)), strict=True)]


def segments(units: Units, size: int, gram: int, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments: text, first window's start in it, windows, and the hash that places the segment in a shard.

    Windows are taken in chunks, so a very long text needs no more memory than others. A chunk's end may cut a segment in
    two; those are other contents than the whole one, of the same shard, and so still meet it in the match.
    """
    total = int(units.at[-1])
    parts = []
    for a in range(0, total - size + 1, chunk):
        b = min(total, a + chunk + size - 1)
        first, last = np.searchsorted(units.at, a, "right") - 1, np.searchsorted(units.at, b, "left")
        cut = np.clip(units.at[first : last + 1], a, b) - a
        at = np.arange(a, b - gram + 1)
        text, begin, n, shard = _segments(span_hashes(units.data, *units.bounds(at, at + gram)), cut, size, gram)
        parts.append((text + first, begin + np.maximum(a - units.at[text + first], 0), n, shard))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(keys: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    at = np.arange(len(keys))
    # Smallest key of each window, by doubling.
    span = size - gram + 1
    low = (keys >> _PLACE << _PLACE) | at.astype(np.uint64)
    done = 1
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    mark = (low & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    n_windows = np.maximum(np.diff(offs) - size + 1, 0)
    start = np.zeros(len(mark), bool)
    inside = np.zeros(len(mark) + 1, np.int32)
    np.add.at(inside, offs[:-1][n_windows > 0], 1)
    np.add.at(inside, (offs[:-1] + n_windows)[n_windows > 0], -1)
    inside = np.cumsum(inside[:-1]) > 0
    start[0] = True
    start[1:] = mark[1:] != mark[:-1]
    start[offs[:-1][n_windows > 0]] = True
    start |= np.append(False, inside[1:] & ~inside[:-1])
    begin = np.flatnonzero(start & inside)
    # A segment ends where the next begins or where windows would leave the text.
    text = np.searchsorted(offs, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(mark)), offs[text] + n_windows[text])
    return text, begin - offs[text], stop - begin, keys[mark[begin]]


def segment_shards(docs: DataFrame, units: Callable, size: int, gram: int) -> DataFrame:
    """shard of every segment of every document (doc_id, text). units(bytes, offsets) -> Units."""

    def rows(batches):
        for b in batches:
            for _, _, data, offs in text_slices(b):
                yield pa.RecordBatch.from_arrays([pa.array(segments(units(data, offs), size, gram)[3].view(np.int64))], names=["shard"])

    return docs.mapInArrow(rows, "shard long")


def segment_rows(docs: DataFrame, units: Callable, size: int, gram: int) -> DataFrame:
    """shard, content (128-bit digest of the segment's bytes), doc_id, first, n of every segment of every document."""

    def rows(batches):
        for b in batches:
            for first, n, data, offs in text_slices(b):
                own = units(data, offs)
                text, begin, count, shard = segments(own, size, gram)
                at = own.at[text] + begin
                content = [hashlib.blake2b(x, digest_size=16).digest() for x in own.cut(at, at + count + size - 1)]
                ids = b.column(0).slice(first, n).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), pa.array(content, pa.binary()), ids, pa.array(begin), pa.array(count.astype(np.int32))], names=["shard", "content", "doc_id", "first", "n"])

    return docs.mapInArrow(rows, "shard long, content binary, doc_id long, first long, n int")


def repeated_spans(docs: DataFrame, units: Callable, match: Callable, size: int, gram: int, earlier: bool, block: int = 2048) -> DataFrame:
    """doc_id, begin, stop (units): spans of windows that also start elsewhere, or earlier if so asked; they may overlap.

    docs: unique doc_id, text. units(bytes, offsets) -> Units. match(batches) gets segments sorted by shard, _i, _j (with
    doc_id, first, n, units as bytes) and yields doc_id, begin, stop.

    Segments whose mark occurs once are unique and go first. Of segments of equal content (by a cryptographic digest of
    their bytes) only one goes on to the match, which compares bytes; what holds for all its windows holds for the others.
    Rows of hot shards and contents are dealt to many tasks; a shard of very many contents is matched in pairs of blocks.
    """
    shards = segment_shards(docs, units, size, gram).groupBy("shard").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    shards = stored(shards, "shards", narrow=True)
    n_rows = shards.agg(F.sum("n_rows")).first()[0] or 0
    rows = split_join(segment_rows(docs, units, size, gram), shards, "shard", "n_rows", "content", n_rows).drop("n_rows")
    rows = stored(rows, "segments")
    by_content = rows.groupBy("content").agg(F.min("shard").alias("shard"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "first", "n")).alias("lead"))
    by_content = stored(by_content, "contents")
    # Copies: all windows of such segments are repeated; if only earlier starts count, all but the first segment's.
    several = by_content.filter("copies > 1").select("content", "copies", F.col("lead.doc_id").alias("lead_doc"), F.col("lead.first").alias("lead_first"))
    copied = split_join(rows.select("content", "doc_id", "first", "n").withColumn("_spread", F.struct("doc_id", "first")), several, "content", "copies", "_spread", n_rows)
    if earlier:
        copied = copied.filter((F.col("doc_id") != F.col("lead_doc")) | (F.col("first") != F.col("lead_first")))
    whole = copied.select("doc_id", F.col("first").alias("begin"), (F.col("first") + F.col("n") + size - 1).alias("stop"))
    # Matching needs shards of two contents and more.
    kinds = stored(by_content.groupBy("shard").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds", narrow=True)
    n_kinds = kinds.agg(F.sum("kinds")).first()[0] or 0
    leads = split_join(by_content.select("shard", "content", "lead"), kinds, "shard", "kinds", "content", n_kinds).select("shard", "lead.*")
    wanted = leads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "n", "shard"))).alias("wanted"))
    wanted = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted")

    def cut(batches):
        for b in batches:
            for first, n, data, offs in text_slices(b):
                lists = b.column(2).slice(first, n)
                flat = lists.flatten()
                begin, count, shard = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                text = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                own = units(data, offs)
                at = own.at[text] + begin
                held = [bytes(x) for x in own.cut(at, at + count + size - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0).slice(first, n).take(pa.array(text)), pa.array(begin), pa.array(count.astype(np.int32)), pa.array(held, pa.binary())], names=["shard", "doc_id", "first", "n", "units"])

    pieces = stored(wanted.mapInArrow(cut, "shard long, doc_id long, first long, n int, units binary"), "segment-units")
    matched = paired_blocks(pieces.withColumn("_spread", F.struct("doc_id", "first")), kinds, "shard", "kinds", "_spread", block).select("shard", "_i", "_j", "doc_id", "first", "n", "units")
    found = matched.mapInArrow(match, "doc_id long, begin long, stop long")
    return whole.union(found)


def by_document(spans: DataFrame) -> DataFrame:
    """doc_id, spans: each document's spans in order, merged where they touch."""
    spans = spans.groupBy("doc_id", "begin").agg(F.max("stop").alias("stop"))
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("spans"))
    return lists


def merged(begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans united where they touch or overlap."""
    if not len(begin):
        return begin, stop
    reach = np.maximum.accumulate(stop)
    new = np.append(True, begin[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return begin[first], reach[np.append(first[1:], len(begin)) - 1]


def runs_of(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, first, last of the runs of successive places of one owner; sorted by owner and place."""
    if not len(owner):
        return owner, place, place
    new = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], place[first], place[last]
