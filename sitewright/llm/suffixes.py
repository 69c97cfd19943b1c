"""Suffix-array removal of repeated byte strings, by the difference cover modulo three."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.blocks import binary_rows, runs
from sitewright.llm.common import stored, text_slices, unique_ids, with_text
from sitewright.llm.repeats import Units, by_document, merged, repeated_spans, runs_of

#: Bytes of the strings that count as repeated; bytes of the grams that place them in shards.
LENGTH, GRAM = 200, 48
#: Bytes that one suffix array is built over (a larger group makes an array of its own).
ARRAY_BYTES = 1 << 17


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of tuples in order, and how many there are."""
    top = max(int(c.max(initial=0)) for c in columns) + 1
    if top ** len(columns) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key = key * top + c
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        key = np.empty(len(order), np.int64)
        key[order] = np.cumsum(new)
    values, inverse = np.unique(key, return_inverse=True)
    return inverse.astype(np.int64) + 1, len(values)


def _first_of_equal(values: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place of its value."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks from 1 of all suffixes of text (integers from 1) in the order of their first `depth` symbols at least.

    Suffixes at places of remainder 1 and 2 by 3 are the sample: their triples are sorted and named, and unless names tell
    all apart or reach depth, the string of the names is ranked in turn. The suffixes of remainder 0 are sorted by symbol
    and the rank that follows, and merged in.
    """
    n = len(text)
    s = np.zeros(n + 3, np.int64)
    s[:n] = text
    if n < 3 or depth <= 1:
        return _names(*[s[k : n + k] for k in range(3)])[0]
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names, distinct = _names(s[sample], s[sample + 1], s[sample + 2])
    if distinct < len(sample) and depth > 3:
        ranked = suffix_ranks(np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1, -(-depth // 3))
        names = np.concatenate([ranked[: len(one)], ranked[len(one) + 1 :]])
        names = _names(names)[0]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    wide = int(rank.max()) + 1
    # Keys by which suffixes of remainder 0 compare with those of remainder 1 and of remainder 2.
    short = lambda at: s[at] * wide + rank[at + 1]
    pair = s[:-1] * (int(s.max()) + 1) + s[1:]
    long = lambda at: pair[at] * wide + rank[at + 2]
    if float(pair.max(initial=0) + 1) * wide >= 2.0**63:
        pair = np.append(_names(pair)[0], 0)
    # All keys are searched for in order, which keeps the searches in cache.
    in_order = np.argsort(names, kind="stable")
    of_one, of_two = in_order[in_order < len(one)], in_order[in_order >= len(one)]
    first, second = one[of_one], two[of_two - len(one)]
    s_first, l_second = short(first), long(second)
    z_key = short(zero)
    z = zero[np.argsort(z_key, kind="stable")]
    z_short, z_long = np.sort(z_key), long(z)
    # A suffix's rank: its rank among its own kind and the number of the other kind before it.
    out = np.zeros(n, np.int64)
    place = np.empty(len(sample), np.int64)
    place[in_order] = _first_of_equal(names[in_order])
    out[first] = place[of_one] + np.searchsorted(z_short, s_first, "left")
    out[second] = place[of_two] + np.searchsorted(np.sort(z_long), l_second, "left")
    out[z] = _first_of_equal(z_short) + np.searchsorted(np.sort(s_first), z_short, "left") + np.searchsorted(np.sort(l_second), z_long, "left")
    return out + 1


def repeated_starts(pieces: list[np.ndarray], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of the windows, the first counts[k] starts of piece k, whose `length` bytes also start at another of them."""
    sizes = np.array([len(p) + 1 for p in pieces])
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.ones(at[-1], np.int64)  # 1 ends a piece
    for p, a in zip(pieces, at[:-1].tolist(), strict=True):
        text[a : a + len(p)] = p
        text[a : a + len(p)] += 2
    ranks = suffix_ranks(text, length)
    piece = np.repeat(np.arange(len(pieces)), counts)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = at[piece] + start
    order = np.argsort(ranks[place], kind="stable")
    flat = text.astype(np.uint8)
    here = place[order]
    # Adjacent suffixes share `length` bytes or not; those that differ early fall out first.
    live = np.arange(len(here) - 1)
    step = 0
    while step < length and len(live):
        width = min(25, length - step)
        same = np.ones(len(live), bool)
        for k in range(step, step + width):
            same &= flat[here[live] + k] == flat[here[live + 1] + k]
        live = live[same]
        step += width
    hit = np.zeros(len(here), bool)
    hit[live] = True
    hit[live + 1] = True
    chosen = np.sort(order[hit])
    return piece[chosen], start[chosen]


def _match(length: int):
    def match(batches):
        def spans(table, a: int, e: int):
            part = table.slice(a, e - a)
            counts = part.column("n").to_numpy().astype(np.int64)
            piece, start = repeated_starts(binary_rows(part.column("units"), np.uint8), counts, length)
            piece, begin, last = runs_of(piece, start)
            base = part.column("first").to_numpy()[piece]
            return pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks().take(pa.array(piece)), pa.array(base + begin), pa.array(base + last + length)], names=["doc_id", "begin", "stop"])

        for table, at in runs(batches, ("shard", "_i", "_j"), 2048):
            size = np.cumsum(np.append(0, np.array([len(x) for x in binary_rows(table.column("units"), np.uint8)], np.int64)))
            a = 0
            while a < len(at) - 1:
                # Whole groups up to ARRAY_BYTES share an array: windows of different shards are never equal.
                e = max(a + 1, int(np.searchsorted(size[at], size[at[a]] + ARRAY_BYTES, "right")) - 1)
                yield spans(table, int(at[a]), int(at[e]))
                a = e

    return match


REMOVED = "n_bytes long, n_removed long, n_spans long, kept"


def _cut_out(docs: DataFrame, length: int, gram: int, columns: list[str], as_text: bool = False) -> DataFrame:
    """columns of docs (doc_id unique, text without nulls), and REMOVED; kept is binary, or a string of its whole code points."""
    spans = stored(repeated_spans(docs.select("doc_id", "text"), Units, _match(length), length, gram, earlier=False), "repeats")
    joined = docs.join(by_document(spans), "doc_id", "left")
    columns = [c for c in columns if c != "text"] + ["text"] * ("text" in columns)
    kinds = ", ".join(f"`{f}` {docs.schema[f].dataType.simpleString()}" for f in columns)

    def remove(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            begins, stops = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(sizes)
            cols = ([], [], [], [])
            for first, n, data, offs in text_slices(b):
                for k in range(n):
                    own = data[offs[k] : offs[k + 1]]
                    r = first + k
                    begin, stop = merged(begins[ends[r] - sizes[r] : ends[r]], stops[ends[r] - sizes[r] : ends[r]])
                    if len(begin):
                        kept = np.concatenate([own[x:y] for x, y in zip(np.append(0, stop).tolist(), np.append(begin, len(own)).tolist(), strict=True)])
                    else:
                        kept = own
                    for col, x in zip(cols, (len(own), len(own) - len(kept), len(begin), kept.tobytes().decode("utf-8", "ignore") if as_text else kept.tobytes()), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string() if as_text else pa.binary())], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select(*[c for c in columns if c != "text"], "text", "spans").mapInArrow(remove, f"{kinds}, {REMOVED} {'string' if as_text else 'binary'}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) for every document; no match crosses documents.

    docs: doc_id, text; other columns are not used. Texts are UTF-8 bytes, null being empty. Every byte is removed that a
    `length`-byte string covers which also starts anywhere else, in the same document too; strings are judged on the
    input. A text of fewer bytes keeps all. Rows of one doc_id, and rows without, are documents of their own. An empty
    table gives an empty table. `kept` may cut a code point.
    """
    rows, new = unique_ids(with_text(docs, "doc_id"))
    if not new:
        return _cut_out(rows, length, gram, ["doc_id"])
    return _cut_out(rows, length, gram, ["given_id"]).withColumnRenamed("given_id", "doc_id")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with what remove_repeats() leaves as text (null stays null) and n_chars, if there is such a column, counted anew.

    Bytes of a code point that a cut has gone through are left out. Columns of any names are kept. Rows of one doc_id whose
    texts differ, and rows without doc_id, are told apart by their texts.
    """
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    plain = rows.select("doc_id", F.col("_text").alias("text"))
    numbered, new = unique_ids(plain)
    if new:
        left = _cut_out(numbered, length, gram, ["given_id", "text"], as_text=True).select(F.col("given_id").alias("_id"), F.col("text").alias("_of"), F.col("kept").alias("_left")).distinct()
        joined = rows.join(left, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of"))).drop("_id", "_of")
    else:
        named = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c != "doc_id"}
        moved = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(n) for c, n in named.items() if c != "text"], F.col("text").isNull().alias("_null"))
        kept = [n for c, n in named.items() if c != "text"]
        cut = _cut_out(moved, length, gram, ["doc_id", *kept, "_null"], as_text=True)
        joined = cut.select("doc_id", *[F.col(n).alias(c) for c, n in named.items() if c != "text"], F.when(~F.col("_null"), F.lit("")).alias("text"), F.col("kept").alias("_left"))
    out = joined.withColumn("text", F.when(F.col("text").isNotNull(), F.col("_left")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


