"""Removal of repeated word sequences by suffix automata of reference shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.blocks import runs
from sitewright.llm.common import stored, unique_ids, with_text, words_of
from sitewright.llm.repeats import Units, by_document, merged, repeated_spans, runs_of

#: Words of a window; words of the grams that place windows in shards.
WINDOW, GRAM = 20, 5


class SuffixAutomaton:
    """The automaton of all substrings of the sequences put in so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence) -> None:
        """Puts a sequence in, from the root on: no substring runs over the end of the one before."""
        next_, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = next_[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                clone = self._clone(last, q, c)
                last = clone
                continue
            new = len(next_)
            next_.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in next_[p]:
                next_[p][c] = new
                p = link[p]
            if p != -1:
                q = next_[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _clone(self, p: int, q: int, c) -> int:
        next_, link, length = self.next, self.link, self.length
        clone = len(next_)
        next_.append(dict(next_[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and next_[p].get(c) == q:
            next_[p][c] = clone
            p = link[p]
        return clone

    def matching_statistics(self, sequence) -> list[int]:
        """For each place the length of the longest substring of the automaton that ends there."""
        next_, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in sequence:
            while state and c not in next_[state]:
                state = link[state]
                n = length[state]
            to = next_[state].get(c)
            if to is not None:
                state, n = to, n + 1
            else:
                n = 0
            out.append(n)
        return out


def earlier_windows(segments: list[list], counts: list[int], window: int) -> list[tuple[int, int]]:
    """(segment, start) of the windows, the first counts[k] starts of segment k, that a segment before it holds."""
    automaton, out = SuffixAutomaton(), []
    for k, s in enumerate(segments):
        if k:
            long = automaton.matching_statistics(s)
            out += [(k, d) for d in range(counts[k]) if long[d + window - 1] >= window]
        if k + 1 < len(segments):
            automaton.add(s)
    return out


def _match(window: int):
    def match(batches):
        for table, at in runs(batches, ("shard", "_i", "_j"), 2048):
            ids, firsts, counts = (table.column(c).to_numpy() for c in ("doc_id", "first", "n"))
            units = table.column("units").to_pylist()
            owners, starts = [], []
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                order = np.lexsort((firsts[a:e], ids[a:e])) + a
                found = earlier_windows([units[k].split(b" ") for k in order], counts[order].tolist(), window)
                owners += [int(order[k]) for k, _ in found]
                starts += [d for _, d in found]
            owner, begin, last = runs_of(np.array(owners, np.int64), np.array(starts, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(firsts[owner] + begin), pa.array(firsts[owner] + last + window)], names=["doc_id", "begin", "stop"])

    return match


def _words(data, offs):
    joined, start, end, at = words_of(data, offs, fold=False)
    return Units(joined, at, start, end)


def remove_seen(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space) for every document.

    docs: doc_id, text; other columns are not used. Words are `[^\\x20\\x09-\\x0D]+`, unchanged; null or blank text has
    none. A word is removed if a window of `window` words covers it whose sequence also starts earlier (in a smaller
    doc_id, or before in the same document); windows are judged on the input. Rows of one
    doc_id, and rows without (first of all), are documents of their own, in the order of their texts. A text of fewer words keeps all. An empty table gives an empty table.

    The reference is the corpus itself, so it is cut in shards by content and each shard's automaton is built where its
    segments meet, in the order of documents: a segment is first streamed through the automaton of those before it, for
    its matching statistics, and then put in. Nothing is broadcast, as no bound on a shard of the whole corpus holds.
    """
    docs, new = unique_ids(with_text(docs, "doc_id"))
    spans = stored(repeated_spans(docs.select("doc_id", "text"), _words, _match(window), window, gram, earlier=True), "repeats")
    joined = docs.join(by_document(spans), "doc_id", "left")

    def remove(batches):
        for b in batches:
            lists = b.column(2)
            begins, stops = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(sizes)
            total, removed, kept = [], [], []
            for r, text in enumerate(b.column(1)):
                words = text.as_py().encode().split()
                begin, stop = merged(begins[ends[r] - sizes[r] : ends[r]], stops[ends[r] - sizes[r] : ends[r]])
                left = words
                if len(begin):
                    left = [w for x, y in zip(np.append(0, stop).tolist(), np.append(begin, len(words)).tolist(), strict=True) for w in words[x:y]]
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.select(F.col("given_id").alias("doc_id") if new else "doc_id", "text", "spans").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
