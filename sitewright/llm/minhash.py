"""b-bit MinHash near-duplicate groups, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.blocks import binary_rows, components, group_sizes, paired_blocks, runs, spanning
from sitewright.llm.common import mixed, span_hashes, split_join, stored, text_slices, with_text, words_of

#: Words of a shingle; minima; bits kept of each; minima of a band (the bands take all of them). Texts of similarity 0.8
#: share no band with probability (1 - 0.8**5)**26, 0.00003.
WORDS, MINIMA, BITS, ROWS = 5, 130, 2, 5
BANDS = MINIMA // ROWS
#: Candidates go to the exact test from so many standard errors of the estimate under the threshold on.
ERRORS = 4.5
_SIGNATURE_WORDS = -(-MINIMA * BITS // 64)
_PAIR_MASK = np.uint64(0x5555555555555555)
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, MINIMA, np.uint32)
_ROW_MULTIPLIERS = mixed(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)


#: Rows of a block of full sets; bytes of text by which a row counts as one more.
SETS, SET_BYTES = 512, 8192


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """64-bit hashes of each text's shingles, with repeats, (start, end) of each in its text's words joined by a space, the
    offsets of the texts' shingles, and those words."""
    joined, start, end, at = words_of(data, offs, fold=True)
    n_words = np.diff(at)
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    out_at = np.concatenate([[0], np.cumsum(n)])
    # Starts of shingles: all words but the last four of a text; the first word of a text with fewer.
    first = np.repeat(at[:-1] - out_at[:-1], n) + np.arange(out_at[-1])
    last = np.minimum(first + WORDS, np.repeat(at[1:], n)) - 1
    view = memoryview(np.ascontiguousarray(joined))
    words = [bytes(view[start[a] : end[b - 1]]) if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    # A text's words begin where its first shingle does.
    spans = np.stack([start[first], end[last]])
    here = spans - np.repeat(spans[0][np.minimum(out_at[:-1], max(0, out_at[-1] - 1))], n) if len(first) else spans
    return span_hashes(joined, *spans), here, out_at, words


def set_size(hashes: np.ndarray, spans: np.ndarray, words: bytes) -> int:
    """How many different shingles a text has. Those of one hash are compared by their words, so hashes decide nothing."""
    order = np.argsort(hashes, kind="stable")
    again = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    starts, ends = spans[:, order]
    for a, b, c, d in zip(starts[again].tolist(), ends[again].tolist(), starts[again + 1].tolist(), ends[again + 1].tolist(), strict=True):
        if b - a != d - c or words[a:b] != words[c:d]:
            return len({words[a:b] for a, b in spans.T.tolist()})
    return len(hashes) - len(again)


def signatures(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits of the minima) of each text that has shingles; at: strictly increasing offsets."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((MINIMA, len(at) - 1), np.uint32)
    for k in range(MINIMA):
        minima[k] = np.minimum.reduceat(x * _A[k] + _B[k], at[:-1])
    bands = np.zeros((len(at) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            bands[:, b] += minima[b * ROWS + r].astype(np.uint64) * _ROW_MULTIPLIERS[r]
        bands[:, b] = mixed(mixed(bands[:, b]) + np.uint64(b))
    packed = np.zeros((len(at) - 1, _SIGNATURE_WORDS), np.uint64)
    # The low bits of a product with an odd number depend on low bits alone, so the bits kept are of the mixed minima.
    low = mixed(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    for k in range(MINIMA):
        packed[:, k * BITS // 64] |= low[k] << np.uint64(k * BITS % 64)
    return bands, packed


def margin(threshold: float) -> float:
    """How far the estimate of a similarity of threshold falls below it by chance, with a probability of some 0.000004."""
    chance = 0.5**BITS
    agree = threshold + (1 - threshold) * chance
    return ERRORS * (agree * (1 - agree) / MINIMA) ** 0.5 / (1 - chance)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures, corrected for minima whose low bits agree by chance."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & _PAIR_MASK).sum(-1, dtype=np.int64)
    chance = 0.5**BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def _prepare(batches):
    for b in batches:
        for first, n, data, offs in text_slices(b):
            sh, spans, at, words = shingles(data, offs)
            ids = b.column(0).slice(first, n)
            sizes, digests = np.zeros(n, np.int64), [None] * n
            for k in range(n):
                if at[k + 1] > at[k]:
                    sizes[k] = set_size(sh[at[k] : at[k + 1]], spans[:, at[k] : at[k + 1]], words[k])
                    digests[k] = hashlib.blake2b(words[k], digest_size=16).digest()
            bands, packed = [None] * n, [None] * n
            full = np.flatnonzero(sizes)
            if len(full):
                keys, sig = signatures(sh, np.append(at[full], at[-1]))
                for k, row, bits in zip(full.tolist(), keys.astype(np.int64), sig, strict=True):
                    bands[k], packed[k] = row, bits.tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "signature"])


def _near_in_bands(threshold: float):
    def near(batches):
        for table, at in runs(batches, ("band", "_i", "_j")):
            ids = table.column("doc_id").to_numpy()
            sig = np.array(binary_rows(table.column("signature"), np.uint64)).reshape(-1, _SIGNATURE_WORDS)
            size = np.diff(at)
            us, vs = [], []
            two = at[:-1][size == 2]
            hit = two[estimate(sig[two], sig[two + 1]) >= threshold] if len(two) else two
            us.append(ids[hit])
            vs.append(ids[hit + 1])
            for a, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                s, d = sig[a : a + n], ids[a : a + n]
                found = np.array(spanning(n, lambda k, s=s: np.flatnonzero(estimate(s, s[k]) >= threshold)), np.int64).reshape(-1, 2)
                us.append(d[found[:, 0]])
                vs.append(d[found[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return near


def _words(batches):
    for b in batches:
        for first, n, data, offs in text_slices(b):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(shingles(data, offs)[-1], pa.binary())], names=["doc_id", "cluster", "words"])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's set of shingles as sorted numbers, which are equal where the shingles' words are."""
    names: dict[bytes, int] = {}
    lists = [[names.setdefault(w, len(names)) for w in t.split(b" ")] for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.array([w for x in lists for w in x], np.int64)
    joint = flat
    for k in range(1, WORDS):  # names of runs of k + 1 words, one after another by the name of the first k and the last word
        joint = np.unique(joint[:-1] * (len(flat) + 1) + flat[k:], return_inverse=True)[1] if len(joint) > 1 else joint[:0]
    short: dict[tuple, int] = {}
    return [np.unique(joint[a : b - WORDS + 1]) if b - a >= WORDS else np.array([len(flat) + short.setdefault(tuple(x), len(short))]) for x, a, b in zip(lists, at[:-1].tolist(), at[1:].tolist(), strict=True)]


def exact_links(sets: list[np.ndarray], percent: int):
    """linked(k) for spanning(): members whose sets share at least percent of the union with member k's, by an inverted list."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, name, count = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(name, kind="stable")
    lists, at = owner[order], np.concatenate([[0], np.cumsum(count)])
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def linked(k: int) -> np.ndarray:
        own = name[starts[k] : starts[k + 1]]
        own = own[count[own] > 1]
        n = count[own]
        if not len(n):
            return np.zeros(0, np.int64)
        pick = np.repeat(at[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(lists[pick], minlength=len(sets))
        return np.flatnonzero((100 * both >= percent * (sizes + sizes[k] - both)) & (both > 0))

    return linked


def _confirm(percent: int):
    def confirm(batches):
        for table, at in runs(batches, ("cluster", "_i", "_j"), 512):
            ids = table.column("doc_id").to_numpy()
            us, vs = [], []
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets = shingle_sets(table.column("words").slice(a, e - a).to_pylist())
                for x, y in spanning(e - a, exact_links(sets, percent)):
                    us.append(ids[a + x])
                    vs.append(ids[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return confirm


def near_groups(docs: DataFrame, percent: int = 80, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: groups by links of at least `percent` shared shingles.

    docs: doc_id, text; other columns are not used. Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a
    document's set is of its distinct shingles of five words, or its whole word sequence if it has fewer. A null or
    blank text has an empty set and no link. Documents of the same words count as one from the start (the smallest doc_id
    stands for them). Rows of one doc_id are one document: they share their links. A row with null doc_id takes the
    component of its words, if another row has them. An empty table gives an empty table.

    Candidates share one of the bands of minima; a group of one band is compared by packed low bits alone, the estimate
    being corrected for chance. What the candidates connect is a cluster, and the clusters' full sets, built from the words themselves, decide: within a
    cluster all links that its connectivity needs are tried. Groups and clusters of any size are dealt in pairs of blocks.
    """
    docs = with_text(docs, "doc_id")
    prepared = stored(docs.mapInArrow(_prepare, "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"), "signatures")
    worded = prepared.filter("digest is not null")
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "signature", "bands"))  # null would be the smallest in min
    every = stored(worded.groupBy("digest").agg(F.min(first).alias("f"), F.count("*").alias("copies")).select("digest", "copies", "f.*"), "representatives")
    firsts = every.filter("doc_id is not null")
    banded = firsts.select("doc_id", "signature", F.explode("bands").alias("band"))
    coarse = paired_blocks(banded, group_sizes(banded, "band"), "band", "size", "doc_id", block).select("band", "_i", "_j", "doc_id", "signature").mapInArrow(_near_in_bands(percent / 100 - margin(percent / 100)), "u long, v long")
    clusters = components(coarse.distinct())
    clusters = stored(clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "clusters", narrow=True)
    texts = stored(docs.join(clusters, "doc_id").select("doc_id", "cluster", "text").mapInArrow(_words, "doc_id long, cluster long, words binary"), "cluster-words")
    sizes = group_sizes(texts, "cluster", 1 + F.floor(F.length("words") / SET_BYTES))
    links = paired_blocks(texts, sizes, "cluster", "size", "doc_id", min(block, SETS)).select("cluster", "_i", "_j", "doc_id", "words").mapInArrow(_confirm(percent), "u long, v long")
    groups = components(links)
    by_set = every.select("digest", "copies", F.col("doc_id").alias("first")).join(groups, F.col("first") == F.col("id"), "left").select("digest", "copies", F.coalesce("component", "first").alias("component_id"))
    n_rows = every.agg(F.sum("copies")).first()[0] or 0
    out = split_join(worded.select("doc_id", "n_shingles", "digest"), by_set, "digest", "copies", "doc_id", n_rows).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(prepared.filter("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
