"""Byte-level BPE by ranked merges of the bytes of distinct words; decoding by concatenation of binary pieces.

The merges of a word are folded in Python, in Arrow batches, each worker merging a distinct word once. The same fold by
Spark's higher-order functions over the distinct words of all documents was built and measured; it takes more CPU and disk
than whole documents may use here (see the README).
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import with_text
from sitewright.llm.tokens import LONG_PIECE, byte_level_pieces

#: Words of more bytes are merged with a heap: the plain loop copies its pieces at each merge.
LONG = 256
#: Pieces of texts whose ids a worker keeps at most; the cache starts anew beyond it.
CACHE_WORDS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the pair of the lowest rank, leftmost first, is merged while there is one."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    parts = [word[k : k + 1] for k in range(len(word))]
    none = len(ranks)
    pairs = [ranks.get(word[k : k + 2], none) for k in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        k = pairs.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del pairs[k]
        if k:
            pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        if k < len(pairs):
            pairs[k] = ranks.get(parts[k] + parts[k + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of pairs: n log n for n bytes."""
    parts = [word[k : k + 1] for k in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, k, parts[k] + parts[k + 1]) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, both = heapq.heappop(heap)
        m = after[k]
        if not parts[k] or m >= len(parts) or parts[k] + parts[m] != both:
            continue
        parts[k], parts[m] = both, b""
        after[k] = after[m]
        if after[k] < len(parts):
            before[after[k]] = k
        for a in (before[k], k):
            b = after[a] if a >= 0 else len(parts)
            if a >= 0 and b < len(parts) and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p]


class Coder:
    """Ids of whole texts; each distinct word that the cache does not hold is merged once."""

    def __init__(self, rank_file: str, pattern: str):
        import regex

        self.ranks, self.find = read_ranks(rank_file), regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        cache, pieces = self.cache, byte_level_pieces(text)
        coded = list(map(cache.get, pieces))
        if None in coded:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            new = {p: array("I", [i for w in self.find(p) for i in merge_word(w.encode(), self.ranks)]).tobytes() for p in {p for p, c in zip(pieces, coded, strict=True) if c is None}}
            cache.update((p, ids) for p, ids in new.items() if len(p) <= LONG_PIECE)
            coded = [new[p] if c is None else c for p, c in zip(pieces, coded, strict=True)]
        return b"".join(coded)


_CODERS: dict[tuple[str, str], Coder] = {}
ENCODED = "doc_id long, ids binary"


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text, as ranks and pattern give them, without special tokens.

    docs: doc_id, text; other columns are not used. Null text is empty and has no ids. Each match of pattern is encoded
    separately; pattern must cut where byte_level_pieces() cuts, as public_tokenizers.PATTERN does. Repeated and null
    doc_ids give rows of their own; an empty table gives an empty table. Nothing is shuffled or kept outside the workers.
    """

    def encode(batches):
        coder = _CODERS.get((rank_file, pattern)) or _CODERS.setdefault((rank_file, pattern), Coder(rank_file, pattern))
        for b in batches:
            ids = [coder.encode(text.as_py()) for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return with_text(docs, "doc_id").mapInArrow(encode, ENCODED)


def decode_documents(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids -> doc_id, ids, data: the bytes that the ids stand for, one after another."""

    def decode(batches):
        pieces = [p for p, _ in sorted(read_ranks(rank_file).items(), key=lambda x: x[1])]
        for b in batches:
            data = [b"".join(map(pieces.__getitem__, np.frombuffer(x.as_buffer() or b"", "<u4").tolist())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=[*b.schema.names, "data"])

    return encoded.mapInArrow(decode, f"{ENCODED}, data binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
