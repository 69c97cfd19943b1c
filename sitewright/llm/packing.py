"""Best-fit packing of token sequences after Martello and Toth's dominance reduction."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.llm.common import stored, with_text

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, local long"


@dataclass
class Plan:
    """Bins by pattern: runs of `bins` equal bins, and for each size the places that its items take in order of rank."""

    capacity: int
    n_bins: int = 0
    n_fixed: int = 0
    #: by size: (first rank, items, first bin, items in each bin, offset in the bin)
    places: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)

    def put(self, pattern: list[tuple[int, int]], bins: int, ranks: dict[int, int]) -> None:
        """pattern: (size, items in each bin)."""
        at = 0
        for size, each in pattern:
            self.places.setdefault(size, []).append((ranks.get(size, 0), bins * each, self.n_bins, each, at))
            ranks[size] = ranks.get(size, 0) + bins * each
            at += size * each
        self.n_bins += bins


def _smallest(counts: np.ndarray, present: np.ndarray, but: int, n: int) -> list[int]:
    """The n smallest sizes there are, without one item of size `but`."""
    out: list[int] = []
    for s in present:
        have = int(counts[s]) - (s == but)
        out += [int(s)] * min(have, n - len(out))
        if len(out) == n:
            break
    return out


def reduce_dominated(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Fixes sets of items that provably dominate all others: Martello and Toth's reduction, on counts of each size.

    For the items of size j, from the largest: alone if nothing fits beside it; with the largest size that fits if that
    fills the bin, or if no two other items fit beside j; if no three fit, with the largest size that fits where that is
    no less than the best pair, or with the best pair where its larger item is that size and the three fill the bin. Each
    such set holds for all items of its sizes, so they are fixed in one go. Returns the sets and the counts left.
    """
    counts, fixed = counts.copy(), []

    def fix(items: tuple[int, ...]) -> None:
        need = {s: items.count(s) for s in items}
        n = min(int(counts[s]) // k for s, k in need.items())
        for s, k in need.items():
            counts[s] -= n * k
        fixed.append((items, n))

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            present = np.flatnonzero(counts)
            small = _smallest(counts, present, j, 3)
            if not small or small[0] > room:
                fix((j,))
                continue
            fits = present[(present <= room) & (counts[present] > (present == j))]
            best = int(fits[-1])
            if best == room or len(small) < 2 or small[0] + small[1] > room:
                fix((j, best))
                continue
            if len(small) == 3 and sum(small) <= room:
                break
            # Of two items beside j at most: the pair of the largest sum.
            others = np.array([room - int(a) for a in fits])
            at = np.searchsorted(fits, others, "right") - 1
            pairs = [(int(a) + int(fits[k]), max(int(a), int(fits[k])), min(int(a), int(fits[k]))) for a, k in zip(fits, at, strict=True) if k >= 0 and (fits[k] != a or counts[a] - (a == j) >= 2)]
            total, a, b = max(pairs, default=(0, 0, 0))
            if best >= total:
                fix((j, best))
            elif a == best and total == room:
                fix((j, a, b))
            else:
                break
    return fixed, counts


def plan_packing(counts: np.ndarray, capacity: int) -> Plan:
    """counts[s]: items of size s, 1 to capacity. The reduction, then best fit by decreasing size of what is left.

    Items of one size are alike, so the whole plan is made from at most `capacity` counts, whatever the number of items.
    """
    plan, ranks = Plan(capacity), {}
    fixed, left = reduce_dominated(counts, capacity)
    for items, n in fixed:
        pattern = [(s, items.count(s)) for s in dict.fromkeys(items)]
        plan.put(pattern, n, ranks)
    plan.n_fixed = plan.n_bins
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # by room left
    full: list[tuple[list[tuple[int, int]], int]] = []

    def keep(pattern: list[tuple[int, int]], bins: int, room: int) -> None:
        if bins:
            (open_bins.setdefault(room, []) if room else full).append((pattern, bins))

    for s in range(capacity, 0, -1):
        n = int(left[s])
        while n:
            room = min((r for r in open_bins if r >= s), default=None)
            pattern, bins = ([], n) if room is None else open_bins[room].pop()
            if room is None:
                room = capacity
            elif not open_bins[room]:
                del open_bins[room]
            each = room // s
            whole = min(bins, n // each)
            if whole:
                keep([*pattern, (s, each)], whole, room - each * s)
                n -= whole * each
            rest = bins - whole
            if n and rest and n < each:
                keep([*pattern, (s, n)], 1, room - n * s)
                n, rest = 0, rest - 1
            if pattern:
                keep(pattern, rest, room)
    for pattern, bins in [*full, *(x for v in open_bins.values() for x in v)]:
        plan.put(pattern, bins, ranks)
    return plan


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, text -> the pieces of every document: ids (little-endian unsigned 32-bit), of `capacity` tokens at most.

    part and local number the pieces of one length within a task; the table is kept in the shared folder, so those numbers
    hold whatever executors are lost afterwards.
    """

    def encode(batches):
        from pyspark import TaskContext

        from sitewright.llm.tokens import encoder

        code = encoder(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), {}
        names = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("local", pa.int64())])
        for b in batches:
            cols, held = ([], [], [], [], [], [], []), 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(np.frombuffer(code.encode(text.as_py()), code.kind).astype("<u4"), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    n = len(cut)
                    local = seen.get(n, 0)
                    seen[n] = local + 1
                    for col, x in zip(cols, (doc_id, piece, start, n, cut.tobytes(), part, local), strict=True):
                        col.append(x)
                    held += n
                if held > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, names.types, strict=True)], schema=names)
                    cols, held = ([], [], [], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, names.types, strict=True)], schema=names)

    return stored(with_text(docs, "doc_id").mapInArrow(encode, PIECES), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (of encode_pieces, with any further columns or without ids).

    A sequence is what lies at offsets 0, ... of its id. Rows move once, to meet the count of pieces of their length in the
    tasks before; drop wide columns that are not wanted afterwards.
    """
    by_length = pieces.groupBy("length").count().collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_length:
        counts[length] = n
    plan = plan_packing(counts, capacity)
    base = 1 << 40
    flat = sorted((size * base + first, first, bins, each, at) for size, spots in plan.places.items() for first, _, bins, each, at in spots)
    columns = tuple(np.array(x, np.int64) for x in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64),) * 5
    table = pieces.sparkSession.sparkContext.broadcast(columns)  # a few rows a size, by the plan
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy("part", "length").count().select("part", "length", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    kept = [c for c in pieces.columns if c not in ("part", "local", "length")]
    ranked = pieces.join(before, ["part", "length"]).select(*kept, "length", (F.col("before") + F.col("local")).alias("_rank"))
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        keys, firsts, bins, eaches, ats = table.value
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (b.num_columns - 2, b.num_columns - 1))
            at = np.searchsorted(keys, length * base + rank, "right") - 1
            k = rank - firsts[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bins[at] + k // eaches[at]), pa.array(ats[at] + k % eaches[at] * length)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids with end_id put after them, in as few sequences of `capacity` tokens as the heuristic finds.

    docs: doc_id, text; other columns are not used. Null text is empty and gives the end id alone; null and repeated
    doc_ids give pieces of their own; an empty table gives an empty table. Only texts of more than `capacity` ids are cut;
    of those all pieces but the last are full. Returns doc_id, piece, start, length, ids, sequence_id, offset.
    """
    return pack(encode_pieces(docs, tokenizer_path, end_id, capacity), capacity)
