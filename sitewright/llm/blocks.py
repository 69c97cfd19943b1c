"""Groups of any size in tasks of bounded size, and connected components, for operators that compare within groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import split_join, stored

#: Rows of a block; a task compares two blocks at most.
BLOCK = 2048


def group_sizes(rows: DataFrame, key: str, weight: Column | None = None) -> DataFrame:
    """key, and the number of rows (or the sum of their weights, 1 at least) in the column size, of groups of two and more."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.lit(1) if weight is None else weight).cast("long").alias("size"))
    return stored(sizes.filter("_n > 1").drop("_n"), "group-sizes", narrow=True)


def paired_blocks(rows: DataFrame, sizes: DataFrame, key: str, size: str, spread: str, block: int | Column = BLOCK) -> DataFrame:
    """Rows of groups of two and more, dealt so that each two rows of a group meet in a task and no task gets a whole hot group.

    sizes: a stored table of the groups' keys and sizes. A group of n rows is split by the hash of `spread` in n / block
    blocks (n: its size; block: a number, or an expression of the key); each pair of blocks is a task of its own. Adds _i and _j, the task's pair, and _b, the row's own block; rows
    come sorted by key, _i, _j. Smaller groups are one task (0, 0). Where _i and _j differ, two rows of one block also meet
    in that block's own task.
    """
    n_rows = sizes.agg(F.sum(size)).first()[0] or 0
    own = F.pmod(F.xxhash64(spread, F.lit(7)), F.col("_n")).cast("int")
    dealt = split_join(rows, sizes.select(key, size), key, size, spread, n_rows).withColumn("_n", F.ceil(F.col(size) / block).cast("int")).drop(size).withColumn("_b", own)
    dealt = dealt.withColumn("_o", F.explode(F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1))))
    dealt = dealt.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_n", "_o")
    return dealt.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def runs(batches, keys: tuple[str, ...] | list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows alike in keys, which lie together) with the offsets of the groups in them."""
    held: list[pa.RecordBatch] = []
    n = 0

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = bounds(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            table = table.slice(at[-1])
        held, n = table.to_batches(), 0  # n: rows since the last cut
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, np.append(bounds(table), table.num_rows)


def binary_rows(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """The values of a binary column as arrays, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize)
    size = np.dtype(dtype).itemsize
    return [np.frombuffer(data, dtype, count=(b - a) // size, offset=a) if b > a else np.zeros(0, dtype) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning(n: int, linked) -> list[tuple[int, int]]:
    """Edges that connect what the links of a group connect. linked(k): all members linked with member k.

    Members that the first one's component has taken in need no search of their own: a link between two of them adds
    nothing, and a link to another member is found by that member's search.
    """
    forest, edges = Forest(n), []
    for k in range(n):
        if k and forest.find(k) == forest.find(0):
            continue
        for m in linked(k):
            if m != k and forest.join(k, int(m)):
                edges.append((k, int(m)))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that edges u, v connect it with) for every id in edges, by alternating stars.

    Each round is two joins on minima that are aggregated before any row moves; it is kept as a table in the shared
    folder. The rounds are logarithmic in practice; the count and a checksum of the edges tell when nothing changes.
    """
    e = edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = stored(e, "edges", narrow=True)
    mark = None
    while True:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a is linked with a's smallest neighbour instead.
        e = both.filter(F.col("b") > F.col("a")).join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("m").alias("u"), F.col("b").alias("v")).distinct()
        e = stored(e, "edges", narrow=True)
        # Small star: a and its smaller neighbours are linked with the smallest of them.
        low = e.groupBy("v").agg(F.min("u").alias("m"))
        e = e.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter(F.col("u") != F.col("v")).distinct()
        e = stored(e, "edges", narrow=True)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    # Every edge now leads from a component's smallest id to another of its ids.
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).union(e.select(F.col("u").alias("id"), F.col("u").alias("component"))).distinct()
