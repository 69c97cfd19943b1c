"""Near-duplicate vectors by iterative quantisation: balanced binary codes, multi-index tables, exact cosines."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.blocks import components, group_sizes, paired_blocks, runs
from sitewright.llm.common import split_join, stored

#: Vectors that rotations are learned from (those of the smallest hashes of vec_id), at most; every vector is indexed.
SAMPLE = 20_000
#: Rounds of learning; wanted share of pairs at the threshold that share a table's key; vectors in a key's bucket on average.
ROUNDS, RECALL, BUCKET = 30, 0.99, 128
#: Tables at most, which bounds what a vector hands on. Where so many do not reach the wanted share, as codes cannot tell
#: near vectors from others that share a direction with them, all vectors of the dimension are compared.
MOST_TABLES = 24
#: Pairs of the sample that the share is measured on; vectors and components of a block where all are compared.
PROBES, BLOCK_VECTORS, BLOCK_COMPONENTS = 2000, 1 << 14, 1 << 22


#: Share of the pairs at the threshold whose codes lie within the radius.
WITHIN = 0.999


@dataclass
class Index:
    """Projections to bits, and tables: each table's key is `width` successive bits of the code.

    Codes that differ in fewer bits than there are tables share a key for certain, by the pigeonhole principle; of those
    that differ in more, up to the radius, a share that was measured when the tables were made. A code of more than `radius`
    other bits is no candidate.
    """

    mean: np.ndarray
    planes: np.ndarray  # (dimensions, bits)
    width: int
    tables: int
    radius: int = 0

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, bits) codes of unit vectors."""
        return (unit - self.mean) @ self.planes[:, : self.width * self.tables] > 0

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) keys of unit vectors."""
        return self.keys_of(self.codes(unit))

    def keys_of(self, codes: np.ndarray) -> np.ndarray:
        return codes.reshape(len(codes), self.tables, self.width) @ (1 << np.arange(self.width, dtype=np.int64))

    def unpacked(self, packed: np.ndarray) -> np.ndarray:
        """Codes from rows of packed bytes."""
        return np.unpackbits(packed, axis=1, count=self.width * self.tables).astype(bool)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def rotation(centred: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthogonal projection whose signs lose least: principal axes, then alternating codes and rotations (Gong and Lazebnik)."""
    d = min(64, centred.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :d]
    low = centred @ axes
    r = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(np.where(low @ r > 0, 1.0, -1.0).T @ low)
        r = (u @ vt).T
    return axes @ r


def near_pairs(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sets of pairs to measure on: vectors turned by the angle of the threshold towards others, so within the data's own
    spread; and those real pairs of the sample that are near, a vector's farthest one, where there are some."""
    some = sample[rng.permutation(len(sample))[:PROBES]]
    side = sample[rng.integers(0, len(sample), len(some))]
    side = side - (side * some).sum(1, keepdims=True) * some
    side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-12)
    sets = [(some, threshold * some + math.sqrt(1 - threshold**2) * side)]
    real = []
    for a in range(0, len(some), 200):
        cosines = some[a : a + 200] @ sample.T
        cosines[(cosines < threshold) | (cosines > 1 - 1e-9)] = 2
        farthest = cosines.argmin(1)
        real += [(a + k, y) for k, y in enumerate(farthest.tolist()) if cosines[k, y] < 2]
    if len(real) >= 20:
        x, y = np.array(real).T
        sets.append((some[x], sample[y]))
    return sets


def learn(sample: np.ndarray, n_vectors: int, threshold: float, recall: float = RECALL, seed: int = 11) -> Index | None:
    """Rotations from sample (unit vectors), as many as the wanted recall at the threshold needs; none where MOST_TABLES
    tables do not reach it.

    The bits of a key grow with the number of vectors, so that buckets stay as large; the tables grow with the bits. Both
    the share of pairs that meet in a table and the radius are measured on near_pairs() of the sample.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    width = max(8, math.ceil(math.log2(max(1, n_vectors / BUCKET))))
    sets = near_pairs(sample, threshold, rng)
    planes, differ, met = np.zeros((sample.shape[1], 0)), [np.zeros((len(x), 0), bool) for x, _ in sets], [np.zeros(len(x), bool) for x, _ in sets]
    used = 0
    while used < 4 or min(m.mean() for m in met) < recall:
        if used == MOST_TABLES:
            return None
        while planes.shape[1] < (used + 1) * width:
            more = rotation(sample - mean, rng)
            planes = np.concatenate([planes, more], 1)
            differ = [np.concatenate([d, ((x - mean) @ more > 0) != ((y - mean) @ more > 0)], 1) for d, (x, y) in zip(differ, sets, strict=True)]
        met = [m | ~d[:, used * width : (used + 1) * width].any(1) for m, d in zip(met, differ, strict=True)]
        used += 1
    radius = max(int(np.quantile(d[:, : used * width].sum(1), WITHIN)) for d in differ) + 1
    return Index(mean, planes, width, used, radius)


def is_valid(vector: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _parts(column):
    """(dimension, places, matrix) for each dimension of a column of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, _matrix(column.take(pa.array(at)), d)


#: A bucket's number: its dimension's place, its table, its key.
_TABLE_AT, _DIMENSION_AT = 36, 47


def _encode(indexes):
    """Rows (vec, bucket, code) for each vector and table."""

    def encode(batches):
        places = {d: k for k, d in enumerate(indexes.value)}
        for b in batches:
            for d, at, vectors in _parts(b.column(1)):
                vec = b.column(0).to_numpy()[at]
                index = indexes.value[d]
                for a in range(0, len(vec), 1000):
                    codes = index.codes(unit_vectors(vectors[a : a + 1000]))
                    bucket = (places[d] << _DIMENSION_AT) + (np.arange(index.tables, dtype=np.int64) << _TABLE_AT) + index.keys_of(codes)
                    packed = [x.tobytes() for x in np.packbits(codes, axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vec[a : a + 1000], index.tables)), pa.array(bucket.ravel()), pa.array([x for x in packed for _ in range(index.tables)], pa.binary())], names=["vec", "bucket", "code"])

    return encode


def _pairs(table: pa.Table, a: int, e: int, indexes: dict[int, Index]):
    """pairs(x, y): those of the group's pairs, as places in it, that are to be looked at in this task and no other; and the group's index and codes."""
    i, j, bucket = (int(table.column(c)[a].as_py()) for c in ("_i", "_j", "bucket"))
    own = table.column("_b").slice(a, e - a).to_numpy()
    index = list(indexes.values())[bucket >> _DIMENSION_AT]
    codes = index.unpacked(np.frombuffer(b"".join(table.column("code").slice(a, e - a).to_pylist()), np.uint8).reshape(e - a, -1))
    keys, which = index.keys_of(codes), bucket >> _TABLE_AT & (1 << _DIMENSION_AT - _TABLE_AT) - 1

    def pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if i != j:
            cross = own[x] != own[y]
            x, y = x[cross], y[cross]
        if len(x):  # a pair counts in the first table whose key both share
            first = np.argmax(keys[x] == keys[y], 1) == which
            x, y = x[first], y[first]
        return x, y

    return pairs, index, codes


def _near_codes(indexes):
    """Of each task's rows those that have another within the radius, as they are."""

    def near(batches):
        for table, at in runs(batches, ("bucket", "_i", "_j"), 2048):
            stays = np.zeros(table.num_rows, bool)
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                pairs, index, codes = _pairs(table, a, e, indexes.value)
                signs = np.where(codes, 1, -1).astype(np.float32)
                x, y = pairs(*np.nonzero(np.triu(signs @ signs.T >= codes.shape[1] - 2 * index.radius, 1)))
                stays[a + x] = True
                stays[a + y] = True
            kept = table.filter(pa.array(stays)).combine_chunks()
            yield from kept.to_batches()

    return near


def _compare(indexes, threshold: float):
    """vec, n, root: links found in a task with exact cosines, and the smallest vec reached in it."""

    def compare(batches):
        for table, at in runs(batches, ("bucket", "_i", "_j"), 2048):
            ids, weight = table.column("vec").to_numpy(), table.column("weight").to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                u = unit_vectors(next(_parts(table.column("embedding").slice(a, e - a)))[2])
                x, y = _pairs(table, a, e, indexes.value)[0](*np.nonzero(np.triu(u @ u.T >= threshold, 1)))
                if not len(x):
                    continue
                n = np.bincount(x, weight[a + y], e - a) + np.bincount(y, weight[a + x], e - a)
                root = np.arange(e - a)
                while True:  # smallest member reached, within the task
                    low = root.copy()
                    np.minimum.at(low, x, root[y])
                    np.minimum.at(low, y, root[x])
                    low = low[low]
                    if (low == root).all():
                        break
                    root = low
                some = np.flatnonzero(n)
                found.append((ids[a + some], n[some].astype(np.int64), ids[a + root[some]]))
            cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["vec", "n", "root"])

    return compare


def _compare_all(threshold: float, tile: int = 256):
    """vec, n, root, as _compare() has them, of groups in which each two vectors of the task's blocks are looked at."""

    def compare(batches):
        for table, at in runs(batches, ("bucket", "_i", "_j"), 2048):
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                rows = table.slice(a, e - a)
                u = unit_vectors(next(_parts(rows.column("embedding")))[2])
                ids, weight, own = rows.column("vec").to_numpy(), rows.column("weight").to_numpy(), rows.column("_b").to_numpy()
                i, j = int(rows.column("_i")[0].as_py()), int(rows.column("_j")[0].as_py())
                left, right = (np.flatnonzero(own == b) for b in (i, j))
                n, root = np.zeros(len(u), np.int64), np.arange(len(u))
                for k in range(0, len(left), tile):
                    x = left[k : k + tile]
                    y = right if i != j else right[k:]
                    hits = u[x] @ u[y].T >= threshold
                    if i == j:
                        hits &= np.arange(len(y)) > np.arange(len(x))[:, None]
                    n[x] += hits @ weight[y]
                    n[y] += weight[x] @ hits
                    for row in np.flatnonzero(hits.any(1)).tolist():
                        met = root[y[hits[row]]]
                        if (met != root[x[row]]).any():
                            met = np.append(np.unique(met), root[x[row]])
                            root[np.isin(root, met)] = met.min()
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[some], n[some], ids[root[some]])], names=["vec", "n", "root"])

    return compare


def _digests(batches):
    """vec_id and a 128-bit digest of the vector's components, which equal vectors share (null: null)."""
    for b in batches:
        column = b.column(1)
        out = np.full(b.num_rows, None, object)
        some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        for _, at, vectors in _parts(column.take(pa.array(some))) if len(some) else ():
            plain = vectors + 0.0  # no negative zeros
            out[some[at]] = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in plain]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "digest"])


def _with_digests(batches):
    """digest, embedding of rows of valid vectors."""
    for b in batches:
        for named in _digests([b]):
            yield pa.RecordBatch.from_arrays([named.column(1), b.column(1)], names=["digest", "embedding"])


def near_vectors(rows: DataFrame, threshold: float = 0.9, block: int = 1024, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links are pairs found with a cosine of threshold and more.

    rows: vec_id, embedding (array of float or double); other columns are not used. A vector that is null, zero, or holds
    a null or non-finite component links with nothing, nor do vectors of different dimensions. Vectors of equal components
    count as one in the search, with its number as weight. Rows are vectors of their own whatever their vec_id: rows of one
    vec_id have each their vector's links, and a row with null vec_id links and is counted as others are; its component is
    the smallest vec_id reached, null if none is. An empty table gives an empty table.

    Candidates share a key of a table of the multi-index, and their codes lie within its radius; only these candidates
    fetch their vectors, and cosines are taken in double precision from those. Dimensions whose codes cannot promise the
    recall are compared whole, in pairs of large blocks. A hot bucket is compared in pairs of blocks too, and tasks hand on
    counts and one edge for a vector, never pairs.
    """
    given = rows.select("vec_id", "embedding")
    named = stored(given.select("vec_id", F.when(is_valid(F.col("embedding")), F.col("embedding")).alias("embedding")).mapInArrow(_digests, "vec_id long, digest binary"), "vector-digests")
    kind = given.schema["embedding"].dataType.simpleString()
    digested = given.filter(is_valid(F.col("embedding"))).mapInArrow(_with_digests, f"digest binary, embedding {kind}")
    vectors = digested.groupBy("digest").agg(F.first("embedding").alias("embedding"), F.count("*").alias("weight"))
    vectors = stored(vectors.select(F.monotonically_increasing_id().alias("vec"), "digest", "weight", "embedding"), "vectors")
    dimension = F.size("embedding")
    indexes = {}
    for d, n in sorted(vectors.groupBy(dimension.alias("d")).count().collect()):
        sample = vectors.filter(dimension == d).orderBy(F.xxhash64("digest"), "vec").limit(SAMPLE).select("embedding").toArrow()
        if index := learn(unit_vectors(_matrix(sample.column(0), d)), n, threshold):
            indexes[d] = index
    shared = rows.sparkSession.sparkContext.broadcast(indexes)  # rotations alone
    coded = vectors.filter(dimension.isin(*indexes)).select("vec", "embedding").mapInArrow(_encode(shared), "vec long, bucket long, code binary")
    dealt = paired_blocks(coded, group_sizes(coded, "bucket"), "bucket", "size", "vec", block).select("bucket", "_i", "_j", "_b", "vec", "code")
    near = stored(dealt.mapInArrow(_near_codes(shared), "bucket long, _i int, _j int, _b int, vec long, code binary"), "vector-candidates")
    met = near.join(vectors.select("vec", "weight", "embedding"), "vec").repartition("bucket", "_i", "_j").sortWithinPartitions("bucket", "_i", "_j")
    found = met.select("bucket", "_i", "_j", "_b", "vec", "code", "weight", "embedding").mapInArrow(_compare(shared, threshold), "vec long, n long, root long")
    whole = vectors.filter(~dimension.isin(*indexes)).select(dimension.cast("long").alias("bucket"), "vec", "weight", "embedding")
    large = F.greatest(F.lit(1), F.least(F.lit(block_vectors), F.floor(F.lit(BLOCK_COMPONENTS) / F.col("bucket"))))
    whole = paired_blocks(whole, group_sizes(whole, "bucket"), "bucket", "size", "vec", large).select("bucket", "_i", "_j", "_b", "vec", "weight", "embedding")
    found = stored(found.unionByName(whole.mapInArrow(_compare_all(threshold), "vec long, n long, root long")), "vector-links")
    groups = components(found.select(F.col("vec").alias("u"), F.col("root").alias("v")))
    least = named.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"))
    lead = vectors.select("vec", "digest", "weight").join(least, "digest").join(found.groupBy("vec").agg(F.sum("n").alias("n")), "vec", "left").join(groups, F.col("vec") == F.col("id"), "left")
    lead = stored(lead.select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec").alias("component"), "least", "weight"), "vector-leads")
    smallest = stored(lead.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "vector-components")
    lead = split_join(lead, smallest, "component", "members", "digest", vectors.count()).select("digest", "n_links", "component_id", "weight")
    plain = named.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    n_rows = lead.agg(F.sum("weight")).first()[0] or 0
    linked = split_join(named.filter("digest is not null"), lead, "digest", "weight", "vec_id", n_rows).select("vec_id", "n_links", "component_id")
    return plain.union(linked).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
