"""A trie of conversations' turns: partial tries of tasks, merged by hash keys, then sums from the leaves up."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import split_join, stored

#: Conversations of one hundred share the first turns of their first one; at most so many, less one.
FAMILY, HEADS = 100, 6
#: Nodes that a task's partial trie holds before it is handed on; parts that a node's partial sums meet in at first.
LOCAL, FAN = 1 << 17, 16
#: conv_ids of one piece of an end list.
PIECE_BITS = 12
#: The key of the root; another node's is the digest of its parent's key and its turn.
ROOT = b"\0" * 16


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a rebuilt conversation has from the first one of its family: 0 to 5."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes of SHA-256 of a turn, in which the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def _rebuilt(batches):
    """Rows (conv_id, depth, key, parent, chars, ends) of each rebuilt conversation's nodes from the root on.

    Turns come sorted by family, the family's first conversation before the others, then by conversation and turn. Of a
    family the first few turns are held, of a conversation the node that it has reached.
    """
    names = ["conv_id", "depth", "key", "parent", "chars", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    out: list[tuple] = []
    family = conv = last = None
    first: list[tuple[bytes, int]] = []
    place = 0

    def step(digest, chars):
        nonlocal last
        out.append((*last, False))
        key = hashlib.blake2b(last[2] + digest, digest_size=16).digest()
        last = (conv, last[1] + 1, key, last[2], chars)

    for b in batches:
        for own_family, c, shared, digest, chars in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if own_family != family:
                family, first = own_family, []
            if c != conv:
                if last:
                    out.append((*last, True))
                conv, place, last = c, 0, (c, 0, ROOT, None, 0)
                for d, n in first[:shared] if c != family else ():
                    step(d, n)
            if c == family:
                if len(first) < HEADS - 1:
                    first.append((digest, chars))
                step(digest, chars)
            elif place >= shared:
                step(digest, chars)
            place += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)
        out = []
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*last, True), kinds, strict=True)], names=names)


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """The nodes that each rebuilt conversation goes through: conv_id, depth, key, parent, chars, ends (true for its last)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        family.alias("family"), F.col("conv_id").alias("conv"), shared_turns(F.col("conv_id")).alias("shared"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"), F.col("turn").alias("at"), role.alias("role")
    )
    order = ["family", (F.col("conv") != F.col("family")), "conv", F.col("at").asc_nulls_first(), "role", "digest"]
    dealt = rows.repartition("family").sortWithinPartitions(*order)
    return dealt.select("family", "conv", "shared", "digest", "chars").mapInArrow(_rebuilt, "conv_id long, depth long, key binary, parent binary, chars long, ends boolean")


def _partial_tries(batches):
    """Rows (key, depth, parent, chars, least, n, ends) of a task's own trie."""
    names = ["key", "depth", "parent", "chars", "least", "n", "ends"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    nodes: dict[bytes, list] = {}

    def table():
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*((k, *v) for k, v in nodes.items()), strict=True), kinds, strict=True)], names=names)

    held = 0
    for b in batches:
        for c, depth, key, parent, chars, ends in zip(*(x.to_pylist() for x in b.columns), strict=True):
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = [depth, parent, chars, c, 0, []]
                held += 1
            node[3] = min(node[3], c)
            node[4] += 1
            if ends:
                node[5].append(c)
                held += 1
        if held >= LOCAL:
            yield table()
            nodes.clear()
            held = 0
    if nodes:
        yield table()


def merged_nodes(partial: DataFrame) -> DataFrame:
    """key, depth, parent, chars, conv_id, n_convs of the whole trie: partial nodes are summed in FAN parts, then in one."""

    def merge(rows: DataFrame, *keys) -> DataFrame:
        same = [F.any_value(c).alias(c) for c in ("depth", "parent", "chars")]
        return rows.groupBy("key", *keys).agg(*same, F.min("least").alias("least"), F.sum("n").alias("n"))

    parts = merge(partial.withColumn("part", F.pmod(F.xxhash64("least", "n"), F.lit(FAN))), "part")
    return merge(parts).select("key", "depth", "parent", "chars", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"))


def _end_hashes(batches):
    """key, ends_sha256 from pieces of end lists that come sorted by key and place."""
    now = running = None
    for b in batches:
        done = []
        for key, piece in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])


def end_hashes(partial: DataFrame) -> DataFrame:
    """key, ends_sha256 of nodes where conversations end: lists are sorted in pieces of 4096 conv_ids, and pieces hashed in order."""
    ends = partial.select("key", F.explode("ends").alias("conv"))
    pieces = ends.groupBy("key", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_sort(F.collect_list("conv")).alias("convs"))
    text = pieces.select("key", "piece", F.array_join(F.col("convs").cast("array<string>"), ",").alias("convs"))
    return text.repartition("key").sortWithinPartitions("key", "piece").select("key", "convs").mapInArrow(_end_hashes, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens: sums over each node's subtree.

    nodes has n_children. A node belongs to its smallest member, whose nodes are the lower part of its path: the least
    member never falls on the way down. So sums run up each of these chains first, and each chain's whole sum is then
    added to the nodes of its path that lie above it. What moves is one row for each node of the conversations that own
    any, summed before it does.
    """
    own = nodes.select("key", "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    up = "PARTITION BY conv_id ORDER BY depth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    chains = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    below = own.select("key", F.expr(f"sum(saved) OVER ({up})").alias("saved"), F.expr(f"sum(leaf) OVER ({up})").alias("leaf"))
    above = paths.select("conv_id", "depth", "key").join(chains, "conv_id").filter(F.col("depth") < F.col("top")).select("key", "saved", "leaf")
    return below.union(above).groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text; other columns are not used, whatever their names. Null role and text count as empty.
    Rows without conv_id belong to no conversation and are left out. Turns of a conversation are ordered by turn (null
    first), then role, then the SHA-256 of role and text; repeated rows are turns of their own. A conversation c has the
    first shared_turns(c) turns of conversation c - c % 100 in the place of as many of its own. An empty table gives an
    empty table, without a root.

    Sequences are told apart by 128-bit digests that chain those of their turns. Each task sums the nodes of its paths in
    a trie of its own, so what a node that all conversations share hands on is a row for each task.
    """
    paths = stored(rebuilt_paths(turns), "paths")
    kind = "key binary, depth long, parent binary, chars long, least long, n long, ends array<long>"
    partial = stored(paths.mapInArrow(_partial_tries, kind), "partial-tries")
    nodes = stored(merged_nodes(partial.drop("ends")), "nodes")
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "key", "left").fillna(0, ["n_children"]), "counted-nodes")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    below = split_join(nodes.filter(F.col("parent").isNotNull()), stored(parents, "parents"), "parent", "siblings", "key", nodes.count()).drop("siblings")
    every = below.unionByName(nodes.filter(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long")))
    sums = every.join(rolled_up(nodes, paths), "key").join(end_hashes(partial), "key", "left")
    return sums.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
