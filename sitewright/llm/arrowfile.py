"""Token sequences of one length in Arrow stream files: fixed-size-list batches of ids and masks, with an index of documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import Ranges, stored, unique_ids, with_text
from sitewright.llm.tokens import encoder

#: Tokens of a sequence; sequences of a record batch; documents of a batch of the index.
LENGTH, BATCH, INDEX_ROWS = 2048, 128, 1 << 16
#: Bytes of text in a shard, on average; what a document counts beside its text.
SHARD_BYTES, ROW_BYTES = 256 << 20, 32
MANIFEST = "shard long, path string, index_path string, n_docs long, n_tokens long"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def schema(kind: np.dtype, length: int) -> pa.Schema:
    """Masks are bytes, 0 or 1, so both columns are read without a copy."""
    return pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(kind), length)), pa.field("mask", pa.list_(pa.uint8(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """One stream file and its index file; under names that no other attempt of the task uses."""

    def __init__(self, folder: str, shard: int, kind: np.dtype, length: int, batch: int):
        stem = f"{folder.rstrip('/')}/shard-{shard}-{uuid.uuid4().hex}"
        self.path, self.index_path = f"{stem}.arrows", f"{stem}.index.arrows"
        self.sink, self.index_sink = (self._open(p) for p in (self.path, self.index_path))
        self.kind, self.length, self.most = kind, length, length * batch
        self.schema = schema(kind, length)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.index = pa.ipc.new_stream(self.index_sink, INDEX)
        self.held, self.n_held, self.total = [], 0, 0
        self.docs: list[tuple] = []
        self.n_docs = 0

    @staticmethod
    def _open(path: str):
        fs, at = _file_system(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(at)

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.docs.append((doc_id, self.total, n))
        self.total += n
        self.held.append(ids)
        self.n_held += n
        if self.n_held >= self.most:
            self._flush(False)
        if len(self.docs) >= INDEX_ROWS:
            self._flush_index()

    def _flush_index(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.docs, strict=True)], schema=INDEX))
        self.n_docs, self.docs = self.n_docs + len(self.docs), []

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.kind)
        whole = len(flat) if last else len(flat) // self.most * self.most
        for at in range(0, whole, self.most):
            part = flat[at : min(at + self.most, whole)]
            rows = -(-len(part) // self.length)
            ids, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, np.uint8)
            ids[: len(part)], mask[: len(part)] = part, 1
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        rest = flat[whole:].tobytes()
        self.held, self.n_held = [rest], len(rest) // self.kind.itemsize

    def close(self) -> dict:
        self._flush(True)
        if self.docs:
            self._flush_index()
        for f in (self.out, self.sink, self.index, self.index_sink):
            f.close()
        return {"path": self.path, "index_path": self.index_path, "n_docs": self.n_docs, "n_tokens": self.total}


class Shard:
    """Random access to a shard's sequences and documents; zero-copy where the file can be mapped to memory.

    All batches but the last have the same number of rows, so their messages have the same size, and the place of the k-th
    is known from that of the first two.
    """

    def __init__(self, path: str, index_path: str):
        fs, at = _file_system(path)
        self.index_path = index_path
        self.source = pa.memory_map(at) if fs.type_name == "local" else fs.open_input_file(at)
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.source.tell()
        self.length = self.schema.field("ids").type.list_size
        self.rows_in_batch = self._read().num_rows
        self.step = self.source.tell() - self.first
        # The stream ends with eight bytes.
        self.n_batches = -(-(self.source.size() - 8 - self.first) // self.step)

    def _read(self) -> pa.RecordBatch:
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.first + k * self.step)
        return self._read()

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (booleans) of the k-th sequence."""
        b = self.batch(k // self.rows_in_batch)
        at = k % self.rows_in_batch * self.length
        ids, mask = (c.values.to_numpy(zero_copy_only=True)[at : at + self.length] for c in b.columns)
        return ids, mask.view(bool)

    def index(self) -> Iterator[pa.RecordBatch]:
        """doc_id, start, n_tokens of the documents in the order written, in batches."""
        fs, at = _file_system(self.index_path)
        with fs.open_input_stream(at) as f, pa.ipc.open_stream(f) as batches:
            yield from batches

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from start on, in parts that are not copied; padding comes after all of a shard's documents."""
        step = self.rows_in_batch * self.length
        while n:
            if start // step != self._at:
                self._at = start // step
                self._flat = self.batch(self._at).column(0).values.to_numpy(zero_copy_only=True)
            part = self._flat[start % step : start % step + n]
            yield part
            start, n = start + len(part), n - len(part)

    _at, _flat = -1, np.zeros(0)


def write_sequences(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Writes every document's ids, in ascending doc_id order, as sequences of `length`; returns the manifest of shards.

    docs: doc_id, text; other columns are not used. Each text is encoded whole (null: empty) and end_id put after it; the
    stream of all ids is cut in equal sequences within a shard, the last of a shard being padded under a false mask.
    Rows of one doc_id keep together, ordered by text; null doc_ids come first. An empty table gives an empty manifest.
    Shards are ranges of doc_id, by the bytes of text, named by the least doc_id that a range could hold. Texts
    are encoded where they lie, and their ids move, compressed. A shard's files are named anew by every attempt and the manifest is a
    table in the shared folder that lists those of the attempt that ended well, so a lost executor leaves at most stray files.
    """
    rows, numbered = unique_ids(with_text(docs, "doc_id"))
    rows = rows.select("doc_id", "text", F.col("given_id" if numbered else "doc_id").alias("given_id"))
    ranges = Ranges(rows.select("doc_id", F.octet_length("text") + ROW_BYTES), SHARD_BYTES)

    kind = encoder(tokenizer_path).kind

    def encode(batches):
        code, codec = encoder(tokenizer_path), pa.Codec("zstd", 1)
        end = np.array([end_id], code.kind).tobytes()
        for b in batches:
            sizes, packed = [], []
            for text in b.column(1):
                ids = code.encode(text.as_py()) + end
                sizes.append(len(ids))
                packed.append(codec.compress(ids, asbytes=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "given_id", "size", "ids"])

    def write(batches):
        codec = pa.Codec("zstd")
        names = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        at, out = None, None
        for b in batches:
            for shard, doc_id, size, ids in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                if out and shard != at:
                    yield pa.RecordBatch.from_pylist([{"shard": at, **out.close()}], schema=names)
                    out = None
                at, out = shard, out or ShardWriter(folder, shard, kind, length, batch)
                out.add(doc_id, codec.decompress(ids.as_buffer(), size, asbytes=True))
        if out:
            yield pa.RecordBatch.from_pylist([{"shard": at, **out.close()}], schema=names)

    encoded = rows.mapInArrow(encode, "doc_id long, given_id long, size long, ids binary")
    placed = ranges.place(encoded, "doc_id", "shard").repartition(ranges.number, "shard").sortWithinPartitions("shard", "doc_id")
    placed = placed.select("shard", "given_id", "size", "ids")
    return stored(placed.mapInArrow(write, MANIFEST), "sequence-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest (one row a shard) with start: the ids in all shards before."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    shards = with_starts(manifest).select("path", "index_path", "start").repartition(max(1, manifest.count()))

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["path"], row["index_path"])
                for docs in shard.index():
                    starts, crcs = docs.column(1).to_numpy(), []
                    for start, n in zip(starts.tolist(), docs.column(2).to_pylist(), strict=True):
                        crc = 0
                        for part in shard.ids(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    columns = [docs.column(0), pa.array(starts + row["start"]), docs.column(2), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
