"""Helpers that the training-data operators share: tables, shared folders, byte slices of Arrow batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer single text makes a pass of its own.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A group of more than this part of all rows counts as hot.
HOT_PART = 1000


def split_join(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, n_rows: int) -> DataFrame:
    """rows joined with groups, which has one row for each value of key with its number of rows in the column size.

    A group of more than n_rows / HOT_PART rows is dealt to several tasks by the hash of spread: its row of groups stands
    in each of them. As n_rows is the sum of all sizes, such groups are HOT_PART at most, and those are broadcast; the rest
    is a merge join whatever the size of groups, so that plans do not change with it.
    """
    most = max(256, n_rows // HOT_PART)
    pieces = F.ceil(F.col(size) / most).cast("int")
    hot = F.broadcast(groups.filter(F.col(size) > most).select(F.col(key).alias("_hot"), pieces.alias("_pieces")))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_piece", F.pmod(F.xxhash64(spread, F.lit(3)), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_hot", "_pieces")
    every = groups.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.join(every.hint("merge"), [key, "_piece"]).drop("_piece")


#: Ranges of ids asked for at most, wherever rows are dealt by ranges. Those that are cut again are broadcast, a half at most.
MOST_RANGES = 1 << 19


class Ranges:
    """Ranges of a long id, each with a bounded part of all bytes: a row's range is named by the least id that it could hold.

    Ids are cut at multiples of a power of two, so a range is an expression of the id. Ranges with more than twice
    their part are cut again, within the ids that they do hold, until none of them can be. The driver gets three numbers;
    ranges to be cut again are tables in the shared folder.
    """

    def __init__(self, sizes: DataFrame, each: int, number: int | None = None):
        """sizes: id, size (bytes). each: bytes of a range, on average; number: ranges asked for, instead of that."""
        sizes = stored(sizes.toDF("id", "size").filter("id is not null"), "id-sizes", narrow=True)
        low, high, total = sizes.agg(F.min("id"), F.max("id"), F.sum("size")).first()
        if number is None:
            number = min(MOST_RANGES, max(2 * sizes.sparkSession.sparkContext.defaultParallelism, 1 + (total or 0) // each))
        self.number = number
        self.bits = 0 if low is None else ((high - low) // (2 * number)).bit_length()
        self.again: list[DataFrame] = []
        part = max(1, (total or 0) // number)
        while low is not None:
            held = self.place(sizes, "id", "low").groupBy("low").agg(F.sum("size").alias("size"), F.min("id").alias("a"), F.max("id").alias("b"))
            step = F.expr(f"(b - a) div (2 * (size div {part}))")
            large = held.filter((F.col("size") > 2 * part) & (F.col("a") < F.col("b"))).select("low", F.when(step > 0, F.length(F.bin(step))).otherwise(0).alias("bits"))
            large = stored(large, "large-ranges", narrow=True)
            if large.isEmpty():
                break
            self.again.append(large)

    def place(self, rows: DataFrame, id_column: str, name: str) -> DataFrame:
        """rows with their range; null for a null id."""
        at = lambda bits: F.call_function("shiftleft", F.call_function("shiftright", F.col(id_column), bits), bits)
        rows = rows.withColumn(name, at(F.lit(self.bits)))
        for large in self.again:
            cut = F.broadcast(large.select(F.col("low").alias("_low"), F.col("bits").alias("_bits")))
            rows = rows.join(cut, F.col(name) == F.col("_low"), "left").withColumn(name, F.when(F.col("_bits").isNull(), F.col(name)).otherwise(at(F.col("_bits")))).drop("_low", "_bits")
        return rows


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one is made only where that is unset, as in tests."""
    context = spark.sparkContext._jsc.sc()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="sitewright-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table of our own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage and survives lost executors.

    narrow: rows of a few numbers each, which go to four files a core at most however many partitions they come in.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Lets the session hand at most `rows` whole texts at a time to Python: batches are counted in rows, and texts are long."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_text(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns that an operator works on, null text as empty."""
    small_batches(docs)
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def unique_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id, text) with doc_ids that tell rows apart; whether they are new ones.

    Where doc_ids are unique already, nothing changes. Else rows are numbered in the order of doc_id (null first) and text,
    in a table in the shared folder that has the old id as given_id.
    """
    ids = docs.groupBy("doc_id").count()
    if ids.filter((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty():
        return docs, False
    rows = docs.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return stored(rows.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("doc_id").alias("given_id")), "numbered"), True


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """(first row, rows, bytes as uint8, offsets from 0) for runs of rows of about most bytes; without copies of the bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind, count=n + 1, offset=col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end - row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Hashes of byte strings are values of polynomials modulo a prime, in a base that is a number without structure: two
#: different strings of n bytes agree for n of the 2**61 bases at most.
PRIME, BASE = (1 << 61) - 1, 0x12A5C3F0E9B7D46B
_PRIME, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61, _1 = (np.uint64(k) for k in (30, 31, 61, 1))
#: Bytes that one pass of hashing works on.
HASH_BYTES = 1 << 16
_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for any 64-bit x."""
    x = (x & _PRIME) + (x >> _61)
    return x - (x >= _PRIME) * _PRIME


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME of values below it. 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For i < n at least: the upper 30 and lower 31 bits of BASE**i, and BASE**-i."""
    size = max(2 * HASH_BYTES, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _POWERS:
        both = []
        for base in (BASE, pow(BASE, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, _times(out, np.uint64(pow(base, len(out), PRIME)))])
            both.append(out)
        _POWERS.clear()
        _POWERS[size] = both[0] >> _31, both[0] & _LOW31, both[1]
    return _POWERS[size]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    high, low, down = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    for a in range(0, n, HASH_BYTES):  # sums of so many values stay below 2**64
        v = data[a : a + HASH_BYTES].astype(np.uint64) + _1
        e = a + len(v)
        h, l = np.cumsum(v * high[a:e], dtype=np.uint64), np.cumsum(v * low[a:e], dtype=np.uint64)  # noqa: E741
        prefix[a + 1 : e + 1] = _reduced((h >> _30) + ((h & _LOW30) << _31) + l + prefix[a])
    return mixed(_times(_reduced(prefix[end] + (_PRIME - prefix[start])), down[start]))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte strings data[start:end], both in order; equal strings have equal hashes wherever they lie.

    They place strings and make candidates; whether strings are equal is decided by their bytes, or by a digest of them.
    """
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + HASH_BYTES, "right")))
        first = start[a]
        out[a:b] = _hashes(data[first : end[b - 1]], start[a:b] - first, end[a:b] - first)
        a = b
    return out


def words_of(data: np.ndarray, offs: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts laid end to end: bytes with one space between words of a text, start and end
    of each word in them, and offsets of each text's words."""
    n = len(data)
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cut = offs[:-1][offs[:-1] < n]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cut = offs[1:-1]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    keep = inside.copy()
    keep[end[end < n]] = True
    place = np.append(0, np.cumsum(keep))
    return np.where(space, np.uint8(32), data)[keep], place[start], place[end], np.searchsorted(start, offs)
