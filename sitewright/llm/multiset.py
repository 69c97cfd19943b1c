"""Homomorphic multiset fingerprints of documents, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import Ranges

#: Counters of likeness (two 30-bit counters in each long) and 32-bit lanes for equality.
LIKENESS_LANES, EQUAL_LANES = 256, 8
_HASHES = LIKENESS_LANES // 64
#: Pieces that are counted in bytes before they are in full: a byte of a signed long holds no more.
PART = 127
#: Bytes of text in a bucket of successive doc_ids, on average; what a row counts beside its text.
BUCKET_BYTES, ROW_BYTES = 8 << 20, 32
#: Paragraphs are lines. For likeness a line is cut in runs of at most eight words, a word longer than 16 in several. A run
#: ends at its line's end and before a word of 5 or 9 characters, so what comes before in the line moves few of its ends.
LINE = "\n"
_WORD, _END = r"(?:\S{1,16}+[^\S\n]*+|[^\S\n]++)", r"\n|\z|\S{5}(?!\S)|\S{9}(?!\S)"
RUN = f"(?:{_WORD}(?!{_END})){{0,7}}+{_WORD}"
_LOW = (1 << 30) - 1


def _part_sums() -> list[Column]:
    """Sums over at most PART pieces: each eighth bit of the hashes counts in a byte of its own, hashes of lines in the lanes for equality."""
    every_eighth = F.lit(0x0101010101010101)
    out = [F.sum(F.shiftright(f"h{j}", k).bitwiseAND(every_eighth)).alias(f"c{j}_{k}") for j in range(_HASHES) for k in range(8)]
    for j in range(EQUAL_LANES):
        h = F.col(f"e{j // 2}")
        out.append(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)) if j % 2 == 0 else F.shiftrightunsigned(h, 32)).alias(f"q{j}"))
    return out


def _sums() -> list[Column]:
    """Sums over parts: two counters, of the bits k and k + 32 of a hash, in each long.

    No sum can overflow: a text has fewer than 2**31 pieces, a counter grows by one and a lane by less than 2**32 for each.
    """
    out = []
    for j in range(LIKENESS_LANES // 2):
        k = j % 32
        count = lambda byte: F.shiftright(f"c{j // 32}_{k % 8}", 8 * byte).bitwiseAND(F.lit(255))  # noqa: B023, E731
        out.append(F.sum(count(k // 8) + F.shiftleft(count(k // 8 + 4), 32)).alias(f"s{j}"))
    return [*out, *[F.sum(f"q{j}").alias(f"q{j}") for j in range(EQUAL_LANES)]]


def _pieces(text: Column) -> Column:
    """array<struct<run, h0.., e0..e3>>: a piece is a run of words (e: 0) or a whole line (h: 0, not counted)."""
    zero = F.lit(0).cast("long")
    marks = lambda p: [F.xxhash64(p, F.lit(j)).alias(f"h{j}") for j in range(_HASHES)]
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda p: F.struct(F.lit(1).alias("run"), *marks(p), *[zero.alias(f"e{j}") for j in range(EQUAL_LANES // 2)]))
    lines = F.transform(F.split(text, LINE, -1), lambda p: F.struct(F.lit(0).alias("run"), *[zero.alias(f"h{j}") for j in range(_HASHES)], *[F.xxhash64(p, F.lit(_HASHES + j)).alias(f"e{j}") for j in range(EQUAL_LANES // 2)]))
    return F.concat(runs, lines)


def fingerprints(texts: DataFrame, *keys: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keys, text -> keys, keep (columns that keys decide), n_runs, counters array<long>, lanes array<long>; keys must be unique.

    Numbers alone in keys and keep let the sums be made by hash; with strings all pieces are sorted first.
    All of it is a sum over the text's paragraphs (lines): of wide vectors that the hashes of each paragraph and of its
    runs give, modulo powers of two; no run crosses lines. So the order of paragraphs does not matter, and a paragraph
    that is put in or taken out adds or takes its own vector: see combine(). Null text counts as empty.
    """
    pieces = texts.select(*keys, *keep, F.posexplode(_pieces(F.coalesce("text", F.lit("")))).alias("_at", "p")).select(*keys, *keep, F.floor(F.col("_at") / PART).cast("int").alias("_part"), "p.*")
    same = [F.first(k).alias(k) for k in keep]
    parts = pieces.groupBy(*keys, "_part").agg(*same, F.sum("run").alias("n_runs"), *_part_sums())
    sums = parts.groupBy(*keys).agg(*same, F.sum("n_runs").alias("n_runs"), *_sums())
    # The upper counters stand 32 bits up in the same long.
    counters = F.array(*[x for j in range(LIKENESS_LANES // 2) for x in (F.col(f"s{j}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"s{j}", 32).bitwiseAND(F.lit(_LOW)))])
    lanes = F.array(*[F.col(f"q{j}").bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(EQUAL_LANES)])
    return sums.select(*keys, *keep, "n_runs", counters.alias("counters"), lanes.alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint struct(n_runs, counters, lanes) of a with b's paragraphs put in (sign 1) or taken out (-1)."""
    return F.struct(
        (a["n_runs"] + sign * b["n_runs"]).alias("n_runs"),
        F.zip_with(a["counters"], b["counters"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW))).alias("counters"),
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(0xFFFFFFFF))).alias("lanes"),
    )


def as_text(lanes: Column, counters: Column) -> Column:
    """The lanes for equality in hex, then a 128-bit hash of the counters."""
    words = [F.lower(F.lpad(F.hex(F.get(lanes, F.lit(j))), 8, "0")) for j in range(EQUAL_LANES)]
    return F.concat(*words, *[F.lower(F.lpad(F.hex(F.xxhash64(counters, F.lit(k))), 16, "0")) for k in range(2)])


def _total(x: Column, use) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + use(v))


def moments(mark: Column) -> Column:
    """struct(total, norm): the sum of a fingerprint's counters, and that of their squares about n_runs / 2, times four."""
    n = mark["n_runs"].cast("double")
    total, squares = _total(mark["counters"], lambda c: c.cast("double")), _total(mark["counters"], lambda c: c.cast("double") * c)
    return F.struct(total.alias("total"), (4 * squares - 4 * n * total + LIKENESS_LANES * n * n).alias("norm"))


def likeness(a: Column, b: Column, of_a: Column | None = None, of_b: Column | None = None) -> Column:
    """0 to 1: cosine of the counters about their means, an estimate of the share of runs that both texts have.

    Each run of words is a vector of 256 signs; the sums' inner product estimates the size of the multisets'
    intersection with a standard error of about 1 / sqrt(256) = 0.06 of the texts' size. of_a, of_b: moments() of both,
    where they are there already.
    """
    of_a, of_b = (moments(x) if m is None else m for x, m in ((a, of_a), (b, of_b)))
    n, m = a["n_runs"].cast("double"), b["n_runs"].cast("double")
    product = _total(F.zip_with(a["counters"], b["counters"], lambda p, q: p.cast("double") * q), lambda v: v)
    dot = 4 * product - 2 * m * of_a["total"] - 2 * n * of_b["total"] + LIKENESS_LANES * n * m
    size = F.sqrt(of_a["norm"] * of_b["norm"])
    same = (a["lanes"] == b["lanes"]) & (a["counters"] == b["counters"])
    empty = (a["n_runs"] == 0) | (b["n_runs"] == 0)
    return F.when(same, F.lit(1.0)).when(empty | (size == 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / size)), 6))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text -> bucket, place, copy, doc_id, text, next_text: the text of the next row by descending doc_id (null last).

    After the last row comes the first. Rows of one doc_id are ordered by text. Rows are dealt to buckets of successive
    doc_ids, as many as the bytes of text ask for (`buckets`: so many), so no sort takes all rows to one task and tasks do
    not grow with the table. Each bucket ends with a copy of the next bucket's first row (copy is true there), which has no next_text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = Ranges(rows.select("doc_id", F.octet_length("text") + ROW_BYTES), BUCKET_BYTES, buckets)
    rows = ranges.place(rows, "doc_id", "bucket")
    # One row a bucket: its greatest doc_id, and the bucket that comes before it, whose last row it follows.
    order = Window.orderBy(F.col("bucket").desc())
    last = F.last("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).select(F.col("bucket").alias("_bucket"), "top", F.coalesce(F.lag("bucket").over(order), last).alias("before"))
    firsts = rows.join(F.broadcast(tops), F.col("bucket").eqNullSafe(F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("top")))  # a row of three numbers for each bucket, whose number Ranges bounds
    copies = firsts.groupBy("before").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("bucket"), F.lit(True).alias("copy"))
    every = rows.withColumn("copy", F.lit(False)).unionByName(copies).repartition(ranges.number, "bucket")
    w = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc(), "text")
    return every.select("bucket", F.row_number().over(w).alias("place"), "copy", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to that and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by descending doc_id. docs: doc_id, text; other columns are not used. Null text is empty; rows of one doc_id
    follow one another by text; rows with null doc_id come last in the order, in one bucket; repeated rows each give a
    row; an empty table gives an empty table. Texts are shuffled once and each is fingerprinted once, beside its edited form.
    """
    rows = with_next(docs, buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    own, other = (F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited")))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    # The digest goes along as four numbers.
    quarters = [F.conv(F.substring("_digest", 16 * k + 1, 16), 16, -10).cast("long").alias(f"d{k}") for k in range(4)]
    keep = ("doc_id", "n_chars", "d0", "d1", "d2", "d3")
    texts = rows.withColumn("_digest", digest).select("bucket", "place", "copy", "doc_id", n.cast("long").alias("n_chars"), *quarters, F.explode(F.when(F.col("copy"), F.array(own)).otherwise(F.array(own, other))).alias("k"))
    marks = fingerprints(texts.select("bucket", "place", "copy", *keep, "k.kind", "k.text"), "bucket", "place", "kind", keep=("copy", *keep))
    marks = marks.withColumn("of", moments(F.struct("n_runs", "counters")))
    mark = F.struct("n_runs", "counters", "lanes", "of")
    # After each text's own mark come that of its edited form and the next text's.
    w = Window.partitionBy("bucket").orderBy("place", "kind")
    by = marks.select("kind", "copy", *keep, mark.alias("m0"), F.lead(mark, 1).over(w).alias("m1"), F.lead(mark, 2).over(w).alias("m2")).filter((F.col("kind") == 0) & ~F.col("copy"))
    return by.select(
        "doc_id",
        "n_chars",
        F.concat(*[F.lower(F.lpad(F.hex(f"d{k}"), 16, "0")) for k in range(4)]).alias("edited_sha256"),
        as_text(F.col("m0.lanes"), F.col("m0.counters")).alias("fingerprint"),
        as_text(F.col("m1.lanes"), F.col("m1.counters")).alias("edited_fingerprint"),
        likeness(F.col("m0"), F.col("m1"), F.col("m0.of"), F.col("m1.of")).alias("near_edited"),
        likeness(F.col("m0"), F.col("m2"), F.col("m0.of"), F.col("m2.of")).alias("near_next"),
    )
