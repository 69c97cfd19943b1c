"""Phrase collocations by suffix-sigma: truncated suffixes sorted by first word, all prefixes counted in one pass, parts joined after."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import mixed, small_batches, split_join, stored, text_slices

#: Words of a phrase at most; occurrences that a candidate needs; rows of a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bytes that end a piece, and bytes between words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: The vocabulary that tasks hold: so many of the most frequent words of all languages, of so many bytes each at most. Words
#: that are frequent enough for a candidate but not in it travel as text, so all results are the same whatever the bounds.
MOST_WORDS, WORD_BYTES = 1 << 18, 256
#: Suffixes that a task sorts at a time; suffixes of a bucket, on average and at most for one first word.
CHUNK, BUCKET = 1 << 20, 1 << 20
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_ENDS)] = 2


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of texts laid end to end, A-Z lower-cased; whether each is the first of its piece."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    kind = _KIND[data]
    inside = kind == 0
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < len(data)]
    new[at] |= inside[at]
    start = np.flatnonzero(new)
    if not len(start):
        return pa.array([], pa.large_binary()), np.zeros(0, bool)
    ends = np.zeros(len(data) + 1, np.int64)  # piece and text ends before each byte
    ends[1:] = np.cumsum(kind == 2)
    piece = ends[start] + np.searchsorted(at, start, "right")
    first = np.ones(len(start), bool)
    first[1:] = piece[1:] != piece[:-1]
    places = np.append(np.cumsum(inside) - inside, inside.sum())
    offsets = np.append(places[start], places[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return words, first


def _chunks(batches):
    """(language, words, first of piece, words that may start a suffix): what a task has of each language, in bounded parts.

    The words after those that may start a suffix are there to be its ends; they start suffixes in the next part.
    """
    held: dict[str, list] = {}

    def cut(lang):
        words, first = pa.chunked_array([w for w, _ in held[lang]]).combine_chunks(), np.concatenate([x for _, x in held[lang]])
        held[lang] = []
        for a in range(0, len(words), CHUNK):
            yield lang, words.slice(a, CHUNK + LONGEST - 1), first[a : a + CHUNK + LONGEST - 1], min(CHUNK, len(words) - a)

    n: dict[str, int] = {}
    for b in batches:
        langs = b.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = b.filter(pa.array(langs.indices.to_numpy() == k))
            for _, _, data, offs in text_slices(own, "text", 1 << 22):
                words, first = words_of(data, offs)
                if len(words):
                    held.setdefault(lang, []).append((words, first))
                    n[lang] = n.get(lang, 0) + len(words)
        while n and sum(n.values()) >= CHUNK:
            most = max(n, key=n.get)
            n.pop(most)
            yield from cut(most)
    for lang in n:
        yield from cut(lang)


def _word_counts(batches):
    """Rows (lang, word, f) of each part's words; a row without a word has the number of all of them."""
    for lang, words, _, n in _chunks(batches):
        counts = words.slice(0, n).value_counts()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(counts) + 1)), pa.array([None, *counts.field(0).to_pylist()], pa.binary()), pa.array([n, *counts.field(1).to_pylist()], pa.int64())], names=["lang", "word", "f"])


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word (bytes), f of words that occur at least so often in their language, and a row without word for all words."""
    rows = docs.select("lang", "text").mapInArrow(_word_counts, "lang string, word binary, f long")
    counts = rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return stored(counts.filter((F.col("f") >= least) | F.col("word").isNull()), "word-counts")


class Vocabulary:
    """Codes from 1 on of the most frequent words, those that are hot, and whether all frequent words are there."""

    def __init__(self, rows: list, complete: bool, hot_above: int):
        self.codes: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = [b""]
        for lang, word, _ in rows:
            self.codes.setdefault(lang, {})[bytes(word)] = len(self.words)
            self.words.append(bytes(word))
        self.complete = complete
        self.hot = np.array([False, *(f > hot_above for _, _, f in rows)])


def vocabulary(counts: DataFrame, bucket: int, most: int = MOST_WORDS) -> tuple[Vocabulary, int]:
    """The vocabulary, and the number of buckets that hold `bucket` suffixes each. A word that starts more is hot."""
    total, frequent = counts.agg(F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("f"))), F.lit(0)), F.count("word")).first()
    fitting = counts.filter(F.octet_length("word") <= WORD_BYTES)
    rows = fitting.orderBy(F.col("f").desc(), "lang", "word").limit(most).collect()  # MOST_WORDS words of WORD_BYTES bytes
    return Vocabulary([tuple(r) for r in rows], len(rows) == frequent, bucket), total // bucket + 1


def _packed(columns: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Columns of codes in as few 64-bit keys as their bits need, in the same order."""
    each = 63 // bits
    keys = []
    for k in range(0, len(columns), each):
        key = columns[k].astype(np.int64)
        for c in columns[k + 1 : k + each]:
            key = key << bits | c
        keys.append(key)
    return keys


def _reverse_sorted(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of codes in descending order, equal ones as one with their weights' sum."""
    if not len(weight):
        return columns, weight
    bits = max(1, int(max(c.max() for c in columns)).bit_length())
    keys = _packed(columns, bits)
    order = (np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1]))[::-1]
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return [c[order[at]] for c in columns], np.add.reduceat(weight[order], at)


def _suffixes(shared, buckets: int):
    """Rows (bucket, lang, words, block): truncated suffixes of a part that fall in a bucket, sorted, with their numbers.

    A suffix falls in the bucket of its language and first word; where that is hot, of its words up to the first that is
    not. So a bucket holds as many suffixes of one word as that has occurrences, and no hot one. Suffixes end before a
    word that is too rare for any candidate. words: those of the block without a code, joined by blanks.
    """

    def suffixes(batches):
        vocab = shared.value
        for lang, words, first, n in _chunks(batches):
            encoded = words.dictionary_encode()
            distinct = encoded.dictionary.to_pylist()
            codes = vocab.codes.get(lang, {})
            code = np.array([codes.get(w, 0) for w in distinct], np.int64)
            new = np.flatnonzero(code == 0) if not vocab.complete else np.zeros(0, np.int64)
            code[new] = len(vocab.words) + np.arange(len(new))  # of this part alone
            hot = np.zeros(len(vocab.words) + len(new), bool)
            hot[: len(vocab.words)] = vocab.hot
            mark = mixed(np.arange(len(hot), dtype=np.uint64))  # codes are those of words in their language
            mark[len(vocab.words) :] = [int.from_bytes(hashlib.blake2b(lang.encode() + b"\n" + distinct[k], digest_size=8).digest(), "little") for k in new.tolist()]
            at = code[encoded.indices.to_numpy()]
            columns, there = [], np.ones(n, bool)
            for k in range(LONGEST):
                column = np.zeros(n, np.int32)
                own = at[k : k + n]
                there[len(own) :] = False
                there[: len(own)] &= own > 0
                if k:
                    there[: len(own)] &= ~first[k : k + n]
                column[: len(own)] = np.where(there[: len(own)], own, 0)
                columns.append(column)
            some = columns[0] > 0
            columns, weight = _reverse_sorted([c[some] for c in columns], np.ones(int(some.sum()), np.int64))
            if not len(weight):
                continue
            place, further = mark[columns[0]], hot[columns[0]]
            for c in columns[1:]:
                further &= c > 0
                place = np.where(further, (place ^ mark[c]) * np.uint64(0x9E3779B97F4A7C15), place)
                further &= hot[c]
            bucket = ((place >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = []
            for own in np.split(order, cut[1:]):
                block = np.stack([*(c[own] for c in columns), weight[own]])
                text = b""
                if len(new):
                    used = np.unique(block[:LONGEST])
                    used = used[used >= len(vocab.words)]
                    block[:LONGEST] = np.where(block[:LONGEST] >= len(vocab.words), len(vocab.words) + np.searchsorted(used, block[:LONGEST]), block[:LONGEST])
                    text = b" ".join(distinct[k] for k in new[used - len(vocab.words)].tolist())
                rows.append((int(bucket[own[0]]), lang, text, pa.compress(block.astype("<u4").tobytes(), "zstd", asbytes=True), block.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()], strict=True)], names=["bucket", "lang", "words", "block", "n"])

    return suffixes


def _prefix_counts(shared, least: int):
    """Rows (lang, phrase, size, f): all prefixes of a bucket's suffixes that occur at least so often.

    Suffixes come in descending order, so a stack of the words that a suffix shares with the one before would pop a prefix
    where its run ends; the runs of all lengths are found at once. Prefixes of hot words alone may lie in other buckets
    too and are handed on whatever their number.
    """

    def counted(lang, own, vocab):
        extra: dict[bytes, int] = {}
        parts = []
        for words, block, n in own:
            part = np.frombuffer(pa.decompress(block, decompressed_size=4 * n * (LONGEST + 1), codec="zstd", asbytes=True), "<u4").reshape(LONGEST + 1, n).astype(np.int32)
            if words:
                places = np.array([extra.setdefault(w, len(extra)) for w in words.split(b" ")], np.int64) + len(vocab.words)
                codes = part[:LONGEST]
                codes[codes >= len(vocab.words)] = places[codes[codes >= len(vocab.words)] - len(vocab.words)]
            parts.append(part)
        whole = np.concatenate(parts, 1)
        columns, weight = _reverse_sorted(list(whole[:LONGEST]), whole[LONGEST])
        names = [*vocab.words, *extra]
        hot = np.zeros(len(names), bool)
        hot[: len(vocab.words)] = vocab.hot
        new, partial = np.zeros(len(weight), bool), np.ones(len(weight), bool)
        new[0] = True
        out = []
        for k, column in enumerate(columns):
            new[1:] |= column[1:] != column[:-1]
            partial &= hot[column]
            at = np.flatnonzero(new)
            f = np.add.reduceat(weight, at)
            kept = (column[at] > 0) & ((f >= least) | partial[at])
            rows = np.stack([c[at[kept]] for c in columns[: k + 1]], 1).tolist()
            out += [(lang, b" ".join([names[c] for c in row]).decode(), k + 1, n) for row, n in zip(rows, f[kept].tolist(), strict=True)]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["lang", "phrase", "size", "f"])

    def counts(batches):
        now, own, vocab = None, [], shared.value
        for b in batches:
            for bucket, lang, words, block, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, lang) != now:
                    if own:
                        yield counted(now[1], own, vocab)
                    now, own = (bucket, lang), []
                own.append((words, block, n))
        if own:
            yield counted(now[1], own, vocab)

    return counts


def frequent_phrases(docs: DataFrame, least: int = LEAST, bucket: int = BUCKET, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, f of all phrases of up to LONGEST words that occur `least` times and more; and lang, n (all words)."""
    small_batches(docs)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = word_counts(texts, least)
    vocab, buckets = vocabulary(counts, bucket, most_words)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    blocks = texts.mapInArrow(_suffixes(shared, buckets), "bucket long, lang string, words binary, block binary, n long")
    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket", "lang")
    found = dealt.mapInArrow(_prefix_counts(shared, least), "lang string, phrase string, size int, f long")
    phrases = found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(phrases, "frequent-phrases"), counts.filter("word is null").select("lang", F.col("f").alias("n"))


def _with_part(cuts: DataFrame, phrases: DataFrame, part: str, as_name: str, n_cuts: int) -> DataFrame:
    """cuts with the number of occurrences of the part in that column; parts that many cuts have are dealt to many tasks."""
    sizes = cuts.groupBy("lang", part).agg(F.count("*").alias("_size"))
    counted = phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(as_name)).join(sizes, ["lang", part])
    keyed = counted.select(F.struct("lang", part).alias("_key"), "_size", as_name)
    return split_join(cuts.withColumn("_key", F.struct("lang", part)), keyed, "_key", "_size", "phrase", n_cuts).drop("_key", "_size")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bucket: int = BUCKET, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 5 words.

    docs: text, lang; other columns are not used, whatever their names. Null text counts as empty, null lang as `und`. A
    language without candidates has no row; an empty table gives an empty table. Ties in score and a are told apart by
    the phrase's UTF-8 bytes, so ranks are the same in every run.

    A word that occurs less often than a candidate must is in none, so suffixes end before it. Equal suffixes of a part
    are counted before they move. Products are decimals of 38 digits.
    """
    phrases, totals = frequent_phrases(docs, least, bucket, most_words)
    candidates = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    joined = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = stored(cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")), "cuts")
    n_cuts = cuts.count()
    parts = _with_part(_with_part(cuts, phrases, "left", "l", n_cuts), phrases, "right", "r", n_cuts)
    by_language = stored(totals.join(cuts.groupBy("lang").agg(F.count("*").alias("_size")), "lang"), "language-sizes")
    floor = F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = split_join(parts, by_language, "lang", "_size", "phrase", n_cuts).withColumn("score", floor)
    lowest = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.filter("size > 2").withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    inner = inner.withColumn("len", F.explode(F.sequence(F.lit(2), F.least(F.col("size") - 1, F.col("size") - F.col("at") + 1))))
    held = inner.select("lang", joined(F.col("at"), F.col("len")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
