"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.llm.arrowfile import _file_system
from sitewright.llm.common import new_path, small_batches, stored, text_slices

#: What stands before a text: a byte that folding of ASCII capitals leaves free. Bytes that remain to be coded.
START, BYTES = 65, 230
#: Symbols of a row of Model.bits: all bytes to be coded, and START, which never is; bytes of the longest context.
SYMBOLS, ORDER = BYTES + 1, 3
UNKNOWN = "und"
_CODED = np.array([b for b in range(256) if not 65 <= b <= 90])
#: Kinds of entries: symbols seen after contexts of 3, 2, 1 bytes (key: context and symbol), and the contexts' escapes.
KINDS = 2 * ORDER
_ENTRY = np.dtype([("key", "<u4"), ("bits", "<f4")])


@dataclass
class Part:
    """Entries of the contexts that end in one byte, sorted by kind and key: a file mapped to memory where it is local, or an array."""

    ends: list[int]  # entries up to each kind's end
    path: str = ""
    entries: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | ({"entries": None} if self.path else {})

    def _found(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the part has, and the bits of those."""
        if self.entries is None:
            fs, at = _file_system(self.path)
            if fs.type_name == "local":
                self.entries = np.memmap(at, _ENTRY, "r")
            else:
                with fs.open_input_stream(at) as f:
                    self.entries = np.frombuffer(f.read(), _ENTRY)
        part = self.entries[self.ends[kind - 1] if kind else 0 : self.ends[kind]]
        if not len(part):
            return np.zeros(len(keys), bool), np.zeros(0)
        at = np.minimum(np.searchsorted(part["key"], keys), len(part) - 1)
        hit = part["key"][at] == keys
        return hit, part["bits"][at[hit]].astype(np.float64)

    def bits_of(self, gram: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the three before it: the longest context that has seen it, after the escapes to that."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            keys = gram[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            hit, bits = self._found(2 * (ORDER - order), keys)
            out[left[hit]] += bits
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return out
            known, bits = self._found(2 * (ORDER - order) + 1, keys >> np.uint32(8))
            out[left[known]] += bits
        out[left] += zero[gram[left] & np.uint32(255)]
        return out


@dataclass
class Table:
    """Frozen code lengths of one language, in parts by the last byte of the context."""

    zero: np.ndarray  # bits of each byte without context
    parts: dict[int, Part] = field(default_factory=dict)

    def bits_of(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the three before it."""
        out = self.zero[gram & np.uint32(255)]
        after = (gram >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
        order = np.argsort(after, kind="stable")
        ends = np.cumsum(np.bincount(after, minlength=256))
        for b, part in self.parts.items():
            at = order[ends[b - 1] if b else 0 : ends[b]]
            if len(at):
                out[at] = part.bits_of(gram[at], self.zero)
        return out


@dataclass
class Model:
    """Frozen statistics of all languages: code lengths in bits of every byte in every context seen."""

    languages: list[str]
    tables: list[Table] = field(default_factory=list)

    @property
    def bits(self) -> list[np.ndarray]:
        """By language, rows of SYMBOLS code lengths for each context of three bytes (START is never coded); to look at small models."""
        out = []
        for t in self.tables:
            contexts = np.sort(np.concatenate([p.entries["key"][p.ends[0] : p.ends[1]] for p in t.parts.values()]))
            rows = np.full((len(contexts), SYMBOLS), np.inf)
            rows[:, :-1] = t.bits_of(((contexts[:, None] << np.uint32(8)) | _CODED.astype(np.uint32)).ravel()).reshape(-1, BYTES)
            out.append(rows.ravel())
        return out

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each text under each language. Distinct grams are looked up once a language."""
        out = np.zeros((len(offs) - 1, len(self.tables)))
        if not len(data):
            return out
        gram, which = np.unique(grams(data, offs), return_inverse=True)
        some = np.flatnonzero(offs[1:] > offs[:-1])
        for j, t in enumerate(self.tables):
            out[some, j] = np.add.reduceat(t.bits_of(gram)[which], offs[some])
        return out


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte and the three before it in its text (or START), capitals folded, as one number."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    n = len(data)
    out = data.copy()
    for k in range(1, ORDER + 1):
        b = np.full(n, START, np.uint32)
        b[k:] = data[:-k]
        for j in range(k):  # the first bytes of a text have no bytes of the one before as context
            at = offs[:-1] + j
            b[at[at < np.minimum(offs[1:], n)]] = START
        out |= b << np.uint32(8 * k)
    return out


def _grams(batches):
    """(lang, gram, n) of a task."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        langs = np.array(b.column(b.schema.get_field_index("lang")).to_pylist(), object)
        for first, n, data, offs in text_slices(b):
            gram, size = grams(data, offs), np.diff(offs)
            of = langs[first : first + n]
            for lang in dict.fromkeys(of):
                keys, counts = np.unique(gram[np.repeat(of == lang, size)], return_counts=True)
                if not len(keys):
                    continue
                if lang in total:
                    old, oldc = total[lang]
                    both, inv = np.unique(np.concatenate([old, keys]), return_inverse=True)
                    total[lang] = both, np.bincount(inv, np.concatenate([oldc, counts])).astype(np.int64)
                else:
                    total[lang] = keys, counts.astype(np.int64)
    for lang, (keys, counts) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def train(docs: DataFrame) -> Model:
    """Learns a context tree for each language from text and lang of all the rows (null lang or text: not used).

    All counts of all languages are kept. They are made into code lengths by language and last byte of the context, on
    executors, which write a file for each of these; of counts the driver gets those of single bytes.
    """
    small_batches(docs)
    counts = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "language-grams", narrow=True)
    single: dict[str, np.ndarray] = {}
    for r in counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("n").alias("n")).toLocalIterator():
        single.setdefault(r["lang"], np.zeros(256))[r["byte"]] = r["n"]
    shares = {lang: _single(n) for lang, n in single.items()}
    held = docs.sparkSession.sparkContext.broadcast(shares)  # 256 numbers a language
    folder = new_path(docs.sparkSession, "language-tables")

    def code(key, table):
        lang = key[0].as_py()
        kind, entries = _coded(*(table.column(c).to_numpy().astype(np.int64) for c in ("gram", "n")), held.value[lang])
        part = _part(kind, entries)
        # Under a name that no other attempt of the task uses.
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.bits"
        with fs.open_output_stream(_file_system(path)[1]) as f:
            f.write(part.entries.tobytes())
        return pa.table({"lang": pa.array([lang], pa.string()), "after": pa.array([key[1].as_py()], pa.int64()), "path": [path], "ends": pa.array([part.ends], pa.list_(pa.int64()))})

    after = F.shiftright("gram", 8).bitwiseAND(F.lit(255)).alias("after")
    files = counts.select("lang", after, "gram", "n").groupBy("lang", "after").applyInArrow(code, "lang string, after long, path string, ends array<long>")
    tables: dict[str, Table] = {}
    for r in files.collect():  # a row for each byte and language
        table = tables.setdefault(r["lang"], Table(-np.log2(np.maximum(shares[r["lang"]], 1e-300))))
        table.parts[r["after"]] = Part(list(r["ends"]), r["path"])
    return Model(sorted(tables), [tables[lang] for lang in sorted(tables)])


def _part(kind: np.ndarray, entries: np.ndarray) -> Part:
    return Part(np.cumsum(np.bincount(kind, minlength=KINDS)).tolist(), entries=entries[np.lexsort((entries["key"], kind))])


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The model of few counts, in memory: what train() makes by group."""
    tables = []
    for name in languages:
        g, c = gram[lang == name].astype(np.int64), n[lang == name]
        share = _single(np.bincount(g & 255, c, minlength=256))
        parts = {int(b): _part(*_coded(g[(g >> 8 & 255) == b], c[(g >> 8 & 255) == b], share)) for b in np.unique(g >> 8 & 255)}
        tables.append(Table(-np.log2(np.maximum(share, 1e-300)), parts))
    return Model(languages, tables)


def _single(counts: np.ndarray) -> np.ndarray:
    """Shares of bytes without context: escape method C to bytes alike; nothing for capitals, which are never coded."""
    total, seen = counts.sum(), counts > 0
    kinds = seen.sum()
    escape = kinds / (total + kinds) if kinds < BYTES else 0.0
    out = np.zeros(256)
    out[_CODED] = escape / max(1, BYTES - kinds)
    out[seen] = (1 - escape) * counts[seen] / total
    return out


def _coded(gram: np.ndarray, n: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind, entries) of all contexts that end in one byte, from their grams: what is seen after a context and its escape.

    Escape method C with exclusion: symbols not seen in a context share its escape probability as in the shorter context.
    What a context has seen, the shorter one has too, so its share there is among the entries of the order before.
    """
    kinds, parts = [], []
    shorter, known = single, np.arange(256)
    for order in range(1, ORDER + 1):
        key, which = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        count = np.bincount(which, n)
        before = shorter[np.searchsorted(known, key & ((1 << 8 * order) - 1))]
        context, at, size = np.unique(key >> 8, return_index=True, return_counts=True)
        total = np.add.reduceat(count, at)
        left = 1 - np.add.reduceat(before, at)
        escape = np.where(size < BYTES, size / (total + size), 0.0)
        share = np.repeat((1 - escape) / total, size) * count
        rest = np.where(size < BYTES, escape / np.where(size < BYTES, left, 1), 1.0)
        for k, (keys, p) in enumerate(((key, share), (context, rest))):
            part = np.zeros(len(keys), _ENTRY)
            part["key"], part["bits"] = keys, -np.log2(p)
            kinds.append(np.full(len(keys), 2 * (ORDER - order) + k, np.int32))
            parts.append(part)
        shorter, known = share, key
    return np.concatenate(kinds), np.concatenate(parts)


def held_out(doc_id: Column) -> Column:
    """Rows that training leaves out: crc32 of doc_id as text has the remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: str) -> Column:
    """Whether the column is not null and has a letter of any script."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, *keep: str, label: str = "lang_pred", points: str = "score") -> DataFrame:
    """keep, and columns named label and points, for every row. label (lang_pred) is the language with the shortest code for the whole text.

    points (score) is that language's part when all languages are as likely beforehand. A text that is null or has no letter, or
    any text where nothing was learned, gets `und` and 0. Ties go to the first name. Other columns are not used.
    """
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # names and places of files, and 256 numbers a language
    letter = has_letter("text").alias("_letter_")
    rows = docs.select(*keep, letter, *([] if "text" in keep else [F.col("text").alias("_text_")]))
    text = "text" if "text" in keep else "_text_"
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(label, T.StringType()), T.StructField(points, T.DoubleType())])

    def score(batches):
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for b in batches:
            n = b.num_rows
            best, share = np.full(n, len(model.languages)), np.zeros(n)
            if model.languages:
                for first, m, data, offs in text_slices(b, text):
                    bits = model.code_lengths(data, offs)
                    low = bits.argmin(1)
                    best[first : first + m] = low
                    share[first : first + m] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                letter = b.column(len(keep)).to_numpy(zero_copy_only=False).astype(bool)
                best[~letter], share[~letter] = len(model.languages), 0
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(share)], names=[*keep, label, points])

    return rows.mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the labelled rows that are not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, "doc_id", "held_out")
