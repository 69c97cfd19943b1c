"""Phrase mining, exact dedup and the conversation trie against brute force, odd rows included."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewright.llm import copies, phrases, trie

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# phrases


def brute_phrases(rows, least, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= c[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]  # noqa: E741
    return sorted(out)


@pytest.fixture()
def spoken(spark, rng):
    words = ["the", "The", "of", "a", "é", "É", "日本", "x" * 300, "end.", "go,", "tab\tbed", "two  gaps", "l\nm", "?"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += ["a a a a a a a", "", None, " \t\n.,;:!?", "the of a " * 3000, "same words here"] * 3
    rows = [(k % 7 or None, t, [None, "en", "fr", "und"][k % 4], k, "p") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, size long, phrase string")


@pytest.mark.parametrize(("bucket", "most_words"), [(1 << 20, 1 << 18), (50, 1 << 18), (50, 4), (1 << 20, 0)])
def test_phrases(spoken, bucket, most_words):
    """With hot words, and with words that travel as text."""
    got = sorted(tuple(r) for r in phrases.collocations(spoken, least=4, top=60, bucket=bucket, most_words=most_words).collect())
    assert got == brute_phrases([(r.lang, r.text) for r in spoken.collect()], 4, 60)
    assert any("x" * 300 in r[2] for r in got) or most_words


def test_phrases_of_parts(monkeypatch, spoken):
    """A part ends between words that a suffix holds together."""
    monkeypatch.setattr(phrases, "CHUNK", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["a b c d e f g h i j k", "", "l m"])], names=["lang", "text"])
    starts = []
    for _, words, first, n in phrases._chunks([batch]):
        starts += [(words[k].as_py(), [w.as_py() for w in words[k : k + 5]][: 1 + int(np.argmax(np.append(first[k + 1 : k + 5], True)))]) for k in range(n)]
    assert [w for w, _ in starts] == [x.encode() for x in "abcdefghijklm"]
    assert dict(starts)[b"e"] == [b"e", b"f", b"g", b"h", b"i"] and dict(starts)[b"j"] == [b"j", b"k"] and dict(starts)[b"l"] == [b"l", b"m"]


def test_no_phrases(spoken):
    assert phrases.collocations(spoken.limit(0)).count() == 0
    assert phrases.collocations(spoken.filter("text is null")).count() == 0


def test_scores_past_64_bits(spark):
    rows = [("a b", 9 * 10**18 // 1000)]
    q = spark.createDataFrame(rows, "phrase string, a long").selectExpr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000) div (cast(a as decimal(19,0)) * cast(3 as decimal(19,0))) as s")
    assert q.first().s == 1000 * (9 * 10**15) // 3


# exact copies


def brute_copies(rows):
    by = collections.defaultdict(list)
    for doc_id, text in rows:
        by[(text or "").translate(_FOLD)].append(doc_id)
    out = []
    for text, ids in by.items():
        ids.sort(key=lambda x: (x is not None, x or 0))
        out += [(doc_id, ids[-1], len(ids), k == len(ids) - 1, sha(text)) for k, doc_id in enumerate(ids)]
    return collections.Counter(out)


@pytest.fixture()
def copied(spark, documents):
    extra = [(900, "Straße É", "a"), (901, "STRAße É", "b"), (902, "straße é", "c"), (903, "", "d"), (903, "", "e"), (None, "no id", "f"), (None, "NO ID", "g"), (904, "no id", "h"), (None, "alone", "i"), (905, "z" * 1_000_000, "j"), (906, "Z" * 1_000_000, "k"), (900, "Straße É", "a")]
    return documents.select("doc_id", "text", F.col("shard").alias("digest")).union(spark.createDataFrame(extra, "doc_id long, text string, digest string"))


def test_copies(copied):
    rows = [(r.doc_id, r.text) for r in copied.collect()]
    got = copies.exact_copies(copied).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute_copies(rows)
    assert copies.exact_copies(copied.limit(0)).count() == 0


def test_without_copies(copied):
    want = [(doc_id, h) for (doc_id, _, _, kept, h), n in brute_copies([(r.doc_id, r.text) for r in copied.collect()]).items() if kept for _ in range(n)]
    got = copies.without_copies(copied)
    assert got.columns == copied.columns
    assert collections.Counter((r.doc_id, sha((r.text or "").translate(_FOLD))) for r in got.collect()) == collections.Counter(want)


def test_repeat_filter(spark):
    """Every repeated digest is suspected, few others are; a filter that is too small suspects more and loses none."""
    digests = spark.range(20_000).select(F.unhex(F.sha2(F.when(F.col("id") < 300, F.col("id") % 100).otherwise(F.col("id")).cast("string").cast("binary"), 256)).alias("digest")).repartition(7)
    for segments, most in ((copies.segments_for(20_000), 500), (1, 20_000)):
        found, rest = copies.split_suspects(digests, copies.repeat_filter(digests, segments), segments)
        again = digests.groupBy("digest").count().filter("count > 1")
        assert found.join(again, "digest").count() == 300 and found.count() <= most and found.count() + rest.count() == 20_000


# the trie of conversations


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in by.items()}
    nodes, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = (collections.Counter() for _ in range(3))
    for node in nodes:
        children[node[:-1]] += len(node) > 0
    for node, members in nodes.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members) - 1) * len(node[-1][1]) if node else 0
    return collections.Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in nodes.items())


@pytest.mark.parametrize("held", [1 << 17, 3])
def test_trie(monkeypatch, spark, rng, held):
    monkeypatch.setattr(trie, "LOCAL", held)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 230), 9000, 9001, 9002]:  # family 200 has no first conversation
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None])) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"long {t}") for c in (300, 301, 302) for t in range(300)]
    rows += [(5, None, "system", "null first"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (None, 0, "user", "lost"), (207, 0, "u", "x" * 5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, key string")
    got = trie.prefix_trie(df).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_trie(rows)
    assert sum(r.depth == 0 for r in got) == 1 and all(r.parent_conv_id is None for r in got if r.depth == 0)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_end_lists_in_pieces(spark):
    """A sequence that very many conversations end with is hashed piece by piece."""
    df = spark.range(20_000).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    got = {r.depth: r for r in trie.prefix_trie(df).collect()}
    rebuilt = [c for c in range(20_000)]
    assert got[1].n_convs == 20_000 and got[1].ends_sha256 == sha(",".join(map(str, rebuilt))) and got[0].ends_sha256 == sha("")
