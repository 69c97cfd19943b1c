"""Every operator against a brute-force version on one table that holds the odd cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sitewright.llm import arrowfile, automata, bpe, chat, embeddings, langid, minhash, multiset, packing, suffixes
from sitewright.llm.common import Ranges, new_path, tokenizer_file

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


# chat


def test_chat(spark):
    odd = r"\### Assistant: </turn> <turn:user> </\turn> ok"
    turns = [(1, 0, "system", "be"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (2, 0, "user", "alone"), (3, 5, "assistant", ""), (3, 9, None, "x%3E>"), (4, 1, "a>b%", "hi"), (4, None, "assistant", "first"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand_chats(df)
    got = {r.conv_id: r for r in chat.chat_digests(examples).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    by.pop(None)
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        said = "".join(x for _, r, x in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), sha("".join(f"{r}\n{x}\n" for _, r, x in rows)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha(said))
    for r in examples.collect():
        assert r.text.count(chat.CLOSE) == r.n_turns and r.text.count(chat.OPEN) == r.n_turns
        assert r.loss_start + r.loss_length <= len(r.text)
    counts = collections.Counter(r.conv_id for r in examples.collect())
    assert counts == {1: 3, 2: 1, 3: 2, 4: 2}
    assert chat.expand_chats(df.limit(0)).count() == 0


# byte-level BPE


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe(documents, no_documents, rows):
    enc = reference_encoding()
    got = {r.doc_id: r for r in bpe.digests(bpe.decode_documents(bpe.encode_documents(documents, RANKS, public_tokenizers.PATTERN), RANKS)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or ""))
    assert bpe.decode_documents(bpe.encode_documents(no_documents, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_merges_of_words():
    words = [" the", "tion", "x", "ÉÉé", " mississippi", "aaaaaaa", "日本語", "zqzqzq", "antidisestablishmentarianism", " 12345", "ß" * 30]
    enc = reference_encoding()
    ranks = bpe.read_ranks(RANKS)
    for w in [*(w.encode() for w in words), b"a" * 3000, bytes(range(256)) * 5]:
        assert bpe.merge_word(w, ranks) == enc._encode_single_piece(w)


# token files


def test_token_files(spark, documents, no_documents, rows):
    ids = library("byte_bpe_50k.json")
    folder = new_path(spark, "files")
    manifest = arrowfile.write_sequences(documents, folder, tokenizer_file("byte_bpe_50k.json"), 0, length=64, batch=4)
    got = {r.doc_id: r for r in arrowfile.read_documents(manifest).collect()}
    start = 0
    for k, t in rows:
        want = np.array([*ids(t), 0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    total = 0
    for m in manifest.collect():
        shard = arrowfile.Shard(m.path, m.index_path)
        n = sum(shard.batch(k).num_rows for k in range(shard.n_batches))
        for x in shard.sequence(n - 1):
            assert not x.flags.owndata and not x.flags.writeable  # the file's own bytes
        stream = np.concatenate([x[keep] for x, keep in (shard.sequence(k) for k in range(n))])
        assert len(stream) == m.n_tokens and all(len(shard.sequence(k)[0]) == 64 for k in range(n))
        total += len(stream)
    assert total == start
    assert arrowfile.read_documents(arrowfile.write_sequences(no_documents, new_path(spark, "none"), tokenizer_file("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, rng):
    from sitewright.llm.tokens import Encoder

    code, ids = Encoder(tokenizer_file(name)), library(name)
    alphabet = [*"abcXYZéÉßİıǰ0129,.;:'’\"-_*#$%&@!?()[]{}|~`^\\/<>+= \n\t\r\x0b\x1c\x85\xa0　́̇中日😀ﬁΣς²½", *" " * 12, "'s", "'ll", " the", "\n\n"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert np.frombuffer(code.encode(text), code.kind).tolist() == ids(text), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_texts_are_those_of_the_library(name, rng):
    from tokenizers import Tokenizer

    from sitewright.llm.tokens import Encoder

    code, whole = Encoder(tokenizer_file(name)), Tokenizer.from_file(tokenizer_file(name))
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "<|EndOfText|>", " ", "\n", "One two", "e\u0301", "\u0301", "Σ", "x'", "s", "12"]
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|startoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000))]
    for text in texts:
        assert np.frombuffer(code.encode(text), code.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


# packing


def test_packing(documents, no_documents, rows):
    ids = library("word_bpe_49k.json")
    cap = 128
    packed = packing.pack_documents(documents, tokenizer_file("word_bpe_49k.json"), 1, cap).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for k, t in rows:
        want = np.array([*ids(t), 1], "<u4")
        total += len(want)
        pieces = [(n, s, want[s : s + cap].tobytes()) for n, s in enumerate(range(0, len(want), cap))]
        assert sorted((r.piece, r.start, bytes(r.ids)) for r in by[k]) == pieces
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert rs[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(rs, rs[1:])) and rs[-1].offset + rs[-1].length <= cap
    assert len(sequences) <= -(-total // cap) * 1.1 + 1
    assert packing.pack_documents(no_documents, tokenizer_file("word_bpe_49k.json"), 1).count() == 0


def optimum(items, cap):
    """Fewest bins, by trying all."""
    best = len(items)
    items = sorted(items, reverse=True)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        tried = set()
        for b in range(len(bins)):
            if bins[b] >= items[k] and bins[b] not in tried:
                tried.add(bins[b])
                bins[b] -= items[k]
                place(k + 1, bins)
                bins[b] += items[k]
        bins.append(cap - items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best


def test_reduction_keeps_the_optimum(rng):
    for _ in range(150):
        cap = rng.choice([10, 15, 20])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 9))]
        counts = np.bincount(items, minlength=cap + 1) if items else np.zeros(cap + 1, int)
        fixed, left = packing.reduce_dominated(counts, cap)
        rest = [s for s in range(cap + 1) for _ in range(left[s])]
        assert all(sum(s) <= cap for s, _ in fixed)
        assert sorted([s for items_, n in fixed for s in items_ * n] + rest) == sorted(items)
        assert sum(n for _, n in fixed) + optimum(rest, cap) == optimum(items, cap)
        plan = packing.plan_packing(counts, cap)
        assert optimum(items, cap) <= plan.n_bins <= optimum(items, cap) + 1
        assert {s: sum(x[1] for x in v) for s, v in plan.places.items()} == dict(collections.Counter(items))


# language


def test_language(spark, documents, no_documents):
    parts = {"aa": "ba na ko li mu", "bb": "schrei tzen gluck wert", "cc": "ción llo ñez que"}
    import random

    r = random.Random(1)
    rows = [(k, " ".join(r.choice(parts[c].split()) + r.choice(parts[c].split()) for _ in range(30)), c) for k, c in enumerate([*"abc"] * 60) for c in [c * 2]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (1003, "ba", None), (None, "gluck wert", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    told = {x.doc_id: x for x in got}
    for k, text, lang in rows[:180]:
        assert told[k].lang_pred == lang and 0 <= told[k].score <= 1
        assert told[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
    assert all(told[k].lang_pred == "und" and told[k].score == 0 for k in (1000, 1001, 1002))
    assert told[1003].lang_pred == "aa" and told[None].lang_pred == "bb"
    assert langid.identify(no_documents).count() == 0
    assert {r.lang_pred for r in langid.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_are_those_of_a_distribution():
    gram = np.array([0x61626364, 0x61626365, 0x62636461, 0x00006162], np.int64)
    model = langid.build(["x"], np.array(["x"] * 4, object), gram, np.array([5, 3, 2, 1]))
    share = np.exp2(-model.bits[0].reshape(-1, langid.SYMBOLS).astype(float))
    others = 256 - (langid.SYMBOLS - 1) - 26
    total = share[:, :-1].sum(1) + share[:, -1] * others
    assert np.allclose(total, 1, atol=1e-4)


def ppm_bits(texts, text):
    """Bits of text by counts in dicts: contexts of three bytes and fewer, escape method C with exclusion."""
    fold = lambda x: [None] * 3 + list(x.lower())
    seen = collections.defaultdict(collections.Counter)
    for t in map(fold, texts):
        for i in range(3, len(t)):
            for k in range(4):
                seen[tuple(t[i - k : i])][t[i]] += 1
    coded = [b for b in range(256) if not 65 <= b <= 90]
    p = {}

    def share(context):
        if context not in p:
            shorter = share(context[1:]) if context else dict.fromkeys(coded, 1 / len(coded))
            c = seen.get(context, {})
            total, left = sum(c.values()), sum(x for b, x in shorter.items() if b not in c)
            e = len(c) / (total + len(c)) if c else 1
            p[context] = {b: (1 - e) * c[b] / total if b in c else e * shorter[b] / left for b in coded}
        return p[context]

    t = fold(text)
    return -sum(np.log2(share(tuple(t[i - 3 : i]))[t[i]]) for i in range(3, len(t)))


def test_code_lengths_equal_brute_force_beyond_old_bounds(rng):
    texts = [bytes(rng.choice(range(40, 240)) if rng.random() < 0.5 else rng.choice(b"aBc ") for _ in range(9000)) for _ in range(5)]
    of = {"x": texts[:3], "y": texts[3:]}
    lang, gram = [], []
    for k, ts in of.items():
        for t in ts:
            gram.append(langid.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)])))
            lang += [k] * len(t)
    model = langid.build(["x", "y"], np.array(lang, object), np.concatenate(gram).astype(np.int64), np.ones(len(lang), np.int64))
    assert len(np.unique(np.concatenate(gram) >> 8)) > 16384
    some = [texts[0][100:180], b"", bytes(range(1, 64)), texts[4][:90]]
    got = model.code_lengths(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
    assert np.allclose(got, [[ppm_bits(of[k], x) for k in "xy"] for x in some], rtol=1e-5)


def test_any_number_of_languages_is_learned(spark, rng):
    words = {f"l{k:02}": [chr(0x4E00 + 40 * k + j) * 2 for j in range(12)] for k in range(40)}
    rows = [(100 * k + j, " ".join(rng.choice(w) for _ in range(5 + k % 9)), name) for k, (name, w) in enumerate(words.items()) for j in range(12)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {k: name for k, _, name in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got) and any(r.held_out for r in got)


def test_rare_bytes_tell_languages_apart(spark, rng):
    hot = "".join(chr(b) for b in range(33, 127))
    rows = [(k, hot * 20, "xx") for k in range(20)]
    rows += [(100 + k, " ".join(rng.choice("αβγ") for _ in range(30)), "aa") for k in range(20)] + [(200 + k, " ".join(rng.choice("δεζ") for _ in range(30)), "bb") for k in range(20)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {k: name for k, _, name in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got)


# repeats


def test_suffix_array(documents, no_documents, rows):
    n = 200
    texts = {k: (t or "").encode() for k, t in rows}
    seen = collections.Counter(b[i : i + n] for b in texts.values() for i in range(len(b) - n + 1))
    got = {r.doc_id: r for r in suffixes.digests(suffixes.remove_repeats(documents)).collect()}
    assert len(got) == len(rows)
    for k, b in texts.items():
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                cover[i : i + n] = b"\1" * n
        kept = bytes(x for x, c in zip(b, cover) if not c)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), sha(kept))
    assert any(r.n_removed for r in got.values())
    assert suffixes.remove_repeats(no_documents).count() == 0


def test_long_texts_are_taken_in_chunks(rng):
    from sitewright.llm.repeats import Units, segments

    lengths = [5, 0, 700, 30, 41, 300]
    data = np.array([rng.randrange(97, 100) for _ in range(sum(lengths))], np.uint8)
    offs = np.concatenate([[0], np.cumsum(lengths)])
    want = {(k, i) for k, n in enumerate(lengths) for i in range(n - 30 + 1)}
    marks = {}
    for chunk in (1 << 20, 50, 64):
        text, begin, n, shard = segments(Units(data, offs), 30, 7, chunk)
        got = {(int(t), int(b) + i): int(h) for t, b, c, h in zip(text, begin, n, shard) for i in range(c)}
        assert set(got) == want and n.sum() == len(want)
        assert marks.setdefault("marks", got) == got


def test_span_hashes_are_polynomials_modulo_the_prime(monkeypatch):
    from sitewright.llm import common

    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start = np.sort(rng.integers(0, 2900, 200))
    end = np.maximum.accumulate(start + rng.integers(1, 100, 200))
    value = lambda a, b: sum((int(x) + 1) * pow(common.BASE, k, common.PRIME) for k, x in enumerate(data[a:b])) % common.PRIME
    want = common.mixed(np.array([value(a, b) for a, b in zip(start.tolist(), end.tolist())], np.uint64))
    assert (common.span_hashes(data, start, end) == want).all()
    monkeypatch.setattr(common, "HASH_BYTES", 64)
    assert (common.span_hashes(data, start, end) == want).all()


def test_words_are_joined_by_one_space(rng):
    from sitewright.llm.common import words_of

    texts = ["", " a  b\tc\n", "d", "E f", "\r\x0b", "g"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    joined, start, end, at = words_of(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), fold=True)
    words = [bytes(joined[a:b]) for a, b in zip(start, end)]
    assert [words[a:b] for a, b in zip(at, at[1:])] == [[w.lower().encode() for w in t.split()] for t in texts]
    assert bytes(joined[start[0] : end[2]]) == b"a b c"


def thue_morse(n):
    """A word of 2**n letters, and its complement: polynomials modulo a power of two do not tell them apart."""
    w = "a"
    for _ in range(n):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_simple_hashes_take_for_equal_are_told_apart(spark, prose):
    one, other = thue_morse(10)
    text = prose(19)
    df = spark.createDataFrame([(1, f"{text} {one}"), (2, f"{text} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in automata.remove_seen(df).collect()] == [0, 0]
    few = spark.createDataFrame([(1, one), (2, other), (3, f"a b c d {one}"), (4, f"a b c d {other}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_groups(few, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    cuts = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(few, 1024, 48).collect()}
    assert cuts == {1: (1024, 1024), 2: (1024, 1024), 3: (1032, 1024), 4: (1032, 1024)}
    alone = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert [r.n_removed for r in suffixes.remove_repeats(alone, 1024, 48).collect()] == [0, 0]


def test_hot_keys_are_dealt_and_lose_no_row(spark):
    from sitewright.llm.common import split_join

    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = split_join(rows, sizes, "k", "n", "v", 4000)
    assert joined.agg(F.count("*"), F.countDistinct("v"), F.max("n")).first() == (4000, 4000, 3000)


def test_sets_of_shingles_are_exact(rng):
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    sets = minhash.shingle_sets([t.encode() for t in texts])
    exact = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    for a in range(0, 200, 7):
        for b in range(200):
            assert len(np.intersect1d(sets[a], sets[b])) == len(exact[a] & exact[b])


def test_suffix_ranks(rng):
    for _ in range(400):
        n, a = rng.randint(0, 60), rng.choice([2, 3, 5])
        t = [rng.randint(1, a) for _ in range(n)]
        if n > 10 and rng.random() < 0.4:
            t = (t[: rng.randint(1, 9)] * 80)[:n]
        d = rng.choice([1, 2, 3, 4, 9, 10, 30, 200])
        ranks = suffixes.suffix_ranks(np.array(t, np.int64), d)
        order = sorted(range(n), key=lambda i: ranks[i])
        keys = [tuple(t[i : i + d]) for i in order]
        assert keys == sorted(keys)


def test_repeated_rows_are_documents_of_their_own(spark, prose):
    long = prose(80)
    df = spark.createDataFrame([(1, long), (1, long), (2, "short"), (2, "other"), (None, prose(50)), (None, "x")], "doc_id long, text string")
    got = suffixes.remove_repeats(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes - r.n_removed) for r in got if r.doc_id) == [(1, 0), (1, 0), (2, 5), (2, 5)] and len(got) == 6
    words = automata.remove_seen(df).collect()
    assert sorted(r.n_removed for r in words if r.doc_id == 1) == [0, 80] and len(words) == 6
    left = suffixes.without_repeats(df.withColumn("n_chars", F.lit(0).cast("long")).withColumn("kept", F.lit("mine"))).collect()
    assert len(left) == 6 and {r.kept for r in left} == {"mine"} and sorted(r.n_chars for r in left if r.doc_id) == [0, 0, 5, 5]


def brute_windows(texts, n):
    seen, out = set(), {}
    for k in sorted(texts):
        w = texts[k].encode().split()
        cover = bytearray(len(w))
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                cover[i : i + n] = b"\1" * n
            seen.add(key)
        out[k] = (len(w), sum(cover), sha(b" ".join(x for x, c in zip(w, cover) if not c)))
    return out


def test_suffix_automata(documents, no_documents, rows):
    want = brute_windows({k: t or "" for k, t in rows}, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automata.digests(automata.remove_seen(documents)).collect()}
    assert got == want and any(x[1] for x in want.values())
    assert automata.remove_seen(no_documents).count() == 0


def test_hot_shards_are_split(spark, prose):
    passage = prose(30)
    df = spark.createDataFrame([(k, f"{prose(25)} {passage} {prose(25)}") for k in range(60)], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in df.collect()}
    spans = automata.repeated_spans(df, automata._words, automata._match(20), 20, 5, earlier=True, block=8)
    whole = automata.repeated_spans(df, automata._words, automata._match(20), 20, 5, earlier=True, block=4096)
    cover = lambda s: {(r.doc_id, i) for r in s.collect() for i in range(r.begin, r.stop)}
    assert cover(spans) == cover(whole) and sum(x[1] for x in brute_windows(rows, 20).values()) == len(cover(spans))


def test_automaton(rng):
    for _ in range(300):
        automaton, held = automata.SuffixAutomaton(), []
        for _ in range(3):
            s = [rng.randrange(3) for _ in range(rng.randrange(12))]
            if held:
                want = [max((n for n in range(i + 2) if n <= i + 1 and any(s[i + 1 - n : i + 1] == h[j : j + n] for h in held for j in range(len(h) - n + 1))), default=0) for i in range(len(s))]
                assert automaton.matching_statistics(s) == want
            automaton.add(s)
            held.append(s)


# near duplicates


def brute_groups(texts, percent=85):
    sets = {}
    for k, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in texts}


def test_minhash(documents, no_documents, rows):
    for percent, block in ((85, 1024), (80, 3)):
        want = brute_groups({k: t or "" for k, t in rows}, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(documents, percent, block).collect()}
        assert got == want
    assert len({x[1] for x in want.values()}) < len(want)
    assert minhash.near_groups(no_documents).count() == 0


def test_minhash_null_ids_do_not_stand_for_a_set(spark, prose):
    words = prose(80).split()
    near = " ".join([*words[:-1], "changed"])
    rows = [(5, " ".join(words)), (3, " ".join(words)), (None, " ".join(words)), (9, near), (None, "all alone"), (7, "other words")]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 3, False), (3, 3, True), (5, 3, False), (7, 7, True), (9, 3, False)]


def test_minhash_estimate():
    rng = np.random.default_rng(0)
    both, one, other = (rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64) for n in (850, 75, 75))
    sh = np.concatenate([both, one, both, other])
    _, sig = minhash.signatures(sh, np.array([0, 925, 1850]))
    assert abs(minhash.estimate(sig[0], sig[1]) - 0.85) < minhash.margin(0.85) < 0.2


def test_set_sizes_do_not_rest_on_hashes(rng):
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) for _ in range(50)] + ["", "x y", "é " * 30]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    _, spans, at, words = minhash.shingles(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    for k, t in enumerate(texts):
        w = t.split()
        want = len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0
        own = spans[:, at[k] : at[k + 1]]
        exact = [hash(words[k][a:b]) for a, b in own.T.tolist()]
        for most in (1, 3, 1 << 62):  # different shingles of one hash, in the first two
            assert not w or minhash.set_size(np.array([h % most for h in exact], np.int64), own, words[k]) == want


def test_copies_beside_null_ids_keep_their_group(spark, prose):
    text = prose(30)
    rows = [(k, text) for k in range(400)] + [(None, text), (None, "one two"), (None, None), (500, "")]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.component_id, r.kept) for r in got if r.doc_id is not None and r.doc_id < 400} == {(0, True), (0, False)}
    assert sorted((r.component_id is None, r.n_shingles, r.kept) for r in got if r.doc_id is None) == [(False, 26, False), (True, 0, True), (True, 1, True)]


def test_components(spark):
    from sitewright.llm.blocks import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (50, 100), (7, 7), (200, 201), (201, 200)] + [(300, 301 + k) for k in range(30)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == got[102] == got[100] == 50 and got[201] == 200 and {got[300 + k] for k in range(31)} == {300}


# vectors


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    near = [base[k % 4] + 0.05 * rng.standard_normal(32) for k in range(40)]
    vectors = [*base, *near, base[0], base[0], 3 * base[1]]
    rows = [(k, [float(x) for x in v], "l") for k, v in enumerate(vectors)]
    odd = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, [1.0, 2.0], [2.0, 4.0], []]
    rows += [(1000 + k, v, "l") for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    for block in (1024, 4):
        got = {r.vec_id: r for r in embeddings.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        want = links.sum(1) - 1
        have = np.array([got[k].n_links for k in range(len(vectors))])
        assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
        for k in range(len(vectors)):
            assert got[k].component_id <= k and got[k].kept == (got[k].component_id == k)
        assert got[100].component_id == 0 and got[102].component_id == 1
        assert all((got[1000 + k].n_links, got[1000 + k].component_id, got[1000 + k].kept) == (0, 1000 + k, True) for k in (0, 1, 2, 3, 4, 7))
        assert got[1006].component_id == 1005 and got[1005].n_links == 1
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_null_and_repeated_vector_ids(spark):
    a, b, far = [1.0, 0.0, 0.0], [0.995, 0.0999, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (None, b), (7, far), (7, a), (8, far), (None, far), (None, None), (9, None)]
    df = spark.createDataFrame([(*r, k, True, "x") for k, r in enumerate(rows)], "vec_id long, embedding array<double>, digest long, kept boolean, vec string")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_vectors(df).collect())
    assert got == sorted([(1, 2, 1, True), (0, 2, 1, False), (7, 2, 7, True), (7, 2, 1, False), (8, 2, 7, False), (0, 2, 7, False), (0, 0, 0, True), (9, 0, 9, True)])


def test_codes_within_fewer_bits_than_tables_share_a_key():
    rng = np.random.default_rng(2)
    index = embeddings.learn(embeddings.unit_vectors(rng.standard_normal((2000, 64))), 50_000, 0.9)
    codes = rng.random((300, index.width * index.tables)) < 0.5
    for code in codes:
        other = code.copy()
        other[rng.permutation(len(code))[: index.tables - 1]] ^= True
        assert (index.keys_of(code[None]) == index.keys_of(other[None])).any()
    assert (index.unpacked(np.packbits(codes, axis=1)) == codes).all() and index.radius > index.tables


def test_index_recall():
    rng = np.random.default_rng(9)
    a = embeddings.unit_vectors(rng.standard_normal((4000, 64)))
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * embeddings.unit_vectors(side)
    index = embeddings.learn(a, len(a), 0.9)
    assert (index.keys(a) == index.keys(b)).any(1).mean() >= 0.9


# fingerprints


def test_ranges_hold_bounded_parts(spark):
    """Ids of three scales, one heavy id, the ends of a long, and nulls: order is kept and no range of several ids is large."""
    ids = [*range(3000), *range(10**9, 10**9 + 10**6, 1000), -(2**63), 2**63 - 1, 10**15, None, None]
    rows = spark.createDataFrame([(i, 50_000 if i == 77 else 10) for i in ids], "doc_id long, size long")
    ranges = Ranges(rows, 1000)
    assert ranges.again
    placed = ranges.place(rows, "doc_id", "low").collect()
    held = collections.defaultdict(list)
    for r in placed:
        assert (r.low is None) == (r.doc_id is None)
        if r.doc_id is not None:
            assert r.low <= r.doc_id
            held[r.low].append(r)
    part = sum(r["size"] for r in placed if r.doc_id is not None) // ranges.number
    in_order = sorted(held)
    for a, b in zip(in_order, in_order[1:]):
        assert max(r.doc_id for r in held[a]) < b
    assert all(sum(r["size"] for r in g) <= 2 * part or len(g) == 1 for g in held.values())
    assert Ranges(rows.limit(0), 1000).place(rows.limit(0), "doc_id", "low").count() == 0


def test_fingerprints(spark, documents, no_documents, rows):
    for buckets in (1, 7):
        got = {r.doc_id: r for r in multiset.edited_fingerprints(documents, buckets).collect()}
        assert len(got) == len(rows)
        by_text = collections.defaultdict(set)
        for k, (doc, text) in enumerate(rows):
            t, nxt = text or "", rows[k - 1][1] or ""
            edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            assert (got[doc].n_chars, got[doc].edited_sha256) == (len(t), sha(edited))
            by_text[t].add(got[doc].fingerprint)
            if edited == t:
                assert got[doc].near_edited == 1 and got[doc].edited_fingerprint == got[doc].fingerprint
            assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
        assert all(len(v) == 1 for v in by_text.values())
        assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert multiset.edited_fingerprints(no_documents).count() == 0


def brute_mark(text):
    """(n_runs, counters, lanes) of a text, by the definition."""
    import struct

    import xxhash

    seeded = lambda p, k: xxhash.xxh64(struct.pack("<i", k), seed=xxhash.xxh64(p.encode(), seed=42).intdigest()).intdigest()
    runs = re.findall(multiset.RUN.replace(r"\z", r"\Z"), text, re.ASCII)
    counters = [0] * 256
    for r in runs:
        for j in range(4):
            h = seeded(r, j)
            for k in range(32):
                counters[64 * j + 2 * k] += h >> k & 1
                counters[64 * j + 2 * k + 1] += h >> (k + 32) & 1
    lanes = [0] * 8
    for line in text.split("\n"):
        for j in range(4):
            h = seeded(line, 4 + j)
            lanes[2 * j] += h & 0xFFFFFFFF
            lanes[2 * j + 1] += h >> 32
    return len(runs), counters, [x % 2**32 for x in lanes]


def brute_text(mark):
    import struct

    import xxhash

    h = 42
    for c in mark[1]:
        h = xxhash.xxh64(struct.pack("<q", c), seed=h).intdigest()
    return "".join(f"{x:08x}" for x in mark[2]) + "".join(f"{xxhash.xxh64(struct.pack('<i', k), seed=h).intdigest():016x}" for k in range(2))


def brute_likeness(a, b):
    if a[1:] == b[1:]:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    x, y = ([2 * c - m[0] for c in m[1]] for m in (a, b))
    dot = lambda p, q: sum(i * j for i, j in zip(p, q))
    return max(0.0, min(1.0, dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5)) if dot(x, x) * dot(y, y) else 0.0


def test_fingerprints_equal_brute_force(spark, documents, rows):
    odd = spark.createDataFrame([(3, "again " * 30), (3, "again " * 30), (3, "other"), (None, "none one\nline"), (None, ""), (None, None)], "doc_id long, text string")
    both = documents.select("doc_id", "text").union(odd)
    ordered = sorted(((k, t or "") for k, t in both.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for n, (doc, t) in enumerate(ordered):
        nxt = ordered[(n + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        m, e, x = (brute_mark(s) for s in (t, edited, nxt))
        want.append((-1 if doc is None else doc, len(t), sha(edited), brute_text(m), brute_text(e), round(brute_likeness(m, e), 5), round(brute_likeness(m, x), 5)))
    for buckets in (None, 1, 6):
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 5), round(r.near_next, 5)) for r in multiset.edited_fingerprints(both, buckets).collect()]
        assert len(got) == len(want)
        for a, b in zip(sorted(got), sorted(want)):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4


def test_fingerprints_are_homomorphic(spark):
    rows = [("ab", "one two\nthree four"), ("ba", "three four\none two"), ("a", "one two"), ("b", "three four"), ("abb", "one two\nthree four\nthree four")]
    marks = multiset.fingerprints(spark.createDataFrame(rows, "k string, text string"), "k")
    m = F.struct("n_runs", "counters", "lanes")
    one = marks.groupBy().pivot("k", ["ab", "ba", "a", "b", "abb"]).agg(F.first(m))
    r = one.select(
        (F.col("ab.lanes") == F.col("ba.lanes")).alias("order"),
        (multiset.combine(F.col("a"), F.col("b"))["lanes"] == F.col("ab.lanes")).alias("insert"),
        (multiset.combine(F.col("abb"), F.col("b"), -1)["lanes"] == F.col("ab.lanes")).alias("delete"),
        (F.col("abb.lanes") == F.col("ab.lanes")).alias("multiset"),
    ).first()
    assert (r.order, r.insert, r.delete, r.multiset) == (True, True, True, False)


def test_whole_fingerprints_are_homomorphic(spark):
    a, b = "one two\n  three four, five six seven eight nine ten eleven", "\x0bтри четыре " + "long" * 12 + "\t\r"
    rows = [("ab", f"{a}\n{b}"), ("ba", f"{b}\n{a}"), ("a", a), ("b", b), ("abb", f"{b}\n{a}\n{b}"), ("turned", "\n".join(reversed(f"{a}\n{b}".split("\n"))))]
    names = [k for k, _ in rows]
    m = F.struct("n_runs", "counters", "lanes")
    marks = multiset.fingerprints(spark.createDataFrame(rows, "k string, text string"), "k")
    one = marks.groupBy().pivot("k", names).agg(F.first(m))
    digest = lambda x: multiset.as_text(x["lanes"], x["counters"])
    put, taken = one.select("*", multiset.combine(F.col("a"), F.col("b")).alias("put"), multiset.combine(F.col("abb"), F.col("b"), -1).alias("taken")), ("put", "taken")
    r = put.select(*names, *taken, *[digest(F.col(k)).alias(f"{k}_text") for k in (*names, *taken)]).first()
    for k in ("ba", "turned", *taken):
        assert r[k] == r["ab"] and r[f"{k}_text"] == r["ab_text"], k
    assert r["abb_text"] != r["ab_text"] and r["ab"].n_runs > 5


def test_likeness_outlives_a_shift_in_a_line(spark, prose):
    text = prose(300)
    pair = spark.createDataFrame([(0, text), (1, "one more " + text)], "k long, text string")
    marks = multiset.fingerprints(pair, "k").groupBy().pivot("k", [0, 1]).agg(F.first(F.struct("n_runs", "counters", "lanes")))
    assert marks.select(multiset.likeness(F.col("0"), F.col("1")).alias("x")).first().x > 0.7
