"""Repeated and null ids, ties, blank and very long texts, clashing names: every operator over texts on the same odd table."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from sitewright.llm import arrowfile, automata, bpe, chat, langid, minhash, multiset, packing, suffixes
from sitewright.llm.common import new_path, tokenizer_file
from tests.llm.test_operators import RANKS, brute_groups, reference_encoding, sha

SCHEMA = "doc_id long, text string, lang string, chunk long, code int, shard string, kept boolean, component_id long, spans string, length long, part int, place int, copy boolean"


@pytest.fixture()
def odd(spark, prose):
    """Rows with every other column named as some operator names its own."""
    long = prose(30_000)
    texts = [(3, "same words here"), (3, "same words here"), (3, "other words"), (None, "no id at all"), (None, "no id at all"), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, "z" * 3000), (9, "é" * 700), (10, "12 34 !!"), (11, "<|endoftext|> here")]
    rows = [(k, t, [None, "en", "fr"][i % 3], i, i, "s", True, i, "x", i, i, i, False) for i, (k, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def library(name):
    """The call of the contracts, as it is."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def test_bpe(odd):
    enc = reference_encoding()
    got = bpe.digests(bpe.decode_documents(bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN), RANKS)).collect()
    want = [(k, enc.encode_ordinary(t), t) for k, t in pairs(odd)]
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got], [(k, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t)) for k, ids, t in want])


def test_token_files(spark, odd):
    ids = library("byte_bpe_50k.json")
    got = arrowfile.read_documents(arrowfile.write_sequences(odd, new_path(spark, "odd"), tokenizer_file("byte_bpe_50k.json"))).orderBy("start").collect()
    want, start = [], 0
    for k, t in sorted(pairs(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        own = [*ids(t), 0]
        want.append((k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_packing(odd):
    ids = library("word_bpe_49k.json")
    got = packing.pack_documents(odd, tokenizer_file("word_bpe_49k.json"), 1).collect()
    want = []
    for k, t in pairs(odd):
        own = [*ids(t), 1]
        want += [(k, i // 4096, i, bytes(np.array(own[i : i + 4096], "<u4"))) for i in range(0, len(own), 4096)]
    same([(r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got], want)
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        assert [o for o, _ in sorted(spots)] == np.cumsum([0, *[n for _, n in sorted(spots)]])[:-1].tolist() and sum(n for _, n in spots) <= 4096


def test_language(odd):
    got = langid.identify(odd).collect()
    same([r.doc_id for r in got], [k for k, _ in pairs(odd)])
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 10)} == {"und"}


def test_near_groups(odd):
    got = minhash.near_groups(odd, 85).collect()
    assert len(got) == len(pairs(odd))
    some = brute_groups({k: t for k, t in pairs(odd) if k not in (3, None)})
    for r in got:
        if r.doc_id in some:
            assert (r.n_shingles, r.component_id, r.kept) == some[r.doc_id]
        elif r.doc_id == 3:
            assert (r.n_shingles, r.component_id, r.kept) == (1, 3, True)
        else:
            assert (r.component_id, r.kept) == (None, True)


def test_repeats(odd):
    same([(r.doc_id, r.n_bytes) for r in suffixes.remove_repeats(odd).collect()], [(k, len(t.encode())) for k, t in pairs(odd)])
    same([(r.doc_id, r.n_words) for r in automata.remove_seen(odd).collect()], [(k, len(t.encode().split())) for k, t in pairs(odd)])
    left = {r.doc_id: r.n_bytes - r.n_removed for r in suffixes.remove_repeats(odd).collect() if r.doc_id in (7, 8, 9)}
    assert left[7] > 100_000 and left[8] == left[9] == 0


def test_fingerprints(odd):
    got = multiset.edited_fingerprints(odd).collect()
    same([(r.doc_id, r.n_chars) for r in got], [(k, len(t)) for k, t in pairs(odd)])
    assert len({r.fingerprint for r in got}) == len({t for _, t in pairs(odd)})


def test_chats(spark):
    turns = [(1, 0, "user", "hi", "a"), (1, 0, "user", "hi", "b"), (1, 1, "assistant", None, "c"), (None, 0, "user", "lost", "d"), (2, None, None, "x", "e"), (2, None, "assistant", "y" * 20_000, "f")]
    got = chat.expand_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example string")).collect()
    assert sorted((r.conv_id, r.example, r.n_turns, r.is_last, r.loss_length) for r in got) == [(1, 0, 3, True, 0), (2, 0, 2, True, 20_000)]


def test_stages(spark, odd, tmp_path):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and {(r.doc_id, r.code) for r in out.collect()} <= {(r.doc_id, r.code) for r in odd.collect()}
    assert {r.code for r in corpus_pipeline.language(spark, odd, "").collect()} == {i for i, (_, t) in enumerate(pairs(odd)) if any(c.isalpha() for c in t)}
    kept = corpus_pipeline.near_copies(spark, odd, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept)[(3, "same words here")] == 1
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {3, None, 7, 8, 9, 11}
