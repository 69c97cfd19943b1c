"""The queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import arrowfile, automata, bpe, chat, copies, embeddings, langid, minhash, multiset, oracle, packing, phrases, suffixes, trie
from sitewright.llm.common import new_path, table, tokenizer_file

_EXTRA_CHAT = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _EXTRA_CHAT), (-7, 1, "assistant", _EXTRA_CHAT)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.expand_chats(turns.unionByName(extra)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode_documents(encoded, ranks))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "sequences")
    manifest = arrowfile.write_sequences(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return arrowfile.read_documents(manifest)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), percent=85)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.digests(automata.remove_seen(table(spark, sf_dir, "documents")))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.exact_copies(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
