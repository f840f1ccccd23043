"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import chat, filter_audit, fim, fingerprints, hyperminhash, jumphash, linmaxmatch, oracles, packing, ppm_langid, rindex_dedup, segment_topk, toxicity, trie_bpe
from curatrix.llm.common import table, utf8_bytes

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
CAPACITY = 4096
SHARDS = 24
TOP = 20
REPEAT_BYTES = 400
HELD_OUT = 2


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.harmonic_pack(table(spark, sf_dir, "documents"), packing.vocabulary(WORD_BPE), END_ID, CAPACITY)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Only what an edit can take of the next text's head travels with it: no document replaces more than it has.
    pairs = fingerprints.with_next(docs, "doc_id", "text", "next_text")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    names = {"text": "fingerprint", "edited": "edited_fingerprint"}
    out = fingerprints.fingerprint_columns(rows, names, ["doc_id", "n_chars", "edited_sha256"])
    out = fingerprints.with_next(out, "doc_id", "fingerprint", "next_fingerprint")
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hyperminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, threshold=Fraction(80, 100))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return segment_topk.topk(vectors, vectors.filter(F.col("vec_id") % 20 == 0), TOP)


def op5_linmaxmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linmaxmatch.count_tokens(docs, linmaxmatch.read_pieces(PIECES), keep=["doc_id"])


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The control conversation has a number of its own, whatever numbers the table has.
    control = chat.control_conversation(spark).withColumn("own", F.lit(1))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("own", F.lit(0)).unionByName(control)
    turns = turns.withColumn("parts", chat.text_parts(F.coalesce("text", F.lit("")))).withColumn("conv", F.struct("own", "conv_id"))
    out = chat.format_conversations(turns, "conv").withColumn("conv_id", F.col("conv.conv_id"))
    read = out.withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn("_loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    model = ppm_langid.train(docs.filter(fold != HELD_OUT), "text", "lang", F.col("doc_id"))
    out = ppm_langid.identify(docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (utf8_bytes("text") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = jumphash.assign_shards(docs, "doc_id", SHARDS, SHARDS + 1, ["text_crc32", "size"], spread="text_crc32")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = trie_bpe.bpe_encode(docs, packing.vocabulary(WORD_BPE), keep=["doc_id"], decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", utf8_bytes("text"))
    out = rindex_dedup.remove_repeats(docs, REPEAT_BYTES, keep=["doc_id", "n_bytes"])
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        F.col("kept_text").alias("text"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fim.transform(docs, fim.draws("1", F.col("doc_id")), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    machine = toxicity.train(docs.filter(fold != HELD_OUT).select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.toxicity(docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text"), machine, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_canonical_fingerprint": op2_canonical_fingerprint,
    "op3_hyperminhash": op3_hyperminhash,
    "op4_segment_topk": op4_segment_topk,
    "op5_linmaxmatch": op5_linmaxmatch,
    "op6_chat_format": op6_chat_format,
    "op7_ppm_language": op7_ppm_language,
    "op8_jump_sharding": op8_jump_sharding,
    "op9_trie_bpe": op9_trie_bpe,
    "op10_rindex_dedup": op10_rindex_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_subsequence_toxicity": op13_subsequence_toxicity,
}

ORACLE = {
    "op3_hyperminhash": oracles.NEAR_DUPLICATES,
    "op4_segment_topk": oracles.TOP_K,
    "op6_chat_format": oracles.CHAT,
    "op8_jump_sharding": oracles.jump_sharding(SHARDS),
    "op10_rindex_dedup": oracles.repeats(REPEAT_BYTES),
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op12_filter_audit": oracles.FILTER_AUDIT,
}
