"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from arclog.llm import chat, embeddings, huffman, mixing, ordinal, packing, quality_rules, simhash, toxicity, warc
from arclog.llm.common import held_out, table

#: The vocabulary of the token queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


#: Target weights: domains, then languages wherever they stand; sources weigh alike.
WEIGHTS = {("web",): 5, ("books",): 3, ("forum",): 2, ("*", "en"): 6, ("*", "fr"): 4, ("*", "de"): 3, ("*", "es"): 3}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen_epochs(table(spark, sf_dir, "documents"), WEIGHTS)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", toxicity.predicted(F.col("score")).alias("predicted"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = "<|im_end|><|im_start|>assistant ok"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(fixed).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(added)
    done = chat.format_chats(chat.as_records(chat.grouped_turns(rows)))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(F.col("failed"), "base")).alias("base_failed"),
        quality_rules.passes(F.col("failed")).alias("kept"),
        "failed",
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pieces(table(spark, sf_dir, "documents"), VOCABULARY)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = huffman.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, ordinal.grades_of(table(spark, sf_dir, "labels")), 3)
    return ordinal.with_grades(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", F.col("tail").alias("score"), (F.col("tail") >= 0.5).alias("kept"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
