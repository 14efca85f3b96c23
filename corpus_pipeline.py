"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.

Defined cases: null and empty texts go in the quality stage, since they have fewer than 50 words.
Rows that repeat an id are scored and judged alike; of them and of all near copies the
deduplication keeps one row; rows without id all pass it. Columns beyond those of documents are
left out in the first stage, whatever their names. Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclog.llm import mixing, packing, quality_rules, simhash, toxicity
from arclog.llm.common import DOCUMENT_COLUMNS, shared_folder, table
from arclog.llm.queries import VOCABULARY, WEIGHTS

#: Bytes of pieces that a worker of the packing stage keeps.
PIECES = 48 << 20


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs.select(*DOCUMENT_COLUMNS), model, column="_score")
    return scored.where(toxicity.predicted(F.col("_score")) == 0).select(*DOCUMENT_COLUMNS)


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    judged = quality_rules.with_ledger(docs.select(*DOCUMENT_COLUMNS))
    return judged.where(quality_rules.passes(F.col("_ledger.failed"))).select(*DOCUMENT_COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs.select(*DOCUMENT_COLUMNS))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, dealt to domains, languages and sources by weight; no document
    is taken twice. A document at a leaf's cut is shortened."""
    chosen = mixing.mixed(docs.select(*DOCUMENT_COLUMNS), WEIGHTS, ratio=(4, 5), epochs=1)
    return chosen.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their ids. Workers that have run the stages before
    keep few pieces."""
    return packing.pieces(docs, VOCABULARY, kept=PIECES).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality_rules", of_good_quality),
    ("simhash", without_near_duplicates),
    ("mixing", mixed_to_weights),
    ("packing", packed),
]

#: SQL cannot express the classifier's kernel, the fingerprints' hash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
