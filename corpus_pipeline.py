"""The corpus pipeline: documents through toxicity filter, line deduplication, SimHash near-deduplication, redaction of personal data, and packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the
columns of documents; the last returns pieces of packed sequences.  ``run`` writes each
stage's rows as Parquet in the shared folder and reads them as the next one's input.

No stage fails on nulls, empty or very long texts, repeated rows, an empty table or
columns of other names; see the operators for what they do with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, packing, pii, simhash, toxicity
from corpusloom.llm.common import drop_table, free_name, write_table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field scores below 0.5."""
    model, found = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name("_toxicity", docs)
    return toxicity.score(docs, model, to=found).where(F.col(found)["predicted"] == 0).drop(found)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks of lines (50 words or more) that an earlier document has."""
    return line_dedup.dedup(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more; the smallest doc_id stays.

    Rows of one doc_id are one document: they stay or go together, and of those with equal texts one stays.
    Rows with a null doc_id have no identity to choose by, and stay.
    """
    found = simhash.similar_documents(docs.select("doc_id", "text"), words=5, least=0.8)
    kept, digest = free_name("_kept", docs), free_name("_text_hash", docs)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(kept))
    named = docs.where("doc_id is not null").join(first, F.col("doc_id").cast("long") == F.col(kept), "left_semi")
    named = named.withColumn(digest, F.sha2("text", 256)).dropDuplicates(["doc_id", digest]).drop(digest)
    return named.unionAll(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans of personal data replaced by their kinds."""
    return pii.redact(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("simhash", remove_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models, message passing and tokenizers are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_table(spark, before)
        before = path
    return docs
