"""From raw documents to token ids in five stages; each works on what the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again for the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflens.llm import bpe, decontaminate, langid, pii, simhash
from difflens.llm.common import shared_folder, table

#: SQL expresses neither the language model nor the components of near copies. The operators of the stages are tested, run() is not.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, which is their ``lang`` from here on, whatever they were labelled; those
    without a letter or a known n-gram, and those in which two languages have as many, go."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.as_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group whose fingerprints link at 3 bits (3-word shingles)."""
    return simhash.keep_one(docs, max_bits=3, shingle=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing words replaced in their texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact): token ids, and whether they decode to the text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    marked = docs.select("doc_id", "lang", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    decoded = bpe.round_trip(marked, path)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("decoded") == F.col("h")).alias("exact"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
