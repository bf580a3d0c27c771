"""From raw documents to packed training sequences, a stage at a time.

Each stage works on all rows that the one before it kept, and its result is written and read again. Nulls, empty texts and
repeated rows are treated as each operator's module says; null and empty texts leave at the first stage, as no language
can be told. Other columns pass through all stages but the last, whatever they are called: working columns take names that
``docs`` doesn't have. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewright.llm import langid, mixing, packing, pii, simhash
from cubewright.llm.common import delete, fresh, made, release, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` is filled in."""
    model = langid.learn(docs.where(~F.coalesce(langid.held_out(), F.lit(False))))
    lang, score = fresh(docs, "lang_pred", "lang_score")
    kept = langid.identify(docs, model, (lang, score)).where(F.col(lang) != "und")
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the smallest id. Of rows that repeat it, one stays."""
    keys = fresh(docs, "id", "th")
    kept = simhash.near_copies(docs).where("keep").select(F.col("__id").alias(keys[0]), F.col("__th").alias(keys[1])).distinct()
    rows = simhash.row_keys(docs, tuple(keys)).join(kept, keys, "left_semi")
    return rows.dropDuplicates(keys).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind."""
    (spans,) = fresh(docs, "pii")
    return pii.redact(pii.find_pii(docs, spans), spans).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("packing", pack)]
#: The sketches of stage two and the tokenizer of the last one can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        since, path = made(), f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, since)  # what the stage wrote on its way, and what it read
        if before:
            delete(spark, before)
        before, docs = path, spark.read.parquet(path)
    return docs
