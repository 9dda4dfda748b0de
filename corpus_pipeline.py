"""From raw documents to sampled token ids, in five stages that each call one operator of ``evalspark.llm``.

A stage takes (spark, docs, sf_dir) and returns the rows that go on; all but the last return the columns of documents.
Every stage keeps NULL ids, NULL and empty texts and repeated rows unless its decision is about them: equal texts
(empty ones too) are copies of each other in stage 2.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, secret_spans, segment, simhash, toxicity
from evalspark.llm.common import fold, free_name, shared_dir, small_batches, table


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """The stage in a session whose rows go to Python in small batches, as five stages share the executors."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose estimated toxicity is below 0.7, by a model of the labels whose fold may be seen."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, score).filter(~toxicity.rejected(F.col(score))).select(*docs.columns)


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles differ in at most two bits."""
    return simhash.one_of_each(docs, words=3, budget=2)


@in_small_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars is the length of the new text."""
    texts = docs.select("text")
    model = secret_spans.train(secret_spans.ordinary_samples(texts).unionByName(secret_spans.generated_samples(spark)))
    out = secret_spans.redact(docs, model)
    changed = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@in_small_batches
def sample_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return segment.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", redact_secrets),
    ("sentencepiece sampling", sample_ids),
]
ORACLE_SQL = None  # trained models, fingerprints and sampling are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
