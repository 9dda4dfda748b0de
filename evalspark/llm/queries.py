"""The registered queries of this folder, one per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation, decontaminate, extract, hilbert, oracles, quality, repeats, runs, secret_spans, segment, simhash, token_files, toxicity,
    url_filter)
from .common import fold, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op12_conversation_repair": oracles.CONVERSATIONS, "op13_url_markov": oracles.URLS}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _scores(docs: DataFrame, score, parts: int, out: int) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), parts) == out, F.lit(True))
    return score(docs.select("doc_id", "text")).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return _scores(docs, lambda d: quality.score(d, model), 4, 2)


@query
def op5_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return _scores(docs, lambda d: toxicity.score(d, model), 3, 1)


@query
def op1_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_spans.train(secret_spans.ordinary_samples(docs).unionByName(secret_spans.generated_samples(spark)))
    found = secret_spans.scan(docs, model)
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secret_spans.joined(base), 256).alias("base_sha256"), secret_spans.joined(F.col("secrets")).alias("spans"))


@query
def op2_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_segment_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    cuts = segment.encode(table(spark, sf_dir, "documents"), model, check=True)
    return cuts.select("doc_id", "sample", F.size("ids").alias("n_ids"), "log_prob", "gumbel", "inclusion", "ids", "decodes")


@query
def op10_html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_token_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2)
    return token_files.checksums(spark, path)


@query
def op6_hilbert_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_repeats_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return left.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def _planted(text: Column, doc_id: Column) -> Column:
    """Of texts whose id's crc32 ends in 0, the words from some place on become periodic; words then have one blank between."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    part = F.floor(crc / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(runs.WORD), F.lit(0))

    def periodic(x: Column) -> Column:
        n = F.size(x["words"])
        first = (part % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + part % 8))).cast("int")
        return F.array_join(F.transform(x["words"], lambda w, i: F.when(i < first, w).otherwise(
            F.get(x["words"], first + (i - first) % period))), " ")

    bound = F.transform(F.array(F.struct(words.alias("words"))), lambda x: F.when(F.size(x["words"]) > 0, periodic(x)).otherwise(""))
    return F.when(crc % 10 == 0, F.get(bound, F.lit(0))).otherwise(text)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("text"), F.col("doc_id")).alias("text"))
    longer = lambda a, b: b["length"] * a["period"] - a["length"] * b["period"]
    order = lambda a, b: F.when(longer(a, b) != 0, F.signum(longer(a, b))).when(
        a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")
    found = runs.with_runs(docs).withColumn("best", F.get(F.array_sort("runs", order), F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
        (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("damage"))
    rows = rows.withColumns({
        "role": F.when(F.col("damage") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "copy": F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))})
    pieces = conversation.repair(rows, present=F.col("damage") != 0)
    return conversation.reports(pieces).withColumnRenamed("conv", "conv_id")


# fixed values: the rules of the contract
URL_RULES = (
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"))


@query
def op13_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
