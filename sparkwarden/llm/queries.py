"""The registered queries of the text operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import bpe, language, mixing, negatives, neighbours, pii, ppm, quality, resampling, rules, simhash, toxicity, warc
from sparkwarden.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, weights).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"))
    style = quality.train(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs, style).select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs, ~out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), ppm.held_out(F.col("doc_id"))
    scored = ppm.score(docs, ~out & F.col("doc_id").isNotNull())
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.where("vec_id % 20 = 0"), vectors)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_mixing, op4_quality, op5_language, op6_rules, op7_simhash, op8_ppm, op9_pii, op10_neighbours, op11_resampling, op12_warc, op13_negatives)}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op10_neighbours": neighbours.ORACLE, "op11_resampling": resampling.ORACLE, "op12_warc": warc.ORACLE, "op13_negatives": negatives.ORACLE}
