"""Queries over the test tables, one for each operator, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sward.llm import conversation_repair, decontaminate, language, language_model, merkle, near_duplicates, packing, pii, prefix_trie, quality, secret_scan, shards, toxicity
from sward.llm.common import fold, read

SHARDS = 40


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    model = language.train(docs.where(~held_out))
    return language.identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_rows(read(spark, sf_dir, "labels")))
    return toxicity.score(docs.withColumn("held_out", fold("doc_id", 5) == 0), model, ["doc_id", "held_out"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, quality.training_rows(read(spark, sf_dir, "labels")))
    return quality.score(docs.withColumn("held_out", fold("doc_id", 5) == 0), model, ["doc_id", "held_out"])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(read(spark, sf_dir, "documents")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(read(spark, sf_dir, "documents"), SHARDS)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(read(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    return language_model.score(docs, language_model.train(docs, ~held_out), others={"held_out": held_out})


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(read(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(read(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(read(spark, sf_dir, "conversations")), copies="copies")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_language,
        op3_toxicity,
        op4_quality,
        op5_pii,
        op6_sharding,
        op7_near_duplicates,
        op8_language_model,
        op9_packing,
        op10_fingerprints,
        op11_secrets,
        op12_conversation_repair,
        op13_prefix_trie,
        pipeline,
    )
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op6_sharding": shards.ORACLE,
    "op10_fingerprints": merkle.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
