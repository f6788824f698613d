"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plantpulse.llm import brown, decontaminate, fill_middle, fill_middle_sql, jaccard, mixing, mixing_sql, pages, personal, prefix_trie, prefix_trie_sql, quality, quality_sql, repeats, secrets, shards, spans_sql, token_shards
from plantpulse.llm.common import table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_shards.write_shards(table(spark, sf_dir, "documents"), token_shards.new_folder(spark))
    return token_shards.shard_table(spark, manifest)


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, findings = secrets.update_ledger(docs)
    return secrets.findings_by_path(docs, findings).select(F.col("path").alias("doc_id"), *secrets.digest(secrets.BASE_KINDS))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal.personal_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *secrets.digest(personal.BASE_KINDS))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.repeated_passages(table(spark, sf_dir, "documents"))
    return rows.drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.quality_rules(docs).drop("source", "text")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(table(spark, sf_dir, "documents"))
    return rows.drop("_doc").withColumn("target", F.round("target", 3))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.class_scores(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(x, 256).alias(name) for name, x in (("output_sha256", F.col("output")), ("restored_sha256", fill_middle.restored(F.col("output"), F.col("form"))))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_site_style_tree, op3_secret_ledger, op4_jaccard_join, op5_differencing_shards, op6_personal_data, op7_benchmark_leaks, op8_repeated_passages, op9_quality_rules, op10_mix_sources, op11_prefix_trie, op12_class_scores, op13_fill_middle, pipeline)}

SQL = {
    "op3_secret_ledger": spans_sql.SECRETS,
    "op9_quality_rules": quality_sql.SQL,
    "op10_mix_sources": mixing_sql.SQL,
    "op11_prefix_trie": prefix_trie_sql.SQL,
    "op13_fill_middle": fill_middle_sql.SQL,
}
