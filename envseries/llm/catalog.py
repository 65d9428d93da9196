"""The registered queries of this package: opN_<name> over the whole of the given tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, decontamination, exact_dedup, language_id, masked_lm, mixing, near_dedup, quality_gam,
               spelling, token_shards, toxicity_fm, url_rules, warc)
from .storage import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2).drop("sid")


def op2_feistel_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialised(table(spark, sf_dir, "documents"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_script_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.language_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_efraimidis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op11_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"))


def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_collocation_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_feistel_token_shards, op3_template_decontamination, op4_masked_pseudo_likelihood,
    op5_script_viterbi_language, op6_quality_gam, op7_block_naming, op8_toxicity_fm,
    op9_efraimidis_mix, op10_warc_salvage, op11_url_association_rules,
    op12_spelling_trie, op13_collocation_streams)}
ORACLE_SQL = {"op7_block_naming": exact_dedup.ORACLE_SQL, "op9_efraimidis_mix": mixing.ORACLE_SQL,
              "op10_warc_salvage": warc.ORACLE_SQL, "op12_spelling_trie": spelling.ORACLE_SQL,
              "op13_collocation_streams": collocations.ORACLE_SQL}
