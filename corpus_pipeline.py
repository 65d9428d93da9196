"""From raw documents to training-order token shards: stages over the table documents.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``docs``; the last returns one row per sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envseries.llm import decontamination, mixing, near_dedup, quality_gam, token_shards
from envseries.llm.storage import few, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.7) go."""
    return quality_gam.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8) one document stays.

    Documents are told apart by id and text together, so an id that occurs with different texts, or a null id, loses
    nothing but near copies.  Of a row that is repeated one stays, unless its text has no words.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = written(near_dedup.near_groups(keyed, words=5, id_col=key)
                     .select(F.col("doc_id").alias(key), "kept", "n_shingles"), "pipeline-groups")
    gone = written(groups.filter("NOT kept").select(key).distinct(), "pipeline-gone")
    left = keyed.join(few(gone), key, "left_anti")  # texts are not exchanged for a few keys
    twice = written(groups.filter("kept AND n_shingles > 0").groupBy(key).count().filter("count > 1").select(key), "pipeline-twice")
    if not twice.isEmpty():
        left = left.join(twice, key, "left_anti").unionByName(left.join(twice, key, "left_semi").dropDuplicates([key]))
    return left.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of the template windows of a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight: a document comes as often as the mix takes it, 0 to 3 times."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in fixed-stride shards, in a keyed random order; read back, one row per sequence."""
    return token_shards.materialised(docs)


STAGES = [("quality classifier", quality), ("near-duplicate removal", near_duplicates),
          ("benchmark decontamination", decontaminate), ("mixing to target weights", mix),
          ("token shards", tokens)]

#: The trained classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
