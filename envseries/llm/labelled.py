"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Most labelled rows a classifier is fitted on; beyond it those with the smallest hash of their id are taken.
SAMPLE_ROWS = 40_000


def remainder(id_col: str, mod: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def held_out(id_col: str, mod: int, rest: int):
    """Whether a row is set aside from learning; a null id is."""
    return F.coalesce(remainder(id_col, mod) == rest, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents that aren't held out, written.

    Only these ids are broadcast; rows with a null id or label are left out, repeated labels count once, the largest.
    """
    known = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id", mod, rest))
             .groupBy("doc_id").agg(F.max("y").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    chosen = written(known.select(F.col("doc_id").alias("_id"), "y"), "labelled-ids")
    return written(docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
                   .join(F.broadcast(chosen), "_id").select("text", "y"), "labelled-texts")
