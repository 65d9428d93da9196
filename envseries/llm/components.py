"""Connected components of an edge table, by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): equal root if and only if connected.

    Each round maps every node to the first node within two steps of it, in an order drawn anew for the round, and
    contracts the edges to the images.  A star falls together in one round, paths shrink by a constant factor, so
    rounds grow with the logarithm of the longest path.  A hub is one group of a min aggregate, combined before the
    shuffle.
    """
    live = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a <> b").distinct(), name)
    labels, turn = None, 0
    while not live.isEmpty():
        turn += 1

        def first(df, node, value):
            rank = F.min(F.struct(F.xxhash64(F.lit(turn), F.col(value)).alias("h"), F.col(value).alias("id")))
            return df.groupBy(node).agg(rank.alias("m")).select(F.col(node).alias("node"), F.col("m.id").alias("to"))

        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(first(both.union(both.select("a", F.col("a").alias("b"))), "a", "b"), name)
        reach = both.join(near.withColumnRenamed("node", "b"), "b").select("a", F.col("to").alias("b"))
        image = written(first(reach.union(near.select(F.col("node").alias("a"), F.col("to").alias("b"))), "a", "b"), name)
        left, right = (image.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        live = written(live.join(left, "a").join(right, "b").filter("a_to <> b_to")
                       .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), name)
        labels = image.withColumnRenamed("to", "root") if labels is None else moved(labels, image, name)
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def moved(labels: DataFrame, image: DataFrame, name: str) -> DataFrame:
    """``labels`` with each root replaced by its image (node, to), where it has one."""
    step = image.select(F.col("node").alias("root"), "to")
    return written(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), name)
