"""Counts of smaller values and average ranks, by range partitions.

Distinct values with their counts are dealt out by range, so every partition
holds about the same number of them, whatever their distribution: the bounds
come from a sample of the values themselves.  A running count within each
partition plus the counts of all partitions before it gives the position of
a value; no group is sorted in one task and no value is special (infinities
included).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _q(name: str) -> str:
    return f"`{name}`"


def cumulative_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., value, _c, _before): each distinct non-null value with its rows and the group's rows below it.

    Equal values are counted map-side first, so a value of a third of all
    rows is one row here.  The range partitions are checkpointed: the bounds
    are sampled, and both uses below must see the same ones, also after a
    lost executor.
    """
    groups = list(groups)
    keys = [*groups, value]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    cut = materialize(counts.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    # more ranges than parts, so each part gets a task of its own; the window needs no exchange beyond it
    part_keys = ", ".join(_q(k) for k in ["_part", *groups])
    local = cut.repartitionByRange(4 * parts, "_part").selectExpr(
        "*", f"sum(_c) OVER (PARTITION BY {part_keys} ORDER BY {_q(value)} ROWS BETWEEN UNBOUNDED PRECEDING "
             "AND CURRENT ROW) AS _upto")
    ends = cut.groupBy("_part", *groups).agg(F.sum("_c").alias("_sum"))  # one row per part and group
    by = f"PARTITION BY {', '.join(map(_q, groups))} " if groups else ""
    ahead = ends.selectExpr("_part AS _p", *[f"{_q(g)} AS {_q('_g_' + g)}" for g in groups],
                            f"coalesce(sum(_sum) OVER ({by}ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING "
                            "AND 1 PRECEDING), 0) AS _ahead")
    same = [local["_part"] == ahead["_p"], *[local[g].eqNullSafe(ahead[f"_g_{g}"]) for g in groups]]
    return local.join(ahead, same).selectExpr(*[_q(k) for k in keys], "_c", "_ahead + _upto - _c AS _before")


def average_rank(df: DataFrame, value: str, groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average rank (ties share the mean rank) of ``value`` within ``groups`` (W7); null values get null.

    The rank table is joined back on (groups, value): AQE splits the rows of
    a hot value, of which the rank table holds one.
    """
    groups = list(groups)
    ranks = cumulative_counts(df, value, groups).selectExpr(
        *[f"{_q(k)} AS {_q('_r_' + k)}" for k in [*groups, value]], f"_before + (_c + 1) / 2.0D AS {_q(out)}")
    same = [df[value] == ranks[f"_r_{value}"], *[df[g].eqNullSafe(ranks[f"_r_{g}"]) for g in groups]]
    return df.join(ranks, same, "left").drop(*[f"_r_{k}" for k in [*groups, value]])
