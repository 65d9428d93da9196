"""Mixing sources to target weights: Efraimidis-Spirakis order, budgets by prefix sums.

Every document gets an exponential key -ln(u) / weight, where u comes from a digest of its id and the weight is its
quality; sorted by key within its source that is a weighted sample without replacement at every prefix.  A source's
target is met by complete epochs first, then by the documents whose running size stays within the rest.

The running sum needs no sorted source: sizes are summed in 4096 slices of the key range, then the one slice that holds
the budget's end is sliced again, and only rows of that last slice (one in 16 million of a source) are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .storage import written

SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Share of letters and blanks among the characters, in (0, 1]: the weight of a document in its source."""
    plain = F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", "")
    return F.coalesce((F.length(plain) + 1) / (F.length(text) + 1), F.lit(1.0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    digest = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    text = F.col(text_col).cast("string")
    slot = (F.col("_key") / (F.col("_key") + 1) * (SLICES * SLICES)).cast("long")
    return (docs.withColumn("_size", text_size(text)).withColumn("_key", -F.log(u) / text_quality(text))
            .withColumn("_source", F.col(source_col).cast("string")).withColumn("_id", F.col(id_col))
            .withColumn("_b1", (slot / SLICES).cast("long")).withColumn("_b2", slot % SLICES))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> + target.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the total by weight; a target stops at 3
    times its source's size, the excess goes to the others by weight.  One row per source is all that is ordered here.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = (sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", (F.col("rank") - 1) % 3 + 1)
         .withColumn("cap", 3 * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w")))
    by_ratio = W.orderBy("r", "rank")
    everything = W.partitionBy()
    level = ((F.sum("source_size").over(everything)
              - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             / F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", level)
    # the first source, by cap / weight, that its cap does not bind sets the common level
    common = F.min(F.when(F.col("r") > F.col("level"), F.struct("r", "rank", "level"))).over(everything)["level"]
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(common * F.col("w"), F.lit(0.0)))) \
        .select("source", "source_size", "target")


def _cuts(keyed: DataFrame) -> DataFrame:
    """Per source: target, complete epochs, and where in the key order the fraction of a further epoch ends."""
    # sizes are added up from the slices, so a source that holds most rows is summed before any shuffle
    first = written(keyed.groupBy("_source", "_b1").agg(F.sum("_size").alias("s")), "op9-slices")
    sizes = first.groupBy(F.col("_source").alias("source")).agg(F.sum("s").alias("source_size"))
    plan = targets(sizes)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = written(plan, "op9-plan")
    cut1 = _ending(first, plan.select("source", "rest"), "_b1")
    at1 = cut1.select("source", "_b1", F.col("left"))
    inside = written(keyed.select("_source", "_b1", "_b2", "_key", "_id", "_size").join(
        at1.select(F.col("source").alias("_s"), F.col("_b1").alias("_at")),
        F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b1") == F.col("_at"))).drop("_s", "_at"), "op9-slice")
    second = inside.groupBy("_source", "_b2").agg(F.sum("_size").alias("s"))
    cut2 = _ending(second, cut1.select("source", F.col("left").alias("rest")), "_b2")
    last = inside.join(cut2.select(F.col("source").alias("_s"), F.col("_b2").alias("_at"), "left"),
                       F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b2") == F.col("_at")))
    # rows that repeat an id tie: they come in or stay out together
    order = W.partitionBy("_source").orderBy("_key", "_id")
    same = W.partitionBy("_source", "_key", "_id")
    last = last.withColumn("upto", F.sum("_size").over(order.rangeBetween(W.unboundedPreceding, 0))) \
        .withColumn("own", F.sum("_size").over(same))
    taken = last.filter(F.col("upto") - F.col("own") / 2 <= F.col("left")).groupBy("_source").agg(
        F.max(F.struct("_key", "_id")).alias("last"))
    out = plan
    for extra, cols in ((cut1, ["_b1"]), (cut2, ["_b2"])):
        e = extra.select(F.col("source").alias("_s"), *[F.col(c).alias(f"cut{c}") for c in cols])
        out = out.join(e, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    e = taken.select(F.col("_source").alias("_s"), F.col("last._key").alias("cut_key"), F.col("last._id").alias("cut_id"))
    return written(out.join(e, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
                   .withColumnRenamed("source", "_s"), "op9-cuts")


def _ending(slices: DataFrame, rest: DataFrame, b: str) -> DataFrame:
    """The slice in which each source's running size passes ``rest``, and what is left of it there."""
    run = F.sum("s").over(W.partitionBy("_source").orderBy(b))
    s = slices.withColumn("upto", run).join(
        rest, F.col("_source").eqNullSafe(F.col("source"))).filter("upto > rest")
    return s.groupBy("source").agg(F.min(F.struct(b, (F.col("rest") - F.col("upto") + F.col("s")).alias("left")))
                                   .alias("m")).select("source", f"m.{b}", "m.left")


def _copies(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``_copies``: how often the mix takes the row (0 to 3)."""
    rows = keyed.join(cuts, F.col("_source").eqNullSafe(F.col("_s")))
    before = F.expr("""_b1 < cut_b1 OR (_b1 = cut_b1 AND (_b2 < cut_b2 OR (_b2 = cut_b2 AND
        (_key < cut_key OR (_key = cut_key AND (_id IS NULL OR _id <= cut_id))))))""")
    return rows.withColumn("_copies", F.col("epochs") + F.when(before, 1).otherwise(0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: str = "mix") -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    Null texts have size 0, a null source is a source of its own, rows that repeat an id (or have none) are taken
    alike if keys are equal; empty tables give no rows.  Same rows and seed, same mix, in whatever order they come.
    """
    keyed = written(_keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                       F.col(source_col).alias("source")), "doc_id", "text", "source", seed)
                    .drop("text", "source"), "op9-keyed")
    return _copies(keyed, _cuts(keyed)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: str = "mix") -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as it is taken, with all its columns."""
    names = docs.columns
    keyed = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_i"),
                               F.col(text_col).alias("_t"), F.col(source_col).alias("_src")), "_i", "_t", "_src", seed)
    cuts = _cuts(written(keyed.drop("_row", "_i", "_t", "_src"), "op9-keyed"))
    rows = _copies(keyed, cuts).filter("_copies > 0")
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))) \
        .select(*[F.col("_row").getField(c).alias(c) for c in names])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
           / coalesce((length(regexp_replace(text, '[^\p{L}\x20\x09-\x0D]+', '', 'g')) + 1) / (length(text) + 1), 1.0) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, (rank - 1) % 3 + 1 AS w, 3 * source_size AS cap, (3 * source_size) / ((rank - 1) % 3 + 1) AS r FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY r, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY r, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
l AS (SELECT arg_min(level, r) AS common FROM s3 WHERE r > level),
s4 AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(common * w, 0.0)) AS target FROM s3, l),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS epochs FROM s4),
p AS (SELECT d.*, s5.source_size, s5.target, s5.epochs, greatest(0.0, s5.target - s5.epochs * s5.source_size) AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id) AS upto,
             sum(size) OVER (PARTITION BY d.source, k, doc_id) AS own
      FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((epochs + CASE WHEN upto - own / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p
"""
