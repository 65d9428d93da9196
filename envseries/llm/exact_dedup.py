"""Exact deduplication by deterministic block naming (DataFrame functions only).

Each normalised text is cut into fixed-size blocks.  The distinct blocks are sorted and every block gets an integer
name; then adjacent names are paired, the distinct pairs sorted and named in turn, until each document is left with
one name.  Equal (level, name) means equal text: names are given to the values themselves, never to hashes.

Texts move once: a 64-bit hash only routes blocks to their names.  That no two distinct blocks share a hash is checked
over all of them; if some do, these are named and looked up by their content.  A hot block or pair is reduced to one row per map task before it is shuffled, and the
lookups are plain joins of two written tables, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

BLOCK_CHARS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text):
    """Null as empty; only A-Z lower-cased (``lower`` does just that to texts of one-byte characters)."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _blocks(text, size: int):
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def _named(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys``, sorted within their hash partitions, each with a unique integer name."""
    return (values.select(*keys).distinct().sortWithinPartitions(*keys)
            .withColumn("name", F.monotonically_increasing_id()))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased, null as empty) the row with the largest id stays.  Rows with a null id belong to
    their group and stay only if no row of it has an id (keep_id is then null); rows that repeat the id that stays
    are all marked kept.  Empty tables give no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_t"))
    blocks = (rows.select(F.explode(_blocks(F.col("_t"), block_chars)).alias("block"))
              .select(F.xxhash64("block").alias("h"), "block"))
    names = written(_named(blocks, ["h", "block"]).select("h", "name"), "op7-blocks")
    shared = written(names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "op7-shared")

    hashes = F.transform(_blocks(F.col("_t"), block_chars), lambda b: F.xxhash64(b))
    base = written(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                               F.sha2(F.col("_t"), 256).alias("text_sha256"), hashes.alias("hs")), "op7-rows")
    placed = base.select("rid", F.posexplode("hs").alias("pos", "h"))
    if shared.isEmpty():
        current = placed.join(names, "h")
    else:  # a hash that two blocks share cannot route: those blocks are named, and looked up, by content
        twins = written(_named(blocks.join(shared, "h"), ["h", "block"]).select(
            "h", "block", (F.lit(-2) - F.col("name")).alias("twin")), "op7-twins")
        text = rows.select(F.sha2(F.col("_t"), 256).alias("text_sha256"),
                           F.posexplode(_blocks(F.col("_t"), block_chars)).alias("pos", "block"))
        found = (text.withColumn("h", F.xxhash64("block")).join(twins, ["h", "block"])
                 .select("text_sha256", "pos", "twin").distinct())
        current = (placed.join(names.join(shared, "h", "left_anti"), "h", "left")
                   .join(base.select("rid", "text_sha256"), "rid").join(found, ["text_sha256", "pos"], "left")
                   .withColumn("name", F.coalesce("name", "twin")))
    current = _sequences(current.select("rid", "pos", "name"), "op7-level0")

    done, level = [], 0
    while True:
        done.append(current.filter(F.size("names") == 1)
                    .select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        current = current.filter(F.size("names") > 1)
        if current.isEmpty():
            break
        level += 1
        pairs = current.select("rid", F.expr("""posexplode(transform(sequence(0, cast((size(names) + 1) / 2 AS int) - 1),
            i -> named_struct('l', names[2 * i], 'r', coalesce(try_element_at(names, 2 * i + 2), -1))))""")
                               .alias("pos", "p")).select("rid", "pos", "p.l", "p.r")
        named = written(_named(pairs, ["l", "r"]), f"op7-names{level}")
        current = _sequences(pairs.join(named, ["l", "r"]).select("rid", "pos", "name"), f"op7-level{level}")

    identity = done[0]
    for more in done[1:]:
        identity = identity.union(more)
    identity = written(identity.join(base.select("rid", "doc_id", "text_sha256"), "rid")
                       .select("level", "name", "doc_id", "text_sha256"), "op7-identity")
    groups = written(identity.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"),
                                                           F.count(F.lit(1)).alias("group_size")), "op7-groups")
    return identity.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _sequences(placed: DataFrame, name: str) -> DataFrame:
    """(rid, names in order): as long as one document, never a group of documents."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return written(placed.groupBy("rid").agg(ordered.alias("names")), name)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
