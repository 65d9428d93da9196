"""MinHash near-deduplication: bottom-k sketches, inverted lists, union-sketch filter, exact verification.

One hash function gives every document the set of its word-shingle hashes; the k smallest are its sketch.  Documents
with equal sets form a class and are represented once.  Retained values are indexed in inverted lists; lists generate
overlaps, the union of two sketches estimates their similarity, and links are confirmed on the full sets.

Which pairs a list generates: two sets with Jaccard >= 0.8 share at least ``min_overlap`` retained values (for sets of
at most k members, whose sketch is the whole set, that is certain; otherwise Binomial(192, 0.8) falls below 122 with
probability 1e-8).  With each sketch sorted by how common its values are, such pairs must share one of the first
``len - min_overlap + 1`` values, so the common ones (passages in many documents) need no list, and a document most of
whose values are its own is in no list with others.

A list whose members already are one component is finished.  Short lists give all their pairs, longer ones compare every
member with a hub, the member with the fewest values of its own, and with more hubs each round until no list joins
different components.  So a group of n near copies costs about n comparisons, and nothing is dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, moved
from .storage import dropped, written
from .textscan import Words, shingle_sets, text_slices

SKETCH = 192
#: Values are kept as the upper 40 bits of their hash.
VALUE_BYTES = 5
#: Least agreement in the union sketch of sets with Jaccard 0.8: 5.7 standard deviations below the mean.
AGREE = 122
#: Buckets of the table of value counts: fixed, whatever the corpus.
COUNT_BITS = 21
#: Bits of the filter of documents whose full sets are wanted: fixed, whatever the corpus.
FILTER_BITS = 24
SHORT_LIST = 8
#: Bits of a set's signature, half of them in each of two longs.
SIGN_BITS = 128
#: Most bits in which the signatures of sets with Jaccard 0.8 differ: Binomial(128, 0.1) exceeds it with probability 1e-8.
SIGN_DIFF = 36


def min_overlap(n: int) -> int:
    """Retained values that a set of n shares, at least, with any set of Jaccard similarity 0.8 or more.

    Whole sets share 4/5 of the larger one; a larger set B cut to k values lacks at most n / 4 of them in a whole set.
    """
    return min(-(-4 * n // 5), SKETCH - -(-n // 4)) if n <= SKETCH else AGREE


def signature(s: np.ndarray) -> np.ndarray:
    """A bit of the least value in each of ``SIGN_BITS`` bins of a sorted set (empty bins: 0), as two longs.

    The bins' least values agree with the probability of the Jaccard similarity, and bits of different ones by half the
    chance.  Only bins that hold a member of one set alone can differ.
    """
    bits = np.zeros(SIGN_BITS, np.uint8)
    back = s[::-1]
    bits[back % np.uint64(SIGN_BITS)] = (back // np.uint64(SIGN_BITS)) % np.uint64(2)  # the least one is set last
    return np.packbits(bits).view(np.int64)


def packed(values: np.ndarray, keep: int) -> bytes:
    """Upper ``keep`` bytes of each 64-bit value."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 8 - keep:]).tobytes()


def unpacked(blob, keep: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, keep)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :keep] = raw
    return out.view(np.int64).ravel()


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per input row: doc_id, n (set size), sid (digest of the set, null if empty), sketch (its smallest values, packed),
    g0 and g1 (its signature)."""

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                sets = list(shingle_sets(Words(raw, offsets), words))
                sign = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                              for s in sets], pa.binary()),
                    pa.array([packed(s[:SKETCH], VALUE_BYTES) for s in sets], pa.binary()),
                    pa.array(sign[:, 0].copy()), pa.array(sign[:, 1].copy())],
                    names=["doc_id", "n", "sid", "sketch", "g0", "g1"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n long, sid binary, sketch binary, g0 long, g1 long")


def near_groups(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id = component_id), sid (class).

    Links: Jaccard similarity of the sets of distinct ``words``-word shingles of at least 0.8 (100 * intersection
    >= 80 * union); components are the transitive closure.  Null or blank texts have an empty set and link with nothing;
    texts with fewer words have one shingle.  Rows that repeat an id share its group and are kept or dropped
    together.  A null id stands for no document: it links others through its text no less, is never the id of a
    component unless alone in it, and counts as not kept unless its component has no id.  Other columns are ignored.
    """
    full = written(sketches(docs, words, id_col, text_col), "near-sketches")
    classes = written(full.filter("n > 0").groupBy("sid", "n").agg(
        F.min("doc_id").alias("min_id"), F.first("sketch").alias("sketch"), F.first("g0").alias("g0"),
        F.first("g1").alias("g1"))
        .withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    rows = written(full.select("doc_id", "n", "sid"), "near-rows")
    dropped(full)
    labels = _link(docs, classes, words, id_col, text_col)
    placed = classes.select("sid", "cid", "min_id").join(labels, F.col("cid") == F.col("node"), "left") \
        .select("sid", "min_id", F.coalesce("root", "cid").alias("root"))
    placed = written(placed, "near-placed")
    lowest = written(placed.groupBy("root").agg(F.min("min_id").alias("component_id")), "near-lowest")
    member = written(placed.join(lowest, "root").select("sid", "component_id"), "near-member")
    dropped(classes, placed, lowest)
    out = rows.select("doc_id", "n", "sid").join(member, "sid", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.col("doc_id").eqNullSafe(own).alias("kept"), F.hex("sid").alias("sid"))


def _counts(classes: DataFrame) -> np.ndarray:
    """How often retained values fall into each of 2 ** COUNT_BITS buckets: a table of fixed size."""
    size = 1 << COUNT_BITS

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for sketch in batch.column(0):
                np.add.at(total, unpacked(sketch.as_buffer(), VALUE_BYTES) & (size - 1), 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["b", "c"])

    got = classes.select("sketch").mapInArrow(run, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["b"].to_numpy()] = got["c"].to_numpy()
    return out


def _postings(classes: DataFrame) -> DataFrame:
    """(v, cid, n, len, rest) for the rarest values of each sketch; any fixed order of values keeps all similar pairs.

    ``rest``: how many values of the sketch come no earlier in that order.  At the first value that two sketches share
    the smaller rest bounds their overlap.
    """
    shared = classes.sparkSession.sparkContext.broadcast(_counts(classes))

    def run(batches):
        counts = shared.value
        for batch in batches:
            parts = []
            for c, n, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = unpacked(sketch.as_buffer(), VALUE_BYTES)
                rest = np.arange(len(s), min_overlap(n) - 1, -1)
                s = s[np.lexsort((s, counts[s & (len(counts) - 1)]))][:len(rest)]
                parts.append(np.stack([s, *(np.full(len(s), x) for x in (c, n, len(s))), rest]))
            if parts:
                yield pa.record_batch([pa.array(x) for x in np.concatenate(parts, 1)], names=["v", "cid", "n", "len", "rest"])

    return classes.select("cid", "n", "sketch").mapInArrow(run, "v long, cid long, n long, len long, rest long")


def _link(docs, classes, words, id_col, text_col) -> DataFrame:
    """(node, root) of the classes that are linked with another one."""
    postings = written(_postings(classes), "near-postings")
    several = written(postings.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("v"), "near-lists")
    active = written(postings.join(several, "v"), "near-shared")
    dropped(postings, several)
    # own: how many of a class's indexed values no other class has
    alone = active.groupBy("cid").agg((F.first("len") - F.count(F.lit(1))).alias("own"))
    shared = active
    active = written(shared.drop("len").join(alone, "cid").join(classes.select("cid", "g0", "g1"), "cid"), "near-active")
    dropped(shared)
    base = active
    labels = tested = sets = None
    short, hubs, turn = SHORT_LIST, 1, 0
    active = active.withColumn("most", F.col("n"))
    while not active.isEmpty():
        turn += 1
        members = active.withColumn("root", F.col("cid")) if labels is None else active.join(
            labels.withColumnRenamed("node", "cid"), "cid", "left").select(
                "v", "cid", "n", "own", "rest", "most", "g0", "g1", F.coalesce("root", "cid").alias("root"))
        open_lists = written(members.groupBy("v").agg(
            F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .filter("lo <> hi").select("v", "c"), "near-open")
        if open_lists.isEmpty():
            break
        members = written(members.join(open_lists, "v"), "near-members")
        dropped(base, open_lists)
        if turn > 2:  # the few classes still at stake: what they share is counted on their full sets
            plain = members
            members = written(plain.drop("most").join(_shared_sizes(plain, sets), "cid"), "near-bounded")
            dropped(plain)
        base = members
        pairs = _pairs(members, short, hubs, turn > 1)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        likely = written(_estimated(pairs, classes), "near-likely")
        active, limit = members.filter(F.col("c") > short).select("v", "cid", "n", "own", "rest", "most", "g0", "g1"), short
        if sets is None:  # those that later rounds may ask for, too
            wanted = likely.select(F.explode(F.array("a", "b")).alias("cid")).union(active.select("cid")).distinct()
            sets = _full_sets(wanted, docs, classes, words, id_col, text_col)
        found = written(_verified(likely, sets), "near-edges")
        if not found.isEmpty():
            if labels is None:
                labels = components(found, "near-components")
            else:
                for end in ("a", "b"):
                    root = labels.select(F.col("node").alias(end), F.col("root").alias("r"))
                    found = found.join(root, end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
                image = components(found, "near-components")
                fresh = image.join(labels.select("node"), "node", "left_anti")
                labels = written(moved(labels, image.withColumnRenamed("root", "to"), "near-labels").union(fresh),
                                 "near-labels")
        short, hubs = limit * 8, hubs * 8
    dropped(base, *([] if sets is None else [sets]))
    if labels is None:
        return classes.sparkSession.createDataFrame([], "node long, root long")
    return labels


def _shared_sizes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, most): how many shingles of each class any other member of ``members`` has, too: the most it can share.

    Links that are still to be found join two classes of ``members``, so shingles of one class alone are in none.
    """

    def run(batches):
        for batch in batches:
            for cid, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = np.unique(unpacked(blob.as_buffer(), 6))
                yield pa.record_batch([pa.array(s), pa.array(np.full(len(s), cid))], names=["s", "cid"])

    ids = members.select("cid").distinct()
    each = sets.join(ids, "cid", "left_semi").select("cid", "blob").mapInArrow(run, "s long, cid long")
    alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("cid")).filter("c = 1") \
        .groupBy("cid").agg(F.count(F.lit(1)).alias("alone"))
    whole = members.groupBy("cid").agg(F.first("n").alias("n"))
    return whole.join(alone, "cid", "left").select("cid", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))


def _pairs(members: DataFrame, short: int, hubs: int, once: bool) -> DataFrame:
    """Distinct (a, b), a < b, of different components and similar sizes: all pairs of short lists, hubs of others.

    ``once``: each row carries the earlier values of its class (fewer than ``SKETCH``), and two classes that share many
    short lists meet in the first of them alone.
    """
    side = lambda df, p, *more: df.select(*more, "v", F.col("cid").alias(f"{p}"), F.col("n").alias(f"n{p}"),
                                   F.col("rest").alias(f"t{p}"), F.col("root").alias(f"r{p}"),
                                   F.col("most").alias(f"m{p}"), F.col("g0").alias(f"g{p}"), F.col("g1").alias(f"h{p}"))
    # full sets of Jaccard 0.8 share 4/9 of their summed sizes, so 1/9 is in one of them alone
    differ = "bit_count(gx ^ gy) + bit_count(hx ^ hy)"
    fits = f"""x <> y AND rx <> ry AND 5 * least(nx, ny) >= 4 * greatest(nx, ny)
        AND 9 * least(mx, my) >= 4 * (nx + ny) AND CASE WHEN greatest(nx, ny) > {SKETCH} THEN {differ} <= {SIGN_DIFF}
                 ELSE 9 * least(tx, ty) >= 4 * (nx + ny) AND 9 * ({differ}) <= nx + ny END"""
    small = members.filter(F.col("c") <= short)
    if once:
        earlier = Window.partitionBy("cid").orderBy(F.desc("rest")).rowsBetween(Window.unboundedPreceding, -1)
        small = written(small.withColumn("before", F.collect_list("v").over(earlier)), "near-small")
        one = lambda p: side(small, p, F.col("before").alias(f"b{p}"))
        out = one("x").join(one("y"), "v").filter(
            F.expr(f"CASE WHEN x < y AND {fits} THEN NOT arrays_overlap(bx, by) ELSE false END"))
    else:
        out = side(small, "x").join(side(small, "y"), "v").filter(F.expr(fits + " AND x < y"))
    large = members.filter(F.col("c") > short)
    chosen = written(large.withColumn("h", F.expr(f"pmod(xxhash64(cid, {hubs}), {hubs})"))
                     .groupBy("v", "h").agg(F.min(F.struct("own", "n", "cid", "root", "rest", "most", "g0", "g1")).alias("m"))
                     .select("v", F.col("m.cid").alias("y"), F.col("m.n").alias("ny"),
                             F.col("m.rest").alias("ty"), F.col("m.root").alias("ry"),
                             F.col("m.most").alias("my"), F.col("m.g0").alias("gy"), F.col("m.g1").alias("hy")),
                     "near-hubs")
    out = out.select("x", "y").union(side(large, "x").join(chosen, "v").filter(F.expr(fits)).select("x", "y"))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose union sketch (the k smallest values of both sketches) agrees in enough values."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y, n) in enumerate(zip(batch.column(2), batch.column(3), batch.column(4).to_pylist())):
                both = np.concatenate([unpacked(z.as_buffer(), VALUE_BYTES) for z in (x, y)])
                both.sort()
                new = np.append(True, both[1:] != both[:-1])
                size = int(new.sum())
                if n <= SKETCH:  # whole sets
                    keep[i] = len(both) - size >= 0.8 * size - 1
                else:
                    agree = ~new[1:] & (np.cumsum(new)[1:] <= SKETCH)
                    keep[i] = agree.sum() >= AGREE * min(size, SKETCH) / SKETCH
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = lambda p: classes.select(F.col("cid").alias(p), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"s{p}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sa", "sb", F.greatest("na", "nb").alias("n")) \
        .mapInArrow(run, "a long, b long")


def _full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, blob): the full sets of the wanted classes as packed 6-byte hashes, from one scan of the texts."""
    wanted = written(wanted.join(classes.select("cid", "sid"), "cid").select("sid", "cid"), "near-wanted")
    bits = 1 << FILTER_BITS
    # sid is the digest of a set: the first bytes choose the bit
    spots = (wanted.select(F.expr(f"cast(conv(hex(substring(sid, 1, 3)), 16, 10) AS int) % {bits}").alias("b"))
             .groupBy((F.col("b") / 64).cast("int").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, b % 64)")).alias("m")).toArrow())
    table = np.zeros(bits // 64, np.int64)
    table[spots["w"].to_numpy()] = spots["m"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        filled = shared.value.view(np.uint64)
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(0)):
                ids, blobs = [], []
                for s in shingle_sets(Words(raw, offsets), words):
                    if not len(s):
                        continue
                    sid = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    spot = int.from_bytes(sid[:3], "big") % bits
                    if int(filled[spot // 64]) >> (spot % 64) & 1:
                        ids.append(sid)
                        blobs.append(packed(s, 6))
                if ids:
                    yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())],
                                          names=["sid", "blob"])

    sets = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "sid binary, blob binary")
    # equal sets are combined before the shuffle, so copies of one text move once per task
    return written(sets.groupBy("sid").agg(F.first("blob").alias("blob")).join(wanted, "sid").select("cid", "blob"),
                   "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 80 * union on their full sets."""
    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.unique(unpacked(z.as_buffer(), 6)) for z in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                both = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * both >= 80 * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def one(p):  # only the sets that these pairs need are shuffled
        ids = pairs.select(F.col(p).alias("cid")).distinct()
        return sets.join(ids, "cid", "left_semi").select(F.col("cid").alias(p), F.col("blob").alias(f"set_{p}"))

    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "set_a", "set_b") \
        .mapInArrow(check, "a long, b long")
