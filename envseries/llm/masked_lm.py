"""LM scoring by masked pseudo-likelihood.

A network sees the two words on either side of a masked one and predicts its class; within a class a word's probability
is its share of the corpus counts.  The log-probabilities of all words, each conditioned on both sides, add up to a
document's score.

Every distinct word has its count in a Spark table, which joins to the words of the texts.  The number of classes follows
the root of the number of distinct words V: the OWN * sqrt(V) commonest words are classes of their own, the others share
TAIL * sqrt(V) classes by their last bytes and their length.  Only tables of the order of sqrt(V) rows are broadcast: what
has a row per class, and the shares of at most COMMON * sqrt(V) common words, so that the rarer ones alone are joined.

Training is one pass over all texts in ROUNDS rounds.  A round deals its texts to lanes by hash; each lane takes numpy
gradient steps from the last average, and the lanes' parameters are averaged.  The number of lanes follows the root of
the number of words, so do the steps of a lane; neither depends on files or partitions.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textscan import Words, mix64, text_slices

OWN, TAIL, COMMON = 4, 2, 128
CONTEXT = (-2, -1, 1, 2)
HIDDEN, BATCH = 16, 32768
#: Step on the sum of a parameter row's gradients, and its bound as a step on their mean.
RATE, MOST = 0.1, 2.0
ROUNDS = 4
#: Batches of a lane over all rounds, for each lane.
LANE_BATCHES = 4
#: Words that go through the layers at once, so that their probabilities stay in a core's cache.
BLOCK = 512
#: Text bytes that are cut into words at once, for the same reason.
TEXT_BYTES = 1 << 16
#: Distinct words are sent on after so many words.
COUNT_WORDS = 1 << 22
#: Rows of parameters that are averaged together.
PIECE = 4096
#: Log count that stands for a class without words.
ABSENT = -30.0


def ending(words: Words, some: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hash of every word's last three bytes and its length up to 15, as a 31-bit number; of ``some`` words only."""
    starts, ends = words.starts[some], words.ends[some]
    size = ends - starts
    out = np.minimum(size, 15).astype(np.uint64)
    for k in range(1, 4):
        byte = words.low[np.maximum(ends - k, starts)].astype(np.uint64)
        out = (out << np.uint64(8)) | np.where(size >= k, byte, 0).astype(np.uint64)
    return (mix64(out) >> np.uint64(33)).astype(np.int64)


class Counts:
    """The table (h, s, n) of all distinct words: hash, hash of the ending, occurrences."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def sum(self) -> int:
        return self.frame.agg(F.sum("n")).first()[0] or 0


def count_words(docs: DataFrame) -> Counts:
    """Occurrences of each word over all texts."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column(0), TEXT_BYTES):
                words = Words(raw, offsets)
                held.append((words.hashes(), ending(words)))
                size += len(words)
                if size >= COUNT_WORDS:
                    yield _tally(held)
                    held, size = [], 0
        if size:
            yield _tally(held)

    return Counts(written(docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, s long, n long")
                          .groupBy("h").agg(F.min("s").alias("s"), F.sum("n").alias("n")), "lm-counts"))


def _tally(held: list) -> pa.RecordBatch:
    """Occurrences of the held words.  One sort of numbers, hash above and position below, brings equal words together; if
    others share the upper bits they may come in several rows, which are added up later."""
    h, s = (np.concatenate(x) for x in zip(*held))
    low = np.uint64((1 << len(h).bit_length()) - 1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    h = h[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return pa.record_batch([pa.array(h[begin].view(np.int64)), pa.array(s[order[begin]]),
                            pa.array(np.diff(np.append(begin, len(h))))], names=["h", "s", "n"])


class Places:
    """Places of hashes in a sorted list without repeats; the upper bits of a hash say where to begin."""

    def __init__(self, known: np.ndarray):
        bits = max(4, (2 * len(known)).bit_length())
        self.shift = np.uint64(64 - bits)
        edges = np.append(np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(known))
        self.begin, self.longest = edges[:-1].astype(np.int32), int(np.diff(edges).max())
        self.known = np.append(known, np.full(max(1, self.longest), np.uint64(2**64 - 1)))
        self.n = len(known)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every hash, and whether the list has it (else the place means nothing)."""
        at = self.begin[(h >> self.shift).astype(np.int64)]
        for _ in range(self.longest - 1):
            at += self.known[at] < h
        return at, (self.known[at] == h) & (at < self.n)


def class_of(words: Words, own: Places, order: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and classes; ``own`` are the hashes of words with a class of their own, sorted, ``order`` their places."""
    h = words.hashes()
    if not own.n:
        return h, np.zeros(len(h), np.int32)
    at, found = own.of(h)
    out = np.empty(len(h), np.int32)
    out[found] = 1 + order[at[found]]
    rest = np.flatnonzero(~found)
    out[rest] = 1 + own.n + ending(words, rest) % tail
    return h, out


class Classes:
    """Class of every word: 0 is the outside of a text, then the ``own`` words by falling count, then the tail."""

    def __init__(self, own: np.ndarray, tail: int, counts: np.ndarray):
        self.order = np.argsort(own).astype(np.int32)
        self.own, self.tail, self.counts = own[self.order], tail, counts

    def __len__(self) -> int:
        return 1 + len(self.own) + self.tail

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        return class_of(words, Places(self.own), self.order, self.tail)


def vocabulary(counts: Counts) -> tuple[Classes, DataFrame]:
    """The classes, and the table (h, n, share) of the tail's words with their log share of their class."""
    frame = counts.frame
    root = sqrt(frame.count())
    best = frame.orderBy(F.desc("n"), "h").limit(ceil(OWN * root)).select("h", "n").toArrow() if root else None
    own = best["h"].to_numpy() if root else np.zeros(0, np.int64)
    tail = max(1, ceil(TAIL * root))
    spark = frame.sparkSession
    known = spark.createDataFrame(pa.table({"h": pa.array(own, pa.int64())}))
    rest = frame.join(F.broadcast(known), "h", "left_anti") \
        .withColumn("cls", (F.col("s") % tail + 1 + len(own)).cast("int"))
    total = rest.groupBy("cls").agg(F.sum("n").alias("total"))
    got = total.toArrow()
    of = np.zeros(1 + len(own) + tail, np.int64)
    if root:
        of[1:1 + len(own)] = best["n"].to_numpy()
    of[got["cls"].to_numpy()] = got["total"].to_numpy()
    totals = spark.createDataFrame(pa.table({"cls": got["cls"].cast(pa.int32()), "total": got["total"]}))
    share = rest.join(F.broadcast(totals), "cls").select("h", "n", F.log(F.col("n") / F.col("total")).alias("share"))
    return Classes(own.view(np.uint64), tail, of), share


def common_words(share: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Sorted hashes and shares of the words that occur oftenest, ``most`` of them or fewer (equal counts stay together),
    and the table of the others."""
    sizes = share.groupBy("n").agg(F.count("*").alias("words")).toArrow().sort_by([("n", "descending")])
    within = int((np.cumsum(sizes["words"].to_numpy()) <= most).sum())
    least = sizes["n"][within - 1].as_py() if within else None
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), share
    got = share.filter(F.col("n") >= least).select("h", "share").toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], got["share"].to_numpy()[order], share.filter(F.col("n") < least)


def initial(classes: int = 64, counts: np.ndarray | None = None) -> dict:
    """Parameters before training; with counts the network starts from the classes' own frequencies.

    Classes lie in groups of about root many: ``u`` and ``a`` say which group, ``w`` and ``b`` which class of it.
    """
    rng = np.random.Generator(np.random.PCG64(5))
    size = ceil(sqrt(classes))
    groups = ceil(classes / size)
    log = np.full(groups * size, ABSENT, np.float32)
    log[:classes] = 0 if counts is None else np.where(counts > 0, np.log(np.maximum(counts, 1)), ABSENT)
    log = log.reshape(groups, size)
    top = log.max(1, keepdims=True)
    group = (top + np.log(np.exp(log - top).sum(1, keepdims=True)))[:, 0]
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {"e": normal(0.3, len(CONTEXT), classes, HIDDEN), "c": np.zeros(HIDDEN, np.float32),
            "u": normal(0.05, HIDDEN, groups), "a": group.astype(np.float32) - group.max(),
            "w": normal(0.05, groups, HIDDEN, size), "b": log - group[:, None]}


def context(cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of the neighbours of every word, 0 beyond the ends of its text."""
    out = np.zeros((len(CONTEXT), len(cls)), np.int32)
    start, end = first[:-1], first[1:]
    for k, o in enumerate(CONTEXT):
        if o < 0:
            out[k, -o:] = cls[:o]
        else:
            out[k, :-o] = cls[o:]
        for j in range(abs(o)):  # the word this near to an end of its text
            at = start + j if o < 0 else end - 1 - j
            out[k, at[(start <= at) & (at < end)]] = 0
    return out


def hidden(p: dict, near: np.ndarray) -> np.ndarray:
    h = p["e"][0].take(near[0], 0)
    for k in range(1, len(CONTEXT)):
        h += p["e"][k].take(near[k], 0)
    h += p["c"]
    return np.tanh(h, out=h)


def exps(z: np.ndarray) -> np.ndarray:
    """Exponentials in place, up to a factor for each column.  A column is one word, so numpy works on many at once."""
    if z.size and z.max() > 60:
        z -= z.max(0)
    return np.exp(z, out=z)


def softmax(z: np.ndarray) -> np.ndarray:
    """Probabilities along the first axis, in place."""
    z = exps(z)
    z /= z.sum(0) + np.float32(1e-30)
    return z


def forward(p: dict, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and the probabilities of all classes."""
    h = hidden(p, near)
    top = softmax(p["u"].T @ h.T + p["a"][:, None])
    within = [softmax(w.T @ h.T + b[:, None]) * top[g] for g, (w, b) in enumerate(zip(p["w"], p["b"]))]
    return h, np.concatenate(within).T


def stable_order(x: np.ndarray) -> np.ndarray:
    """Positions in ascending order of small non-negative numbers; 16 bits are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x, kind="stable")


def by_group(p: dict, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Positions of a batch's words in the order of their groups, then in that order the groups, the places in them and
    (group, begin, end) of each group that occurs."""
    group, at = np.divmod(target, p["b"].shape[1])
    order = stable_order(group)
    group = group[order]
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
    return order, group, at[order], [(int(group[lo]), lo, hi) for lo, hi in zip(edges[:-1], edges[1:])]


def blocks(lo: int, hi: int):
    for a in range(lo, hi, BLOCK):
        yield slice(a, min(a + BLOCK, hi))


def layer(w: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = w.T @ x
    z += b[:, None]
    return z


def target_logs(p: dict, near: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target class."""
    order, group, at, runs = by_group(p, target)
    h = np.ascontiguousarray(hidden(p, near[:, order]).T)
    some = np.empty(len(target), np.float32)

    def part(w, b, which, k):
        z = exps(layer(w, b, h[:, k]))
        return z[which[k], np.arange(z.shape[1])] / (z.sum(0) + np.float32(1e-30))

    for k in blocks(0, len(target)):
        some[k] = part(p["u"], p["a"], group, k)
    for g, lo, hi in runs:
        for k in blocks(lo, hi):
            some[k] *= part(p["w"][g], p["b"][g], at, k)
    out = np.empty_like(some)
    out[order] = np.log(some + np.float32(1e-30))
    return out


def step(p: dict, seen: dict, near: np.ndarray, target: np.ndarray) -> None:
    """One gradient step on the cross-entropy of a batch, in place; ``seen`` counts the words that moved each row."""
    n = len(target)
    order, group, at, runs = by_group(p, target)
    near = near[:, order].astype(np.int64)
    h = np.ascontiguousarray(hidden(p, near).T)
    dh = np.zeros_like(h)

    def descend(w, b, which, lo, hi):
        """Moves a layer by its words ``lo`` to ``hi``, and adds what they pass back to ``dh``."""
        dw, db = np.zeros_like(w), np.zeros_like(b)
        for k in blocks(lo, hi):
            x = h[:, k]
            z = softmax(layer(w, b, x))
            z[which[k], np.arange(z.shape[1])] -= 1
            dh[:, k] += w @ z
            dw += x @ z.T
            db += z.sum(1)
        rate = np.float32(min(RATE, MOST / (hi - lo)))
        w -= rate * dw
        b -= rate * db

    descend(p["u"], p["a"], group, 0, n)
    for g, lo, hi in runs:
        descend(p["w"][g], p["b"][g], at, lo, hi)
        seen["w"][g] += hi - lo
    dh *= 1 - h * h
    p["c"] -= np.float32(min(RATE, MOST / n)) * dh.sum(1)
    classes = p["e"].shape[1]
    for k in range(len(CONTEXT)):
        count = np.bincount(near[k], minlength=classes)
        rate = np.minimum(RATE, MOST / np.maximum(count, 1))
        p["e"][k] -= np.stack([np.bincount(near[k], x, classes) * rate for x in dh], 1).astype(np.float32)
        seen["e"][k] += count


def id_type(cls: Classes) -> type:
    """Numbers that hold every class: two bytes up to some 100 million distinct words, four beyond."""
    return np.uint16 if len(cls) <= 1 << 16 else np.int32


def encoded(docs: DataFrame, cls: Classes, common: tuple = (np.zeros(0, np.uint64), np.zeros(0))) -> DataFrame:
    """One row per input row: rid, doc_id, key, ids (its words' classes), tail and times (hashes of its words that share a
    class, and how often each occurs), and known, the sum of the shares of its ``common`` words (sorted hashes and
    shares), which are left out of tail."""
    kind = id_type(cls)
    # arrays: executors know no class
    shared = docs.sparkSession.sparkContext.broadcast((cls.own, cls.order, cls.tail, *common))

    def run(batches):
        own, order, tail, often, share = shared.value
        own, often = Places(own), Places(often)
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(2), TEXT_BYTES):
                words = Words(raw, offsets)
                h, c = class_of(words, own, order, tail)
                rare = c > own.n
                place, found = often.of(h[rare])
                known = np.bincount(words.doc[rare][found], share[place[found]], b - a).astype(float)
                rare[rare] = ~found
                at = np.append(0, np.cumsum(rare))[words.first]
                h = h[rare].view(np.int64)
                each = [np.unique(h[x:y], return_counts=True) for x, y in zip(at[:-1], at[1:])]
                ends = np.append(0, np.cumsum([len(x) for x, _ in each])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
                         for x in ([x for x, _ in each], [n for _, n in each])]
                begins = (words.first * kind().itemsize).astype(np.int64)
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(begins), pa.py_buffer(c.astype(kind))])
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                                       data.cast(pa.binary()), *lists, pa.array(known)],
                                      names=["doc_id", "key", "ids", "tail", "times", "known"])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), text).alias("key"), text.alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(
        run, f"doc_id {id_kind}, key long, ids binary, tail array<long>, times array<long>, known double")
                   .withColumn("rid", F.monotonically_increasing_id()), "lm-words")


def _sequences(column: pa.Array, kind: type):
    """Classes and first words of binary rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    c = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].copy().view(kind) if data is not None else \
        np.zeros(0, kind)
    return c.astype(np.int32), (offsets - offsets[0]) // kind().itemsize


def _weighted(p: dict, seen: dict, words: int):
    """(name, piece, weights, values) of a lane's parameters; rows that no word moved weigh next to nothing."""
    rows = {"e": (p["e"].reshape(-1, HIDDEN), seen["e"].ravel()), "w": (p["w"].reshape(len(p["w"]), -1), seen["w"]),
            "b": (p["b"], seen["w"])}
    rows |= {k: (p[k].reshape(1, -1), np.array([words])) for k in "uac"}
    for k, (values, weight) in rows.items():
        for a in range(0, len(values), PIECE):
            yield k, a // PIECE, (weight[a:a + PIECE] + 1e-6).astype(np.float64), values[a:a + PIECE]


def fit(rows: DataFrame, cls: Classes) -> dict:
    """One pass over the encoded texts, in rounds that start from the last average."""
    p = initial(len(cls), cls.counts)
    words = int(cls.counts.sum())
    lanes = max(1, round(sqrt(words / BATCH / LANE_BATCHES)))
    kind = id_type(cls)
    spark = rows.sparkSession
    dealt = F.pmod(F.xxhash64("key"), F.lit(ROUNDS * lanes))
    lane_size = words / lanes / ROUNDS
    rows = rows.filter(F.length("ids") > 0).select((dealt % lanes).cast("int").alias("lane"),
                                                   F.floor(dealt / lanes).alias("round"), "key", "ids")
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(p)

        def run(batches):
            lane, p, seen, n = None, None, None, 0

            def done():
                for name, piece, weight, values in _weighted(p, seen, n):
                    yield pa.record_batch([pa.array([name]), pa.array([piece], pa.int32()), pa.array([weight.tobytes()]),
                                           pa.array([values.tobytes()])], names=["name", "piece", "weight", "value"])

            for batch in batches:
                of = batch.column(0).to_numpy()
                edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
                for lo, hi in zip(edges[:-1], edges[1:]):
                    if of[lo] != lane:
                        if lane is not None:
                            yield from done()
                        lane, n = of[lo], 0
                        p = {k: v.copy() for k, v in shared.value.items()}
                        seen = {"e": np.zeros(p["e"].shape[:2], np.int64), "w": np.zeros(len(p["w"]), np.int64)}
                    c, first = _sequences(batch.column(1).slice(lo, hi - lo), kind)
                    near = context(c, first)
                    for a in range(0, len(c), BATCH):
                        step(p, seen, near[:, a:a + BATCH], c[a:a + BATCH])
                    n += len(c)
            if lane is not None:
                yield from done()

        def mean(pieces: pa.Table) -> pa.Table:
            # in a fixed order, so that the sum is the same in every run
            total, weight = 0, 0
            for w, v in sorted(zip(pieces["weight"].to_pylist(), pieces["value"].to_pylist())):
                w = np.frombuffer(w)
                total = total + np.frombuffer(v, np.float32).reshape(len(w), -1).astype(np.float64) * w[:, None]
                weight = weight + w
            return pa.table({"name": pieces["name"][:1], "piece": pieces["piece"][:1],
                             "value": pa.array([(total / weight[:, None]).astype(np.float32).tobytes()])})

        trained = rows.filter(F.col("round") == k).select("lane", "key", "ids").repartition(lanes, "lane") \
            .sortWithinPartitions("lane", "key", "ids").select("lane", "ids") \
            .mapInArrow(run, "name string, piece int, weight binary, value binary")
        got = written(written(trained, "lm-lanes").groupBy("name", "piece").applyInArrow(
            mean, "name string, piece int, value binary"), "lm-average").orderBy("name", "piece").toArrow()
        for name in set(got["name"].to_pylist()):
            parts = [v for x, v in zip(got["name"].to_pylist(), got["value"].to_pylist()) if x == name]
            p[name] = np.frombuffer(b"".join(parts), np.float32).reshape(p[name].shape)
        shared.unpersist()
    return p


def train(docs: DataFrame, cls: Classes) -> dict:
    return fit(encoded(docs, cls), cls)


def log_probabilities(p: dict, cls: Classes, share: DataFrame, raw: np.ndarray, offsets: np.ndarray):
    """Log-probability of every word of a slice given both sides, and where each text's words begin; reads the shares
    of the slice's words from the table.  Parameters of another number of classes count as untrained."""
    p = p if p["e"].shape[1] == len(cls) else initial(len(cls))
    words = Words(raw, offsets)
    h, c = cls.of(words)
    out = target_logs(p, context(c, words.first), c).astype(np.float64)
    known = share.sparkSession.createDataFrame(pa.table({"h": pa.array(np.unique(h).view(np.int64))}))
    log = {r["h"]: r["share"] for r in share.join(known, "h").collect()}
    return out + np.array([log.get(x, 0.0) for x in h.view(np.int64).tolist()]), words.first


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, log_likelihood (sum over words), mean_log_prob, perplexity.

    Null and blank texts have no words: sum 0, mean 0, perplexity 1.  Rows that repeat count and are scored each; an
    empty table gives no rows.  Other columns are ignored.
    """
    cls, share = vocabulary(count_words(docs))
    often, logs, share = common_words(share, COMMON * len(cls.own) // OWN)
    rows = encoded(docs, cls, (often, logs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, cls))
    kind = id_type(cls)

    def run(batches):
        p = shared.value
        for batch in batches:
            c, first = _sequences(batch.column(2), kind)
            near = context(c, first)
            lp = np.zeros(len(c))
            for a in range(0, len(c), BATCH):
                lp[a:a + BATCH] = target_logs(p, near[:, a:a + BATCH], c[a:a + BATCH])
            n = np.diff(first)
            total = np.bincount(np.repeat(np.arange(len(n)), n), lp, minlength=len(n)).astype(float)
            total += batch.column(3).to_numpy()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), pa.array(total)],
                                  names=["rid", "doc_id", "n_words", "sum"])

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("rid", "doc_id", "ids", "known").mapInArrow(
        run, f"rid long, doc_id {id_kind}, n_words long, sum double")
    tail = rows.select("rid", F.explode(F.arrays_zip(F.col("tail").alias("h"), F.col("times").alias("n"))).alias("t")) \
        .select("rid", "t.h", "t.n").join(share.select("h", "share"), "h").groupBy("rid").agg(F.sum(F.col("share") * F.col("n")).alias("share"))
    total = F.col("sum") + F.coalesce("share", F.lit(0.0))
    mean = F.col("log_likelihood") / F.greatest("n_words", F.lit(1))
    return written(scored.join(written(tail, "lm-shares"), "rid", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood")), "lm-scores") \
        .withColumn("mean_log_prob", mean).withColumn("perplexity", F.exp(-F.col("mean_log_prob")))
