"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings, hashed into buckets.  The machine's inputs are the buckets that enough labelled texts
hold to learn something about the pairs they occur in, whether or not they tell anything alone, and rarer ones that
separate the labels by themselves.  It learns a weight for each and a vector whose products weigh every pair of terms
that occur together.  Buckets that neither hold (of a few texts, with no evidence) have nothing to learn from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .textscan import Words, hash_spans, text_slices

TERM_BITS = 20
#: A bucket is an input if so large a share of the labelled rows hold it, or if its own z-score is at least that.
LEAST_SHARE, LEAST_Z = 0.03, 4.0
FACTORS, EPOCHS, BATCH, RATE, DECAY, START = 8, 20, 128, 0.1, 1e-5, 0.02
THRESHOLD = 0.5
PREFIXES = (4, 5)

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of the first 4 and 5 bytes of longer ones."""
    words = Words(raw, offsets, TERM_BYTE[raw])
    rows, buckets = [words.doc], [words.hashes()]
    for n in PREFIXES:
        longer = words.ends - words.starts > n
        s = words.starts[longer]
        rows.append(words.doc[longer])
        buckets.append(hash_spans(words.low, s, s + n) + np.uint64(n))
    mask = np.uint64((1 << TERM_BITS) - 1)
    return np.concatenate(rows), (np.concatenate(buckets) & mask).astype(np.int64)


def _distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows * (1 << TERM_BITS) + values)
    return key >> TERM_BITS, key & ((1 << TERM_BITS) - 1)


def _selected(texts: DataFrame) -> np.ndarray:
    """The buckets that are inputs, by document share or by the z-score of the difference between the classes' shares.

    Their number is bounded by the mean number of terms of a text over ``LEAST_SHARE``, and the few of large z-score.
    """

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            both = np.zeros((2, 1 << TERM_BITS), np.int64)
            for a, _, raw, offsets in text_slices(batch.column(0)):
                rows, values = _distinct(*terms(raw, offsets))
                label = (y[a + rows] > 0).astype(int)
                for c in (0, 1):
                    both[c] += np.bincount(values[label == c], minlength=1 << TERM_BITS)
            hit = np.flatnonzero(both.sum(0))
            yield pa.record_batch([pa.array(hit), pa.array(both[0, hit]), pa.array(both[1, hit])],
                                  names=["b", "neg", "pos"])

    n = texts.agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos, neg = float(n["pos"] or 0), float((n["n"] or 0) - (n["pos"] or 0))
    if not pos or not neg:
        return np.zeros(0, np.int64)
    counts = texts.mapInArrow(run, "b long, neg long, pos long").groupBy("b").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    share = (F.col("pos") + F.col("neg") + 1) / (pos + neg + 2)
    z = F.abs(F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    best = counts.filter((z >= LEAST_Z) | (F.col("pos") + F.col("neg") >= LEAST_SHARE * (pos + neg)))
    return np.array(sorted(r["b"] for r in best.select("b").collect()), np.int64)


def _slots(selected: np.ndarray) -> np.ndarray:
    slot = np.full(1 << TERM_BITS, -1, np.int32)
    slot[selected] = np.arange(len(selected))
    return slot


def _active(slot: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, values = terms(raw, offsets)
    at = slot[values]
    hit = at >= 0
    return _distinct(rows[hit], at[hit].astype(np.int64))


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by ``rows`` (in ascending order), for n rows."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(rows):
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _margin(p: dict, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of n texts, and the vectors of their terms, singly and added up."""
    v = p["v"][at]
    total = _sums(v, rows, n)
    pairs = 0.5 * ((total ** 2).sum(1) - _sums((v ** 2).sum(1), rows, n))
    return p["b"] + _sums(p["w"][at], rows, n) + pairs, v, total


def fit(lists: list[np.ndarray], y: np.ndarray, m: int) -> dict:
    """Weights and vectors of ``m`` inputs by Adagrad on the logistic loss; ``lists`` has the inputs of each text.

    A step touches the inputs of its texts only.
    """
    rng = np.random.Generator(np.random.PCG64(11))
    base = (y.sum() + 1) / (len(y) + 2)
    p = {"b": np.full(1, np.log(base / (1 - base)), np.float32), "w": np.zeros(m, np.float32),
         "v": rng.standard_normal((m, FACTORS), np.float32) * np.float32(START)}
    seen = {k: np.full_like(p[k], 1e-2) for k in p}
    offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    at = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            sizes = offsets[part + 1] - offsets[part]
            ahead = np.cumsum(sizes) - sizes
            here = at[np.arange(int(sizes.sum())) + np.repeat(offsets[part] - ahead, sizes)]
            rows = np.repeat(np.arange(len(part)), sizes)
            f, v, total = _margin(p, rows, here, len(part))
            e = ((1 / (1 + np.exp(-np.clip(f, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            order = np.argsort(here)
            own = here[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            used = own[first]
            for k, g in (("w", e[rows]), ("v", e[rows, None] * (total[rows] - v))):
                if len(used):
                    g = np.add.reduceat(g[order], first, axis=0) + DECAY * p[k][used]
                    seen[k][used] += g ** 2
                    p[k][used] -= RATE * g / np.sqrt(seen[k][used])
            seen["b"] += e.sum() ** 2
            p["b"] -= RATE * e.sum() / np.sqrt(seen["b"])
    return p


def predict(p: dict, slot: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    rows, at = _active(slot, raw, offsets)
    f, _, _ = _margin(p, rows, at, n)
    return 1 / (1 + np.exp(-np.clip(f.astype(float), -30, 30)))


def fit_labelled(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> tuple[dict, np.ndarray]:
    """Learn from at most ``rows`` labelled documents whose crc32 remainder by 5 is not 0."""
    texts = labelled.sample(docs, labels, "toxic", 5, 0, rows)
    selected = _selected(texts)
    shared = docs.sparkSession.sparkContext.broadcast(_slots(selected))

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(0)):
                row, at = _active(shared.value, raw, offsets)
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))),
                                       batch.column(1).slice(a, b - a)], names=["at", "y"])

    got = texts.mapInArrow(run, "at array<int>, y int").toArrow().combine_chunks()
    y = (got["y"].to_numpy() > 0).astype(np.float32)
    found = got["at"].chunk(0) if got["at"].num_chunks else pa.array([], pa.list_(pa.int32()))
    at, ends = found.flatten().to_numpy(), np.append(0, np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False)))
    lists = [at[a:b] for a, b in zip(ends[:-1].astype(int), ends[1:].astype(int))]
    # rows come in any order: theirs is that of their terms
    order = sorted(range(len(y)), key=lambda i: (lists[i].tobytes(), y[i]))
    return fit([lists[i] for i in order], y[order], len(selected)), selected


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Null and empty texts have no terms and get the score of the machine's constant; a null id counts as held out; without
    labelled rows of both classes all scores are the smoothed base rate; an empty table gives no rows.  Labels, lang,
    source and id are no inputs of a score.
    """
    p, selected = fit_labelled(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((p, selected))

    def run(batches):
        p, selected = shared.value
        slot = _slots(selected)
        for batch in batches:
            parts = [predict(p, slot, raw, offsets) for _, _, raw, offsets in text_slices(batch.column(2))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score),
                                   pa.array((score >= THRESHOLD).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", labelled.held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
