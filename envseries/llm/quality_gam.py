"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned text features learns one lookup table per feature, then tables for the
feature pairs that explain most of the rest.  A score is the sum of table entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .textscan import Words, text_slices

BINS, COARSE = 48, 8
ROUNDS, PAIRS, PAIR_ROUNDS = 80, 8, 30
RATE, RIDGE = 0.15, 4.0
THRESHOLD = 0.7

FEATURES = ["log_words", "word_bytes", "upper", "digit", "stop", "comma", "bang", "bar", "symbol", "other_mark", "wide",
            "line_words", "capital_words", "upper_words", "same_as_before", "distinct_words", "top_word", "distinct_lines"]
_GROUPS = {1: "abcdefghijklmnopqrstuvwxyz", 2: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3: "0123456789", 4: ".", 5: ",", 6: "!",
           7: "|", 8: "#$%&*@^~=+_<>{}[]\\/", 9: "'\"`:;?()-", 10: "\n"}
CLASS = np.zeros(256, np.uint8)
for _k, _chars in _GROUPS.items():
    CLASS[[ord(c) for c in _chars]] = _k
CLASS[128:] = 11


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text of a slice; shares of nothing are 0."""
    n = len(offsets) - 1
    words = Words(raw, offsets)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * 16 + CLASS[raw], minlength=n * 16).reshape(n, 16).astype(float)
    size = np.maximum(np.diff(offsets), 1)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    h = words.hashes()
    lens = words.ends - words.starts
    head = CLASS[raw[words.starts]] == 2 if len(words) else np.zeros(0, bool)
    second = CLASS[raw[np.minimum(words.starts + 1, words.ends - 1)]] == 2 if len(words) else np.zeros(0, bool)
    before = np.zeros(len(words), bool)
    before[1:] = h[1:] == h[:-1]
    before[words.first[:-1][words.first[:-1] < len(words)]] = False
    per = lambda x: np.bincount(words.doc, x, minlength=n) / some
    breaks = np.ones(len(raw) + 1, bool)
    breaks[1:] = np.append(raw == 10, True)[:len(raw)]
    breaks[offsets] = True
    line = np.cumsum(breaks)[words.starts] if len(words) else np.zeros(0, int)
    distinct, top, lines = np.zeros(n), np.zeros(n), np.ones(n)
    new = np.flatnonzero(np.diff(line, prepend=-1)) if len(words) else np.zeros(0, int)
    sums = np.add.reduceat(h * (2 * np.arange(len(h), dtype=np.uint64) - 2 * np.repeat(
        new, np.diff(np.append(new, len(h)))).astype(np.uint64) + np.uint64(1)), new) if len(new) else np.zeros(0, np.uint64)
    at = np.searchsorted(new, words.first)
    for i in np.flatnonzero(count):
        s = np.sort(h[words.first[i]:words.first[i + 1]])
        edges = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s))
        distinct[i], top[i] = (len(edges) - 1) / len(s), np.diff(edges).max() / len(s)
        own = sums[at[i]:at[i + 1]]
        lines[i] = len(np.unique(own)) / max(len(own), 1)
    share = kinds / size[:, None]
    return np.column_stack([
        np.log1p(count), np.bincount(words.doc, lens, minlength=n) / some, share[:, 2], share[:, 3], share[:, 4],
        share[:, 5], share[:, 6], share[:, 7], share[:, 8], share[:, 9], share[:, 11], count / (kinds[:, 10] + 1),
        per(head), per(head & second & (lens > 1)), per(before), distinct, top, lines])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton step per bin from a tree that splits the ordered bins into at most ``leaves`` ranges."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    bounds = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = value(a, m) + value(m, b) - value(a, b)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], a + 1 + j)
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    step = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return step


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Tables from features and 0/1 labels; no rows give a constant 0.5."""
    y = y.astype(float)
    base = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(base / (1 - base))), "edges": [], "tables": [], "pairs": []}
    if not len(y):
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(len(y), model["base"])

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(binned):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
            tables[j] += step
            f += step[b]
    coarse = [b * COARSE // (len(e) + 1) for b, e in zip(binned, edges)]
    cells = COARSE * COARSE
    g, h = slopes()
    gains = []
    for i in range(len(edges)):
        for j in range(i):
            c = coarse[i] * COARSE + coarse[j]
            gains.append((float((np.bincount(c, g, cells) ** 2 / (np.bincount(c, h, cells) + RIDGE)).sum()), i, j))
    chosen = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in chosen:
            g, h = slopes()
            c = coarse[i] * COARSE + coarse[j]
            gs, hs = (np.bincount(c, v, cells).reshape(COARSE, COARSE) for v in (g, h))
            cut = _tree(gs.sum(1), hs.sum(1), 2)
            step = np.zeros((COARSE, COARSE))
            for side in (cut == cut[0], cut != cut[0]):  # split on one feature, then each side on the other
                if side.any():
                    step[side] = RATE * _tree(gs[side].sum(0), hs[side].sum(0), 2)
            t += step
            f += step.ravel()[c]
    return model | {"edges": edges, "tables": tables, "pairs": chosen}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    if model["edges"]:
        binned = [np.searchsorted(e, c, side="right") for e, c in zip(model["edges"], x.T)]
        for t, b in zip(model["tables"], binned):
            f += t[b]
        coarse = [b * COARSE // (len(e) + 1) for b, e in zip(binned, model["edges"])]
        for i, j, t in model["pairs"]:
            f += t[coarse[i], coarse[j]]
    return 1 / (1 + np.exp(-f))


def _scores(model: dict, column: pa.Array) -> np.ndarray:
    parts = [predict(model, features(raw, offsets)) for _, _, raw, offsets in text_slices(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def fit_labelled(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> dict:
    """Learn from at most ``rows`` labelled documents whose crc32 remainder by 4 is not 2."""

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(0)):
                x = features(raw, offsets)
                yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(a, b - a)],
                                      names=["x", "y"])

    got = labelled.sample(docs, labels, "quality", 4, 2, rows).mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # rows come in any order: the sums below shall not depend on it
    return fit(x[order], got["y"].to_numpy()[order])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.7).

    Null and empty texts are scored as texts without words; a null id counts as held out; without labelled rows every
    score is 0.5; an empty table gives no rows.  Labels, lang, source and id are no inputs of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels))

    def run(batches):
        for batch in batches:
            score = _scores(model.value, batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score),
                                   pa.array((score >= THRESHOLD).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", labelled.held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit_labelled(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(at)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
