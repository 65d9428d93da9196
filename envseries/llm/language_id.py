"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Byte trigrams of words, counted per language over all documents that may be learned from, score every word.  Scripts
(ranges of the first letter) leave only the languages seen in that script.  A Viterbi pass with a switching penalty
then labels each word, so texts of mixed languages fall into spans; the document's language covers most letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .textscan import LOWER, text_slices

GRAM_BITS = 16
SCRIPTS, SCRIPT_SHARE = 16, 1e-3
#: Log-probability lost at each change of language; a word's own score is held above FLOOR.
SWITCH, FLOOR = 6.0, -8.0
GROUP_BYTES = 6 << 20
#: Languages are a column of the model's tables, so their number has to be bounded.
MOST_LANGUAGES = 1024

CLEAN = np.full(256, 32, np.uint8)
CLEAN[[*range(65, 91), *range(97, 123)]] = LOWER[[*range(65, 91), *range(97, 123)]]
CLEAN[128:] = np.arange(128, 256)
#: Script by the first byte of a letter's UTF-8 form: Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic, South and
#: South-East Asian, Georgian to general punctuation, kana and Han, Hangul and late Han, others.
SCRIPT = np.zeros(256, np.uint8)
for _lo, _hi, _script in ((0xCD, 0xCF, 1), (0xD0, 0xD4, 2), (0xD5, 0xD7, 3), (0xD8, 0xDF, 4), (0xE0, 0xE0, 5),
                          (0xE1, 0xE2, 6), (0xE3, 0xE9, 7), (0xEA, 0xED, 8), (0xEE, 0xFF, 9)):
    SCRIPT[_lo:_hi + 1] = _script


class Letters:
    """Letter runs of a slice: per letter byte its trigram, per run its start, document and script."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        clean = CLEAN[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before, after = (np.full(len(raw), 32, np.uint8) for _ in range(2))
        before[1:], after[:-1] = clean[:-1], clean[1:]
        before[edge[:-1]] = 32
        after[edge[1:]] = 32
        at = np.flatnonzero(clean != 32)
        wide = (before[at].astype(np.uint32) << 16) | (clean[at].astype(np.uint32) << 8) | after[at]
        self.grams = ((wide * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
        self.first = np.flatnonzero(before[at] == 32)  # of each run, among the letter bytes
        starts = at[self.first]
        self.lens = np.diff(np.append(self.first, len(at)))
        self.script = SCRIPT[raw[starts]]
        self.word = np.searchsorted(starts, offsets)  # first run of each document
        self.starts = starts
        self.ascii = np.bincount(np.searchsorted(offsets, at[clean[at] < 128], "right") - 1,
                                 minlength=len(offsets) - 1)[:len(offsets) - 1]


def languages(docs: DataFrame) -> list[str]:
    found = docs.filter(F.col("lang").isNotNull() & ~labelled.held_out("doc_id", 4, 2)).select("lang").distinct()
    names = sorted(r[0] for r in found.limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return names


def fit(docs: DataFrame, names: list[str]) -> dict:
    """Log-probabilities of trigrams per language, and the languages of each script, from all documents whose crc32
    remainder by 4 is not 2 and that have a language."""
    size = (1 << GRAM_BITS) + SCRIPTS
    code = F.array_position(F.lit(names), F.col("lang")).cast("int") - 1
    rows = docs.filter(F.col("lang").isNotNull() & ~labelled.held_out("doc_id", 4, 2)) \
        .select(code.alias("c"), F.col("text").cast("string").alias("text"))

    def run(batches):
        total = np.zeros(len(names) * size, np.int64)
        for batch in batches:
            c = batch.column(0).to_numpy()
            for a, b, raw, offsets in text_slices(batch.column(1)):
                x = Letters(raw, offsets)
                of_run = np.repeat(c[a:b], np.diff(x.word)).astype(np.int64) * size
                key = np.concatenate([np.repeat(of_run, x.lens) + x.grams, of_run + (1 << GRAM_BITS) + x.script])
                hit = np.bincount(key)
                total[:len(hit)] += hit
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["k", "n"])

    got = rows.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * size)
    counts[got["k"].to_numpy()] = got["n"].to_numpy()
    counts = counts.reshape(len(names), size)
    grams, scripts = counts[:, :1 << GRAM_BITS] + 0.5, counts[:, 1 << GRAM_BITS:]
    table = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    allowed &= scripts > 0
    return {"names": names, "table": np.ascontiguousarray(table), "allowed": allowed.T}


def word_scores(model: dict, x: Letters) -> np.ndarray:
    """Log-posterior of each candidate language per word, not below FLOOR; languages of other scripts get FLOOR."""
    s = np.add.reduceat(model["table"][x.grams], x.first, axis=0).astype(np.float64)
    allowed = model["allowed"][x.script]
    allowed[~allowed.any(1)] = True  # a script that was never seen excludes no language
    s[~allowed] = -1e9
    s -= s.max(1, keepdims=True)
    s -= np.log(np.exp(s).sum(1, keepdims=True))
    return np.maximum(s, FLOOR)


def viterbi(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label of every word; documents are the stretches between ``first``; all documents advance together."""
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    lens, start = lens[order], first[:-1][order]
    label = np.zeros(len(score), np.int16)
    if not len(score):
        return label
    longest = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(longest), side="left")  # documents longer than t
    stay, best = np.zeros(score.shape, bool), np.zeros(len(score), np.int16)
    end = np.zeros(len(lens), np.int16)
    v = score[start[:active[0]]].copy()
    for t in range(1, longest):
        n = active[t]
        if n < len(v):
            end[n:len(v)] = v[n:].argmax(1)
            v = v[:n]
        at = start[:n] + t
        top = v.argmax(1)
        change = v[np.arange(n), top] - SWITCH
        keep = v >= change[:, None]
        stay[at], best[at] = keep, top
        v = np.where(keep, v, change[:, None]) + score[at]
    end[:len(v)] = v.argmax(1)
    state = np.zeros(len(lens), np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        later = active[t + 1] if t + 1 < longest else 0
        state[later:n] = end[later:n]
        at = start[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], best[at])
    return label


def _predicted(model: dict, column: pa.Array) -> dict[str, list]:
    names, out = model["names"], {"lang_pred": [], "score": [], "spans": []}
    column = column.cast(pa.large_string()).fill_null("")
    for a, b, raw, offsets in text_slices(column, GROUP_BYTES):
        parts = [(Letters(r, o), o[0]) for _, _, r, o in text_slices(column.slice(a, b - a))]
        score = np.concatenate([word_scores(model, x) if len(x.first) else np.zeros((0, len(names))) for x, _ in parts]) \
            if names else np.zeros((0, 0))
        lens = np.concatenate([x.lens for x, _ in parts])
        count = np.concatenate([np.diff(x.word) for x, _ in parts])
        plain = np.concatenate([x.ascii for x, _ in parts])
        first = np.append(0, np.cumsum(count))
        label = viterbi(score, first) if names else np.zeros(0, np.int16)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if not names or lo == hi or not (plain[i] or any(ch.isalpha() for ch in column[a + i].as_py())):
                out["lang_pred"].append("und")
                out["score"].append(0.0)
                out["spans"].append([])
                continue
            own, n = label[lo:hi], lens[lo:hi]
            share = np.bincount(own, n, minlength=len(names))
            top = int(share.argmax())
            cut = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
            out["lang_pred"].append(names[top])
            out["score"].append(float(share[top] / share.sum()))
            out["spans"].append([{"lang": names[own[x]], "first_word": int(x), "words": int(y - x)}
                                 for x, y in zip(cut[:-1], cut[1:])])
    return out


def language_spans(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (share of letters in that language), spans.

    Spans count runs of letters.  Null texts and those without letters are ``und`` with score 0 and no spans, as is
    everything if no document may be learned from; a null id counts as held out; an empty table gives no rows.
    """
    names = languages(docs)
    model = docs.sparkSession.sparkContext.broadcast(
        fit(docs, names) if names else {"names": [], "table": None, "allowed": None})

    def run(batches):
        for batch in batches:
            got = _predicted(model.value, batch.column(2))
            spans = pa.array(got["spans"], pa.list_(pa.struct(
                [("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())])))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got["lang_pred"], pa.string()),
                                   pa.array(got["score"], pa.float64()), spans],
                                  names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = docs.select("doc_id", labelled.held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, "
                                "spans array<struct<lang:string,first_word:int,words:int>>")
