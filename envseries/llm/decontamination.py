"""Benchmark decontamination by template windows.

Texts are canonicalised: numbers, units after numbers and names (capitalised words inside a sentence) become typed
placeholders, other words are lower-cased without punctuation.  Five-word windows of these templates are joined by hash
with those of the benchmark; a second set of windows keeps names as words, so a copy in other letter case is found as
well.  Windows of numbers and units alone match by their values, so a copied number series or table counts in full.
Where a window with placeholders matched, its slots must be filled consistently: one value of the benchmark item
may stand for one value of the document only.  So a question with new numbers or names is caught, a chance match isn't.

Only documents with a window that passes a bit table of fixed size (built from all benchmark windows) reach the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import few, written
from .textscan import Words, hash_spans, mix64, ngram_hashes, text_slices

WINDOW = 5
#: Least share of an item's windows that a document must hold.
COVERAGE = 0.5
FILTER_BITS = 24

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT, UPPER, STOP = (np.zeros(256, bool) for _ in range(3))
DIGIT[48:58] = True
UPPER[65:91] = True
STOP[[ord(c) for c in ".!?:\n"]] = True
#: Names of units.
UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s ms min h hr hrs kb mb gb tb hz khz mhz ghz v kv w kw j kj "
         "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres "
         "kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces "
         "liter liters litre litres dollar dollars cent cents euro euros percent degree degrees")
NUMBER, UNIT, NAME = (np.uint64(x) for x in (11, 12, 13))
#: Forms of a window: names replaced, names kept, and the words as they are for windows that are slots alone.
FULL, PLAIN, VERBATIM = 1, 2, 3


def _hash_words(names: str) -> np.ndarray:
    raw = np.frombuffer(names.encode(), np.uint8)
    return np.sort(Words(raw, np.array([0, len(raw)])).hashes())


UNIT_HASHES = _hash_words(UNITS)


class Templates:
    """Words of a slice as typed templates: ``full`` (numbers, units and names replaced), ``plain`` (names kept),
    ``kind`` (0 for a word, else its type), ``value`` (hash of what a slot held)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        w = Words(raw, offsets, WORD_BYTE[raw])
        self.first, n = w.first, len(w)
        self.value = hash_spans(w.low, w.starts, w.ends)
        digits = np.append(0, np.cumsum(DIGIT[raw]))
        number = digits[w.ends] > digits[w.starts]
        leads = np.zeros(n, bool)
        leads[self.first[:-1][self.first[:-1] < n]] = True
        after = np.roll(number, 1) & ~leads
        unit = after & ~number & (UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, self.value), len(UNIT_HASHES) - 1)]
                                  == self.value)
        stops = np.append(0, np.cumsum(STOP[raw]))
        begins = leads.copy()
        begins[1:] |= stops[w.starts[1:]] > stops[w.ends[:-1]]
        upper = UPPER[raw[w.starts]] if n else np.zeros(0, bool)
        lower = ~UPPER[raw[np.minimum(w.starts + 1, w.ends - 1)]] if n else np.zeros(0, bool)
        name = upper & lower & ~begins & ~number & ~unit
        self.kind = np.select([number, unit, name], [1, 2, 3], 0).astype(np.int8)
        self.plain = np.where(number, NUMBER, np.where(unit, UNIT, self.value))
        self.full = np.where(name, NAME, self.plain)

    def windows(self):
        """(document, word position, hash, form) of every window; shorter texts are one window."""
        for form, tag in ((self.full, FULL), (self.plain, PLAIN), (self.value, VERBATIM)):
            grams = ngram_hashes(form, WINDOW)
            n = np.diff(self.first)
            long = np.flatnonzero(n >= WINDOW)
            at = [np.arange(self.first[i], self.first[i + 1] - WINDOW + 1) for i in long]
            pos = np.concatenate(at) if at else np.zeros(0, np.int64)
            doc = np.repeat(long, n[long] - WINDOW + 1)
            yield doc, pos - self.first[doc], mix64(grams[pos] + np.uint64(tag)), tag
            short = np.flatnonzero((n > 0) & (n < WINDOW))
            if len(short):
                h = np.array([mix64(ngram_hashes(form[self.first[i]:self.first[i + 1]], int(n[i])) + np.uint64(tag))[0]
                              for i in short], np.uint64)
                yield short, np.zeros(len(short), np.int64), h, tag


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


_SCHEMA = "key {}, h long, pos int, tag int, windows int, kinds array<int>, slots array<long>"


def _windows(frame: DataFrame, shared=None) -> DataFrame:
    """(key, h, pos, tag, windows, kinds, slots) of the texts' windows; with ``shared`` only of those it lets pass."""

    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                t = Templates(raw, offsets)
                count = np.diff(t.first)
                words = {FULL: np.append(0, np.cumsum(t.kind == 0)),
                         PLAIN: np.append(0, np.cumsum((t.kind == 0) | (t.kind == 3)))}
                for doc, pos, h, tag in t.windows():
                    # Slots alone are evidence by their values, not as a template.  Whether a window's first word is a
                    # unit depends on the word before, so it is left out of account.
                    lo, hi = t.first[doc] + pos, np.minimum(t.first[doc] + pos + WINDOW, t.first[doc + 1])
                    take = words[PLAIN][hi] == words[PLAIN][lo + 1] if tag == VERBATIM else words[tag][hi] > words[tag][lo]
                    doc, pos, h = doc[take], pos[take], h[take]
                    if shared is not None:
                        spot = _bits(h)
                        hit = (shared.value[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
                        doc, pos, h = doc[hit], pos[hit], h[hit]
                    if not len(h):
                        continue
                    masked = (t.kind > 0) & (tag == FULL) | ((t.kind == 1) | (t.kind == 2)) & (tag == PLAIN)
                    kinds, slots = [], []
                    for d, p in zip(doc.tolist(), pos.tolist()):
                        lo = t.first[d] + p
                        hi = min(lo + WINDOW, t.first[d + 1])
                        kinds.append(np.where(masked[lo:hi], t.kind[lo:hi], 0).astype(np.int32))
                        slots.append(t.value[lo:hi].view(np.int64))
                    yield pa.record_batch([
                        batch.column(0).take(pa.array(a + doc)), pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32)),
                        pa.array(np.full(len(h), tag, np.int32)),
                        pa.array(np.maximum(count[doc] - WINDOW + 1, 1).astype(np.int32)),
                        pa.array(kinds, pa.list_(pa.int32())), pa.array(slots, pa.list_(pa.int64()))],
                        names=["key", "h", "pos", "tag", "windows", "kinds", "slots"])

    kind = frame.schema["key"].dataType.simpleString()
    return frame.select("key", "text").mapInArrow(run, _SCHEMA.format(kind))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, windows, matched, coverage, conflicts) of texts that hold at least half of an item's windows.

    ``docs`` has key and text.  A window all of whose words are numbers and units is evidence where these are the same;
    windows whose slots contradict the item's most frequent reading in that text are not counted.  Items of fewer than five words are one window and
    match texts of just those words.  Null and empty texts hold and leak nothing.
    """
    bench = written(_windows(benchmark.select(F.col("item_id").alias("key"), F.col("text").cast("string").alias("text"))),
                    "leak-items")
    spots = bench.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("s")) \
        .groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("m")) \
        .toArrow()
    table = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    table[spots["w"].to_numpy()] = spots["m"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))
    found = written(_windows(docs, shared).drop("windows"), "leak-windows")

    items = bench.select(F.col("key").alias("item_id"), "h", F.col("pos").alias("item_pos"), "windows",
                         F.col("kinds").alias("k"), F.col("slots").alias("s"))
    same = written(found.join(items, "h").filter(F.col("k") == F.col("kinds"))
                   .select("key", "item_id", "windows", "item_pos", "pos", "k", "s", "slots"), "leak-matches")
    # what each slot value of the item stands for: its most frequent partner in the document
    pairs = same.select("key", "item_id", "item_pos", "pos", F.explode(F.arrays_zip("k", "s", "slots")).alias("z")) \
        .filter("z.k > 0").select("key", "item_id", "item_pos", "pos", F.col("z.s").alias("s"), F.col("z.slots").alias("d"))
    votes = pairs.groupBy("key", "item_id", "s", "d").agg(F.count(F.lit(1)).alias("n"))
    reading = votes.groupBy("key", "item_id", "s").agg(F.max(F.struct("n", "d")).alias("m")) \
        .select("key", "item_id", "s", F.col("m.d").alias("meant"))
    wrong = pairs.join(reading, ["key", "item_id", "s"]).filter("d <> meant") \
        .select("key", "item_id", "item_pos", "pos").distinct()
    good = same.join(wrong, ["key", "item_id", "item_pos", "pos"], "left_anti")
    held = good.groupBy("key", "item_id", "item_pos").agg(F.max("windows").alias("windows")) \
        .groupBy("key", "item_id").agg(F.max("windows").alias("windows"), F.count(F.lit(1)).alias("matched"))
    conflicts = wrong.groupBy("key", "item_id").agg(F.count(F.lit(1)).alias("conflicts"))
    share = F.col("matched") / F.col("windows")
    return held.withColumn("coverage", share).filter(F.col("coverage") >= COVERAGE) \
        .join(conflicts, ["key", "item_id"], "left").select(
            "key", "item_id", "windows", "matched", "coverage", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key"),
                       F.col("text").cast("string").alias("text"))


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document row and item: doc_id, item_id, windows, matched, coverage, conflicts,
    contaminated (true).  Rows that repeat a text are listed each; a null id is listed as null."""
    found = written(leaks(_keyed(docs), benchmark), "leak-pairs")
    rows = docs.select("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key"))
    return rows.join(found, "key").select("doc_id", "item_id", "windows", "matched", "coverage", "conflicts",
                                          F.lit(True).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, with all their columns."""
    name = "_leak_key"
    while name in docs.columns:
        name += "_"
    found = written(leaks(_keyed(docs), benchmark).select(F.col("key").alias(name)).distinct(), "leak-keys")
    key = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    # texts are not exchanged for a few keys
    return docs.withColumn(name, key).join(few(found, 200_000), name, "left_anti").select(*docs.columns)
