"""Phrase collocations per language, estimated from sorted count streams.

Counts of all phrases of one length are a stream.  In prefix order a stream runs in lockstep with that of the next
shorter length (a sort-merge join on all words but the last) and takes over the counts of all its first parts; in
suffix order (all words but the first) those of all its rests.  The same two merges show each shorter phrase its one-word
extensions.  No table of counts is held in memory.

Only phrases counted often enough matter, and a phrase cannot occur more often than its parts.  So lengths are counted
one after the other, and a phrase goes to the shuffle only if its parts pass a bit filter of the frequent shorter
phrases.  The filter may let rare phrases pass, which their exact counts then remove; results never depend on it.

Edge cases: null texts, empty ones and pieces without words give nothing; a null language is ``und`` and shares counts
with a language of that name.  Repeated rows count each time, ids are not used, other columns are ignored.  An empty
table gives an empty result.  Ties in score go by count, then by phrase in byte order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written
from .textscan import LOWER, Words, distinct, hash_spans, mix64, text_slices

LEAST, LONGEST, TOP = 100, 5, 2000

#: Bits of the filter for each frequent phrase, and the largest filter (128 MB).  Beyond 2**26 frequent phrases of one
#: length it lets more rare ones pass; that costs shuffle, not results.
BITS_EACH, LARGEST_BITS = 16, 1 << 30
CHUNK_BITS = 1 << 16
SLICE = 1 << 21
#: Rows of the salt that lets many tasks choose the best phrases of one language.
SALT = 64

#: Bytes that end a piece, and those that end a word within a piece.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD = ~BREAKS
WORD[[32, 9]] = False

_OTHER = np.random.Generator(np.random.PCG64(13)).permutation(256).astype(np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "lang string, phrase string, size int, n long"


class Scan:
    """The words of one slice: lower-cased and joined by single spaces in ``data``, with 128-bit names per language."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: Sequence[str]):
        words = Words(raw, offsets, WORD[raw])
        self.doc = words.doc
        # both terms never fall, so the sum is the same only within one piece of one text
        self.piece = np.cumsum(BREAKS[raw])[words.starts] + words.doc if len(words) else words.doc
        lens = words.ends - words.starts
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens
        self.data = np.full(int(self.ends[-1]) + 1 if len(words) else 0, 32, np.uint8)
        self.data[spread(self.starts, lens)] = LOWER[raw[spread(words.starts, lens)]]
        seeds = {x: np.frombuffer(hashlib.blake2b(x.encode(), digest_size=16).digest(), np.uint64) for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], np.uint64).reshape(-1, 2)[words.doc]
        self.names = [mix64(hash_spans(data, self.starts, self.ends) ^ seed[:, lane])
                      for lane, data in enumerate((self.data, _OTHER[self.data]))]

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, size: int, names: list[np.ndarray] | None = None, have: int = 1) -> list[np.ndarray]:
        """Names of all runs of ``size`` words, from those of ``have`` words; callers drop what crosses a piece."""
        names = names or self.names
        for _ in range(have, size):
            names = [mix64(x[:-1] * _STEP + x[1:]) for x in names]
        return names

    def whole(self, size: int) -> np.ndarray:
        """Whether the run of ``size`` words that starts here lies in one piece."""
        n = max(len(self) - size + 1, 0)
        return self.piece[:n] == self.piece[len(self) - n:]

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The text of the runs of ``size`` words that start at ``at``."""
        starts, lens = self.starts[at], self.ends[at + size - 1] - self.starts[at]
        offsets = np.zeros(len(at) + 1, np.int32)
        np.cumsum(lens, out=offsets[1:])
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets),
                                                            pa.py_buffer(self.data[spread(starts, lens)])])


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    ahead = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) + np.repeat(starts - ahead, lens)


def scans(batch: pa.RecordBatch, column: str) -> Iterator[tuple[Scan, list[str]]]:
    langs = batch.column("lang").to_pylist()
    for a, b, raw, offsets in text_slices(batch.column(column), SLICE):
        yield Scan(raw, offsets, langs[a:b]), langs[a:b]


def passes(bits: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
    mask = np.uint64(len(bits) * 8 - 1)
    at = [(x & mask).astype(np.int64) for x in names]
    return reduce(np.logical_and, ((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1 for x in at))


def counted(docs: DataFrame, sizes: Sequence[int], bits=None) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of ``sizes`` words; ``bits`` broadcasts a filter for sizes[0] - 1 words."""
    have = sizes[0] - 1

    def partial(batches):
        for batch in batches:
            for scan, langs in scans(batch, "text"):
                names = scan.grams(have) if have else None
                frequent = scan.whole(have) & passes(bits.value, names) if have else None
                for size in sizes:
                    if len(scan) < size:
                        continue
                    keep = scan.whole(size)
                    for j in range(size - have + 1 if have else 0):
                        keep = keep & frequent[j:j + len(keep)]
                    at = np.flatnonzero(keep)
                    first, second = (x[at] for x in scan.grams(size, names, have or 1))
                    order = np.argsort(first)
                    first, second = first[order], second[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                    edges = np.flatnonzero(new)
                    at = at[order[edges]]
                    rows = scan.doc[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(langs, pa.string()).take(pa.array(rows)), scan.phrases(at, size),
                         pa.array(np.full(len(at), size, np.int32)),
                         pa.array(np.diff(np.append(edges, len(new))))], ["lang", "phrase", "size", "n"])

    return docs.mapInArrow(partial, COUNTS).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def bit_filter(frequent: DataFrame, size: int) -> np.ndarray:
    """A bit table in which both lanes of the name of every phrase of ``frequent`` (lang, phrase) are set."""
    want = max(BITS_EACH * frequent.count(), CHUNK_BITS)
    n_bits = min(1 << math.ceil(math.log2(want)), LARGEST_BITS)
    mask = np.uint64(n_bits - 1)

    def positions(batches):
        for batch in batches:
            for scan, _ in scans(batch, "phrase"):
                names = scan.grams(size)
                at = np.flatnonzero(scan.whole(size))
                found = distinct(np.concatenate([x[at] & mask for x in names])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found // CHUNK_BITS), pa.array(found % CHUNK_BITS)],
                                                 ["chunk", "at"])

    def packed(key, part):
        flags = np.zeros(CHUNK_BITS, np.uint8)
        flags[part.column("at").to_numpy()] = 1
        return pa.table({"chunk": [key[0].as_py()], "bits": [np.packbits(flags, bitorder="little").tobytes()]},
                        schema=pa.schema([("chunk", pa.int64()), ("bits", pa.binary())]))

    rows = (frequent.select("lang", "phrase").mapInArrow(positions, "chunk long, at long").distinct()
            .groupBy("chunk").applyInArrow(packed, "chunk long, bits binary").collect())
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in rows:
        bits[r.chunk * CHUNK_BITS // 8:(r.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def streams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(lang, n) of all words, and by phrase length (lang, phrase, n) of the phrases that occur ``least`` times."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = written(counted(docs, [1]), "phrase-words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    frequent = {1: written(words.filter(F.col("n") >= least).select("lang", "phrase", "n"), "phrase-counts")}
    dropped(words)
    # lengths 2 and 3 alone, as they thin out the texts most; what is left is counted in one more scan
    for sizes in [s for s in ([2], [3], list(range(4, longest + 1))) if s and s[-1] <= longest]:
        if frequent[sizes[0] - 1].isEmpty():
            break
        bits = docs.sparkSession.sparkContext.broadcast(bit_filter(frequent[sizes[0] - 1], sizes[0] - 1))
        both = written(counted(docs, sizes, bits).filter(F.col("n") >= least), "phrase-counts")
        bits.unpersist()
        for size in sizes:
            frequent[size] = both.filter(F.col("size") == size).select("lang", "phrase", "n")
    return totals, frequent


def merged(frequent: dict[int, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Candidates (lang, phrase, a, firsts, rests), and (lang, phrase) of those a longer one covers.

    ``firsts[k - 1]`` is the count of the first k words, ``rests[k - 1]`` that of the others.  Only one-word
    extensions are looked at: if a longer phrase is as frequent as one inside it, so are all phrases between the two.
    """
    none = F.array().cast("array<bigint>")
    shorter = frequent[1].select("lang", "phrase", F.col("n").alias("a"), none.alias("firsts"), none.alias("rests"))
    candidates, covered = [], []
    for size in sorted(frequent)[1:]:
        stream = frequent[size].select("lang", "phrase", F.col("n").alias("a"),
                                       F.substring_index("phrase", " ", size - 1).alias("first"),
                                       F.substring_index("phrase", " ", 1 - size).alias("rest"))
        by_prefix = shorter.select("lang", F.col("phrase").alias("first"), F.concat("firsts", F.array("a")).alias("firsts"))
        by_suffix = shorter.select("lang", F.col("phrase").alias("rest"), F.concat(F.array("a"), "rests").alias("rests"))
        shorter = written(stream.join(by_prefix.hint("merge"), ["lang", "first"])
                          .join(by_suffix.hint("merge"), ["lang", "rest"])
                          .select("lang", "phrase", "a", "first", "rest", "firsts", "rests"), "phrase-merged")
        candidates.append(shorter.drop("first", "rest"))
        if size > 2:
            covered.append(shorter.filter(F.col("a") >= F.col("firsts")[size - 2]).select("lang", F.col("first").alias("phrase")))
            covered.append(shorter.filter(F.col("a") >= F.col("rests")[0]).select("lang", F.col("rest").alias("phrase")))
    every = reduce(DataFrame.union, candidates)
    inner = reduce(DataFrame.union, covered) if covered else every.select("lang", "phrase").limit(0)
    return every, inner.distinct()


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language in ``docs`` (lang, text).

    A phrase's score is that of its weakest cut, floor(1000 * a * n / (l * r)) in exact decimal arithmetic.
    """
    totals, frequent = streams(docs, least, longest)
    if len(frequent) < 2:
        frequent[2] = frequent[1].limit(0)
    every, inner = merged(frequent)
    left = every.join(inner.hint("merge"), ["lang", "phrase"], "left_anti").join(totals, "lang")
    score = ("CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) "
             "div (CAST(firsts[k - 1] AS DECIMAL(19,0)) * CAST(rests[k - 1] AS DECIMAL(19,0))) AS BIGINT)")
    cuts = (f"array_min(transform(sequence(1, size(firsts)), k -> named_struct('score', {score}, 'k', k, "
            "'l', firsts[k - 1], 'r', rests[k - 1])))")
    scored = left.withColumn("cut", F.expr(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = "ORDER BY score DESC, a DESC, phrase"
    some = (scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
            .withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {best})")).filter(F.col("rank") <= top))
    ranked = some.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {best}) AS BIGINT)"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same counts by brute force: every phrase of 2 to 5 words, all cuts, all longer phrases that hold a shorter one.
ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
spans AS (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM listed, (SELECT unnest([1, 2, 3, 4, 5]) AS m)
  WHERE len(ws) >= m),
counts AS (
  SELECT lang, ws[i:i + m - 1] AS words, m, count(*) AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM counts WHERE m >= 2 AND f >= 100),
parts AS (
  SELECT DISTINCT b.lang, b.words[j:j + s - 1] AS words, b.f
  FROM cand b, (SELECT unnest([2, 3, 4]) AS s) z, (SELECT unnest([1, 2, 3, 4]) AS j) y
  WHERE s < b.m AND j + s - 1 <= b.m),
kept AS (
  SELECT * FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.words = c.words AND 100 * p.f >= 100 * c.f)),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, x.f AS l, y.f AS r, n,
         ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM kept c JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ks ON k < c.m
  JOIN counts x ON x.lang = c.lang AND x.words = c.words[1:k]
  JOIN counts y ON y.lang = c.lang AND y.words = c.words[k + 1:]
  JOIN totals t ON t.lang = c.lang),
weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM weakest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000
"""
