"""Spelling variants: frequent words one edit apart, found in a trie of letter counts.

A word's frequency vector counts its letters by group (``GROUPS``), and words are arranged in a trie by one group's
count after the other.  One inserted, deleted or replaced code point changes at most one count up and one down, so a
depth-first search may once take a child with a count more than the word's (surplus) and once one with a count less
(deficit).  The words in the leaves it reaches are verified code point by code point.

Subtrees are the unit of distribution: the first ``depth`` levels are walked by the shuffle, which sends each word to the
subtrees its budget can reach, and ``depth`` grows until no subtree has more than ``SUBTREE_WORDS`` words (or the levels
end).  A search starts at the shorter word of a pair; of words of one length, at the one whose first differing count is
the smaller.  So the first difference is always a surplus, and each pair is met once.

Edge cases: null texts have no runs, a null id counts as the empty string in the checksum, repeated rows count each time,
other columns are ignored; no word occurs often enough in an empty table, so its result is empty.  Words may be of any
length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A run whose checksum this number divides loses a code point.
DAMAGED = 199
#: A form occurs at least so many times as often as the word.
TIMES = 5

#: Letters counted together, common ones alone and first; all other code points by their remainder mod 4.
GROUPS = ["e", "t", "n", "a", "r", "i", "o", "h", "s", "l", "d", "u", "m", "c", "p", "gk", "fv", "bw", "qxyzj"]
LEVELS = len(GROUPS) + 4
GROUP_OF = np.array([next((g for g, letters in enumerate(GROUPS) if chr(c) in letters), len(GROUPS) + c % 4)
                     for c in range(256)])

SUBTREE_WORDS = 20_000
#: Pairs of word and node, or of word and word, that a task handles at a time.
BLOCK = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) that are long and frequent enough, damaged runs included."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.filter(F.length("run") >= LEAST_LENGTH).withColumn("run", F.translate("run", _UPPER, _LOWER))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    word = F.expr(f"if(h % {DAMAGED} = 0, concat(substr(run, 1, int(h % length(run))), substr(run, int(h % length(run)) + 2)), run)")
    words = low.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def latin1(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words (all below 256) and the offsets of each."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    lead = raw == 0xC3  # the only lead byte of U+00C0 to U+00FF
    ahead = np.append(0, np.cumsum(lead))
    data = raw + np.where(raw >= 0x80, 0x40, 0).astype(np.uint8)
    offsets = offsets - offsets[0]
    return data[~lead], offsets - ahead[offsets]


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words x levels: letters of each group."""
    n = len(offsets) - 1
    word = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(word * LEVELS + GROUP_OF[data], minlength=n * LEVELS).reshape(n, LEVELS)


def subtree(prefix: np.ndarray) -> list[bytes]:
    """The name of the subtree below each row of counts."""
    wide = np.ascontiguousarray(prefix, np.int32)
    return [row.tobytes() for row in wide]


def reachable(prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, their counts after spending, budget spent) for each way to spend the budget on the first levels.

    Spent 0: nothing; 1: a surplus; 2: a surplus and, on a later level, a deficit.
    """
    n, depth = prefix.shape
    every = np.arange(n)
    yield every, prefix, 0
    for up in range(depth):
        more = prefix.copy()
        more[:, up] += 1
        yield every, more, 1
        for down in range(up + 1, depth):
            rows = np.flatnonzero(prefix[:, down] > 0)
            less = more[rows]
            less[:, down] -= 1
            yield rows, less, 2


def routed(words: DataFrame, depth: int) -> DataFrame:
    """(tree, word, n, spent): each word in its own subtree (spent -1) and as a query in all it can reach."""

    def route(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                prefix = vectors(*latin1(part.column("word")))[:, :depth]
                for rows, counts, spent in [(np.arange(len(part)), prefix, -1), *reachable(prefix)]:
                    some = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(subtree(counts), pa.binary()), some.column("word"), some.column("n"),
                         pa.array(np.full(len(rows), spent, np.int8))], ["tree", "word", "n", "spent"])

    return words.mapInArrow(route, "tree binary, word string, n long, spent byte")


class Trie:
    """The trie of one subtree below its first levels: sorted vectors, and for each level the children's keys."""

    def __init__(self, counts: np.ndarray, most: int):
        """``most`` is the largest count that a search may ask for."""
        self.order = np.lexsort(counts.T[::-1]) if counts.shape[1] else np.arange(len(counts))
        counts = counts[self.order]
        self.base = most + 3
        self.children = []
        node = np.zeros(len(counts), np.int64)
        for level in range(counts.shape[1]):
            key = node * self.base + counts[:, level] + 1
            new = np.append(True, key[1:] != key[:-1])
            self.children.append(key[new])
            node = np.cumsum(new) - 1
        self.leaf = node

    def search(self, counts: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, spent) blocks, depth first: the stack holds blocks of nodes still to be followed down."""
        stack = [(0, q, np.zeros(len(q), np.int64), spent[q]) for q in blocks(len(counts))]
        while stack:
            level, query, node, spent = stack.pop()
            if level == len(self.children):
                yield query, node, spent
                continue
            keys = self.children[level]
            found = []
            for delta, may, after in ((0, spent >= 0, spent), (1, spent == 0, spent + 1), (-1, spent == 1, spent + 1)):
                key = node[may] * self.base + counts[query[may], level] + 1 + delta
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                found.append((query[may][hit], at[hit], after[may][hit]))
            query, node, spent = (np.concatenate(x) for x in zip(*found))
            for part in blocks(len(query)):
                stack.append((level + 1, query[part], node[part], spent[part]))


def blocks(n: int) -> Iterator[np.ndarray]:
    for at in range(0, n, BLOCK):
        yield np.arange(at, min(at + BLOCK, n))


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ahead = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) + np.repeat(starts - ahead, lens)


def one_edit(data: np.ndarray, short: np.ndarray, length: np.ndarray, other: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether words that start at ``short`` and ``other`` differ by one replaced code point or, where ``longer``, by one
    that the other has inserted.  ``length`` is that of the first word."""
    ahead = np.cumsum(length) - length
    where = np.arange(int(length.sum())) - np.repeat(ahead, length)
    left = data[np.repeat(short, length) + where]
    right = np.repeat(other, length) + where
    unlike = left != data[right]
    replaced = np.add.reduceat(unlike, ahead, dtype=np.int64) == 1
    ends = np.repeat(length, length)
    first = np.minimum.reduceat(np.where(unlike, where, ends), ahead)  # first differing position, else the length
    shifted = np.repeat(longer, length)
    moved = np.zeros(len(where), bool)
    moved[shifted] = left[shifted] != data[right[shifted] + 1]
    late = moved & (where >= np.repeat(first, length))
    return np.where(longer, np.add.reduceat(late, ahead, dtype=np.int64) == 0, replaced)


def near_in(words: pa.Array, n: np.ndarray, spent: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, spent) of the verified pairs among the rows of one subtree: queries and the words that live there.

    Words one edit apart, of six code points or more, agree in their first three or in their last three, so of a leaf only
    the words that share either with the query are compared.
    """
    data, offsets = latin1(words)
    lens = np.diff(offsets)
    counts = vectors(data, offsets)[:, depth:]
    home, asked = np.flatnonzero(spent < 0), np.flatnonzero(spent >= 0)
    if not len(home) or not len(asked):
        return
    wide = data.astype(np.int64)
    head = wide[offsets[:-1]] << 16 | wide[offsets[:-1] + 1] << 8 | wide[offsets[:-1] + 2]
    tail = wide[offsets[1:] - 1] << 16 | wide[offsets[1:] - 2] << 8 | wide[offsets[1:] - 3]
    trie = Trie(counts[home], int(counts.max(initial=0)))
    living = home[trie.order]
    sides = []
    for end in (head, tail):
        key = trie.leaf << 24 | end[living]
        order = np.argsort(key, kind="stable")
        sides.append((end, key[order], living[order]))
    for query, leaf, used in trie.search(counts[asked], spent[asked]):
        query = asked[query]
        for side, (end, keys, there) in enumerate(sides):
            key = leaf << 24 | end[query]
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            total = np.cumsum(hi - lo)
            at = 0
            while at < len(query):  # whole queries, as many as make up a block of pairs
                to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")), at + 1)
                sizes = hi[at:to] - lo[at:to]
                left, state = np.repeat(query[at:to], sizes), np.repeat(used[at:to], sizes)
                right = there[spread(lo[at:to], sizes)]
                at = to
                fits = lens[right] == lens[left] + (state == 1)
                if side:
                    fits &= head[left] != head[right]
                left, right, state = left[fits], right[fits], state[fits]
                if len(left):
                    good = one_edit(data, offsets[left], lens[left], offsets[right], state == 1)
                    yield left[good], right[good], state[good]


def near_words(words: DataFrame, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """(word, near, near_n) for both words of every pair of ``words`` (word, n) that differ by one code point."""
    depth = 1
    while depth < LEVELS and (largest := largest_subtree(words, depth)) and largest > subtree_words:
        depth += 1

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        word, n = (table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type)
                   for c in ("word", "n"))
        out = []
        for left, right, spent in near_in(word, n, table.column("spent").to_numpy(), depth):
            back = np.flatnonzero(spent > 0)  # words with the same vector are queries for each other
            a, b = np.concatenate([left, right[back]]), np.concatenate([right, left[back]])
            out.append(pa.table({"word": word.take(pa.array(a)), "near": word.take(pa.array(b)), "near_n": n.take(pa.array(b))}))
        schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
        return pa.concat_tables([schema.empty_table(), *out])

    return routed(words, depth).groupBy("tree").applyInArrow(search, "word string, near string, near_n long")


def largest_subtree(words: DataFrame, depth: int) -> int | None:
    """Words in the largest subtree below ``depth`` levels; None if there are no words."""

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(subtree(vectors(*latin1(batch.column("word")))[:, :depth]), pa.binary())], ["tree"])

    sizes = words.select("word").mapInArrow(named, "tree binary").groupBy("tree").agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.max("k")).first()[0]


def variants(docs: DataFrame, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary(docs)``.

    The form is the most frequent near word, ties by code point order, if it is ``TIMES`` as frequent as the word.
    """
    words = written(vocabulary(docs), "spelling-words")
    near = near_words(words, subtree_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    chosen = -F.col("best.n") >= TIMES * F.col("n")
    table = written(words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, -F.col("best.n")).alias("form_n")), "spelling-forms")
    # counts grow by TIMES with each step, which bounds a chain; each round doubles how far a word has come
    most = table.agg(F.max("n")).first()[0] or 1
    steps = max(int(math.log(most, TIMES)), 1)
    roots = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Words of one length with the same code point masked, and words that a deleted code point makes equal; no trie.
ORACLE_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
occ AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
sums AS (
  SELECT run, k, 4294967295 - list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
         lambda c, b: xor(t[(xor(c, b) % 256) + 1], c // 256)) AS h FROM occ, tab),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(k)::BIGINT AS n FROM sums GROUP BY 1),
vocab AS (SELECT word, n FROM words WHERE length(word) >= 6 AND n >= 5),
cut AS (
  SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN vocab y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN vocab y ON y.word = x.a || x.b),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT v.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b ON b.word = v.word),
chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS here FROM forms
    UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL)
  SELECT c.word, here FROM c JOIN forms f ON f.word = c.here WHERE f.form IS NULL)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word
"""
