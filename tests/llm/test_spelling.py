import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from llm_rows import DOCS, row

from envseries.llm import catalog, spelling


def brute_words(rows):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def variants_of(seed, words=150):
    """Words with edits everywhere, anagrams, repeated letters, capitals with accents, chains of forms and ties."""
    draw = random.Random(seed)
    letters = "etaoinshrdlucmgkfvbwqxyzÀÉéèßñÿ×"
    pool = []
    for _ in range(words):
        base = draw.choice(pool) if pool and draw.random() < 0.7 else "".join(draw.choice(letters) for _ in range(draw.randint(5, 11)))
        i = draw.randrange(len(base))
        c = draw.choice(letters)
        pool.append(draw.choice([base, base[:i] + c + base[i:], base[:i] + base[i + 1:], base[:i] + c + base[i + 1:],
                                 base[::-1], base[:i] + base[i] + base[i:]]))
    rows = []
    for i, w in enumerate(pool):
        rows += [row(i * 100 + j, f"{w}, 1{w.upper() if w.isascii() else w};") for j in range(draw.choice([2, 3, 3, 15, 80]))]
    return rows


def test_equal_to_brute_force(spark):
    rows = variants_of(3) + [row(None, "colour color colours " * 6), row(7, "stonework " * 700 + "stonewrk " * 130 + "stonwrk " * 20 + "stnwrk " * 4)] * 2
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] not in (None, r[2]) for r in want)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert got(spelling.variants(df)) == want
    assert got(spelling.variants(df, subtree_words=12)) == want  # many levels walked by the shuffle
    assert got(spelling.variants(df, subtree_words=1)) == want  # all levels


def test_given_table_equals_oracle(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    want = sorted(duckdb.sql(spelling.ORACLE_SQL).select("word, form, root, n, n_near, form_n").fetchall(), key=lambda r: r[0])
    assert len(want) > 1000 and got(catalog.op12_spelling_trie(spark, "/root/testdata/sf0.01")) == want


def test_awkward_rows(spark, awkward, nothing):
    assert spelling.variants(nothing).count() == 0
    rows = [tuple(r)[:5] for r in awkward.collect()]
    assert got(spelling.variants(awkward.selectExpr("*", "'w' AS word", "'f' AS form", "'r' AS run", "1 AS id"))) == brute(rows)
    long = "ab" * 40_000
    rows = [row(i, f"{long} {long}{'x' if i > 2 else ''}") for i in range(8)] + [row(50, None), row(51, ""), row(52, "ÿÿÿÿÿÿ " * 5)]
    assert got(spelling.variants(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_code_points_and_small_blocks(monkeypatch):
    data, offsets = spelling.latin1(pa.array(["xx", "Àéÿ", "", "ß×a"]).slice(1))
    assert bytes(data).decode("latin-1") == "Àéÿß×a" and offsets.tolist() == [0, 3, 3, 6]
    monkeypatch.setattr(spelling, "BLOCK", 3)
    words = ["stonew", "stnoew", "stonex", "stone", "astonew", "stonewe", "tonews", "stoneww", "sxonew", "stonew" * 9, "stonew" * 9 + "w"]
    words = sorted({w for w in words if len(w) >= 6})
    both = pa.array(words + words)
    spent = np.repeat([-1, 0], len(words)).astype(np.int8)
    found = set()
    for a, b, _ in spelling.near_in(both, np.ones(len(both)), spent, 0):
        found |= {frozenset((both[i].as_py(), both[j].as_py())) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {frozenset((a, b)) for a in words for b in words if one_apart(a, b)}
