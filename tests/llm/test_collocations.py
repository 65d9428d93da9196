import os
import random
import re
from collections import Counter

import duckdb
import numpy as np

from llm_rows import DOCS, row

from envseries.llm import catalog, collocations


def brute(rows, least, longest, top):
    """Every phrase counted in a dictionary, every cut, every longer phrase that holds a shorter one."""
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    key = (lang, tuple(w[i:i + size]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= 100 * f[lang, w[i:i + size]]:
                    covered.add((lang, w[i:i + size]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in covered:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                        for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def phrases(seed, rows=120):
    """Few words, so that phrases repeat, overlap themselves and tie; every delimiter; several languages."""
    draw = random.Random(seed)
    words = ["a", "A", "b", "new", "York", "été", "北京", "x-1", "the", "É", "i'm", "ß z"]
    out = []
    for i in range(rows):
        text = "".join(draw.choice(words) + draw.choice([" "] * 12 + ["  ", "\t", " \t ", ".", ", ", ";", ":", "!", "?", "\n", "\r\n", "\x0b", "\x0c"])
                       for _ in range(draw.randint(0, 60)))
        out.append(row(i, text, draw.choice(["en", "de", None, "und", ""])))
    return out


def test_equal_to_brute_force(spark):
    rows = phrases(1) + [row(900, "a a a a a a a " * 400, "en"), row(901, "new York " * 300 + "the new York", "zz")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    for least, longest, top in ((3, 5, 2000), (6, 4, 7), (2, 2, 50), (40, 5, 3)):
        want = brute(rows, least, longest, top)
        assert want and got(collocations.collocations(df, least, longest, top)) == want


def test_filter_decides_nothing(spark, monkeypatch):
    """A filter so small that it lets everything pass, and slices of a few texts, give the same result."""
    rows = phrases(2, 60)
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(collocations, "CHUNK_BITS", 8)
    monkeypatch.setattr(collocations, "LARGEST_BITS", 8)
    monkeypatch.setattr(collocations, "SLICE", 100)
    assert got(collocations.collocations(df, 3, 5, 2000)) == brute(rows, 3, 5, 2000)


def test_given_table_equals_oracle(spark):
    df = catalog.op13_collocation_streams(spark, "/root/testdata/sf0.01")
    path = "/root/testdata/sf0.01/documents.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    want = duckdb.sql(collocations.ORACLE_SQL).fetchall()
    assert want and got(df) == sorted(want)


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r pass 2**63; the result is that of Python's integers."""
    big = 4_000_000_007
    frame = {1: [("en", "x", 3 * big), ("en", "y", 5 * big)], 2: [("en", "x y", 2 * big + 1)]}
    frequent = {k: spark.createDataFrame(v, "lang string, phrase string, n long") for k, v in frame.items()}
    totals = spark.createDataFrame([("en", 10**13 + 7)], "lang string, n long")
    original = collocations.streams
    collocations.streams = lambda *_: (totals, frequent)
    try:
        out = collocations.collocations(spark.createDataFrame([row(1, "x")], DOCS)).collect()
    finally:
        collocations.streams = original
    assert [r.score for r in out] == [1000 * (2 * big + 1) * (10**13 + 7) // (15 * big * big)]


def test_awkward_rows(spark, awkward, nothing):
    assert collocations.collocations(nothing, 2).count() == 0
    rows = [tuple(r)[:5] for r in awkward.collect()]
    extra = awkward.selectExpr("*", "'p' AS phrase", "3 AS size", "1 AS a")
    assert got(collocations.collocations(extra, 2)) == brute(rows, 2, 5, 2000)
    assert collocations.collocations(awkward, 10**6).count() == 0
    long_words = spark.createDataFrame([row(1, ("q" * 70_000 + " tail ") * 3), row(2, None), row(3, "." * 1000)], DOCS)
    assert [r.phrase[-5:] for r in collocations.collocations(long_words, 3).collect()] == [" tail"]


def test_names_do_not_depend_on_neighbours():
    raw = np.frombuffer(b"One  two.three one two", np.uint8)
    scan = collocations.Scan(raw, np.array([0, len(raw)]), ["en"])
    assert scan.whole(2).tolist() == [True, False, True, True]
    pairs = scan.grams(2)
    assert [x[0] == x[3] for x in pairs] == [True, True] and pairs[0][0] != pairs[1][0]
    assert scan.phrases(np.array([0, 2]), 2).to_pylist() == ["one two", "three one"]
