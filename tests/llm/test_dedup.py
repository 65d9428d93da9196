import hashlib
import random
import re

import numpy as np
from llm_rows import row

from envseries.llm import exact_dedup, near_dedup
from envseries.llm.components import components
from envseries.llm.textscan import Words, shingle_sets, text_slices

SF01 = "/root/testdata/sf0.01"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(texts, n):
    """Smallest id reachable over links of Jaccard >= 0.8, by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, count, words):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(count):
        t = list(base)
        for _ in range(rng.randrange(0, words // 12 + 2)):
            t[rng.randrange(words)] = f"v{rng.randrange(10_000)}"
        yield " ".join(t)


def test_near_groups_equal_brute_force(spark):
    texts = [*near_copies(1, 60, 30), *near_copies(2, 60, 120), *near_copies(3, 40, 500), *near_copies(4, 12, 1),
             "a b", "A B", "a", "", None]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)]).toDF("doc_id", "text", "lang", "source", "n_chars")
    for n in (2, 5):
        want = brute_components(list(enumerate(texts)), n)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs, words=n).collect()}
        assert got == want


def test_near_groups_on_given_table_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").filter("n_chars < 4000")  # brute force compares all pairs
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs, words=5).collect()}
    assert got == want


def test_near_groups_awkward_rows(awkward, nothing):
    got = near_dedup.near_groups(awkward, words=2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 12 and near_dedup.near_groups(nothing).collect() == []
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 6]
    assert by[None]["component_id"] == 4 and not by[None]["kept"] and by[8]["kept"]


def test_words_equal_regex():
    import pyarrow as pa
    texts = ["", "a", " A  b\x0bc\x1fd\n", "x" * 100 + " é ü", None, "tail"]
    for _, _, raw, offsets in text_slices(pa.array(texts), 1 << 30):
        w = Words(raw, offsets)
        assert np.diff(w.first).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
        assert [len(s) for s in shingle_sets(w, 2)] == [0, 1, 2, 1, 0, 1]


def test_components_of_chains_stars_and_cliques(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1001 + i) for i in range(50)]
    clique = [(a, b) for a in range(2000, 2008) for b in range(2000, a)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + clique, "a long, b long")).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(len, groups.values())) == [8, 51, 61]


def test_exact_groups_awkward_rows(awkward, nothing):
    got = exact_dedup.exact_groups(awkward, block_chars=7).collect()
    assert len(got) == 12 and exact_dedup.exact_groups(nothing).collect() == []
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert [(by[i]["keep_id"], by[i]["group_size"], by[i]["kept"]) for i in (1, 2, 3)] == [(2, 2, False), (2, 2, True), (3, 1, True)]
    assert by[4]["keep_id"] == by[5]["keep_id"] == by[None]["keep_id"] == 5 and by[5]["group_size"] == 4
    assert by[6]["group_size"] == 1 and by[9]["text_sha256"] == hashlib.sha256(lowered("été 北京 ñandú").encode()).hexdigest()


def test_block_names_survive_shared_hashes(spark, monkeypatch):
    """With a hash of two values all blocks share hashes; names must still tell them apart."""
    from pyspark.sql import functions as F
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) % 2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abcdef", "ABCDEF", "abcxyz", "abc", "", "abcabc", "xyz"])],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs, block_chars=3).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
