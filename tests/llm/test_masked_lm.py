from collections import Counter

import numpy as np

from envseries.llm import masked_lm
from envseries.llm.storage import table

SF = "/root/testdata/sf0.001"


def test_every_word_has_its_own_count_and_classes_follow_the_vocabulary(spark):
    docs = table(spark, SF, "documents")
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    want = Counter(w for r in docs.collect() for w in (r["text"] or "").translate(lower).encode().split())
    counts = masked_lm.count_words(docs)
    assert sorted(r["n"] for r in counts.frame.collect()) == sorted(want.values())
    cls, share = masked_lm.vocabulary(counts)
    assert len(cls) > masked_lm.OWN * len(want) ** 0.5 and cls.counts.sum() == sum(want.values())
    few, _ = masked_lm.vocabulary(masked_lm.count_words(docs.limit(10)))
    assert len(few) < len(cls)
    # the tail's words have shares of their own, and those of all classes add up to the number of classes in use
    assert share.count() == len(want) - len(cls.own)
    total = sum(np.exp(r["share"]) for r in share.collect())
    assert abs(total - (cls.counts[1 + len(cls.own):] > 0).sum()) < 1e-6


def test_scores_do_not_depend_on_the_layout(spark):
    docs = table(spark, SF, "documents")
    score = lambda d: {r["doc_id"]: r["mean_log_prob"] for r in masked_lm.pseudo_likelihood(d).collect()}
    one, many = score(docs.coalesce(1)), score(docs.repartition(13))
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-6


def test_common_words_take_their_share_from_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % (9 + j)}x" for j in range(1, 60))) for i in range(80)],
                                 "doc_id long, text string")
    cls, share = masked_lm.vocabulary(masked_lm.count_words(docs))
    often, logs, rare = masked_lm.common_words(share, 20)
    assert 0 < len(often) <= 20 and len(often) + rare.count() == share.count() and (np.diff(often) > 0).all()
    rows = masked_lm.encoded(docs, cls, (often, logs)).collect()
    assert not {h for r in rows for h in r["tail"]} & set(often.view(np.int64).tolist())
    assert all(len(r["ids"]) == 2 * 59 for r in rows)
    score = lambda: {r["doc_id"]: r["log_likelihood"] for r in masked_lm.pseudo_likelihood(docs).collect()}
    got = score()
    monkeypatch.setattr(masked_lm, "COMMON", 0)
    want = score()
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-6


def test_blocks_change_no_step_and_no_score(monkeypatch):
    rng = np.random.default_rng(3)
    counts = np.append(0, np.arange(400, 0, -1))
    target, near = rng.integers(1, 401, 5000).astype(np.int32), rng.integers(0, 401, (4, 5000)).astype(np.int32)

    def run():
        p = masked_lm.initial(401, counts)
        seen = {"e": np.zeros(p["e"].shape[:2], np.int64), "w": np.zeros(len(p["w"]), np.int64)}
        masked_lm.step(p, seen, near, target)
        return p, seen, masked_lm.target_logs(p, near, target)

    some, seen, logs = run()
    monkeypatch.setattr(masked_lm, "BLOCK", 1 << 20)
    whole, same, plain = run()
    assert all(abs(some[k] - whole[k]).max() < 1e-4 for k in some) and abs(logs - plain).max() < 1e-4
    assert (seen["e"] == same["e"]).all() and seen["w"].sum() == 5000
    direct = np.log(masked_lm.forward(some, near)[1][np.arange(5000), target])
    assert abs(logs - direct).max() < 1e-4


def test_context_and_counts_equal_a_plain_reading():
    rng = np.random.default_rng(4)
    for sizes in ([0, 1, 2, 3, 0, 5], [0], [1], [2, 0], []):
        first = np.append(0, np.cumsum(sizes)).astype(np.int64)
        cls = rng.integers(1, 9, first[-1]).astype(np.int32)
        want = [[cls[i + o] if a <= i + o < b else 0 for a, b in zip(first[:-1], first[1:]) for i in range(a, b)]
                for o in masked_lm.CONTEXT]
        assert masked_lm.context(cls, first).tolist() == want
    h = rng.integers(0, 2**64 - 1, 300, np.uint64, endpoint=True)[rng.integers(0, 300, 5000)]
    got = masked_lm._tally([(h[:2000], (h[:2000] % 97).astype(np.int64)), (h[2000:], (h[2000:] % 97).astype(np.int64))])
    want = Counter(h.view(np.int64).tolist())
    assert dict(zip(got["h"].to_pylist(), got["n"].to_pylist())) == want
    assert got["s"].to_pylist() == [x % 2**64 % 97 for x in got["h"].to_pylist()]
    known = np.unique(np.append(h, [np.uint64(0), np.uint64(2**64 - 1)]))
    place, found = masked_lm.Places(known[::2]).of(known)
    assert found.tolist() == [i % 2 == 0 for i in range(len(known))] and (known[::2][place[found]] == known[::2]).all()
