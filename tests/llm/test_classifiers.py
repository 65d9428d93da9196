import numpy as np

from envseries.llm import language_id, masked_lm, quality_gam, toxicity_fm
from envseries.llm.storage import table

SF01 = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = quality_gam.quality_scores(docs, labels)
    assert got.count() == docs.count()
    r = got.filter("held_out").join(labels, "doc_id").toPandas()
    assert ((r.score >= 0.7) == (r.predicted == 1)).all() and (r.predicted == r.quality).mean() > 0.9


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    r = toxicity_fm.toxicity_scores(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert (r.predicted == r.toxic).mean() > 0.9


def test_factorization_machine_learns_an_interaction():
    rng = np.random.default_rng(0)
    lists = [np.flatnonzero(rng.random(3) < 0.5) for _ in range(2000)]
    y = np.array([float({0, 1} <= set(x.tolist())) for x in lists])
    p = toxicity_fm.fit(lists, y, 3)
    score = lambda x: p["b"][0] + p["w"][x].sum() + (p["v"][x].sum(0) ** 2 - (p["v"][x] ** 2).sum(0)).sum() / 2
    assert score([0, 1]) > 0 > max(score([0]), score([1]), score([0, 2]), score([1, 2]))


def test_toxicity_finds_words_that_tell_only_together(spark):
    """The label is "exactly one of two words": neither tells anything alone, and noise words are everywhere."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(4000):
        a, b = (int(v) for v in rng.random(2) < 0.5)
        words = [f"word{k}" for k in rng.integers(0, 300, 12)] + ["insultish"] * a + ["groupish"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    r = toxicity_fm.toxicity_scores(docs, marks).filter("held_out").join(marks, "doc_id").toPandas()
    assert len(r) > 700 and (r.predicted == r.toxic).mean() > 0.95


def test_toxicity_recall_beyond_a_constant(spark):
    """On the larger table: most toxic rows found, hardly any clean row marked; a constant answer finds none."""
    path = SF01.replace("0.01", "0.1")
    docs, labels = table(spark, path, "documents"), table(spark, path, "labels")
    r = toxicity_fm.toxicity_scores(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert r[r.toxic == 1].predicted.mean() > 0.85 and r[r.toxic == 0].predicted.mean() < 0.01


def test_machine_equals_brute_force_over_pairs():
    rng = np.random.default_rng(2)
    p = {"b": np.array([0.3], np.float32), "w": rng.normal(size=9).astype(np.float32), "v": rng.normal(size=(9, 4)).astype(np.float32)}
    texts = [np.array([0, 3, 8]), np.array([], int), np.array([5]), np.arange(9)]
    rows = np.repeat(np.arange(4), [len(t) for t in texts])
    f, _, _ = toxicity_fm._margin(p, rows, np.concatenate(texts).astype(int), 4)
    for got, t in zip(f, texts):
        want = 0.3 + p["w"][t].sum() + sum(float(p["v"][i] @ p["v"][j]) for k, i in enumerate(t) for j in t[k + 1:])
        assert abs(got - want) < 1e-4


def test_language_on_held_out_rows_and_mixed_text(spark):
    docs = table(spark, SF01, "documents")
    r = language_id.language_spans(docs).filter("held_out").join(docs, "doc_id").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95 and r.score.between(0, 1).all()
    model = language_id.fit(docs, language_id.languages(docs))
    import pyarrow as pa
    text = "the thand inan erthe of and the onthe ther and. " * 4 + "der die und einen schen ungen der zu dem. " * 4
    spans = language_id._predicted(model, pa.array([text]))["spans"][0]
    assert [s["lang"] for s in spans] == ["en", "de"]


def test_viterbi_equals_brute_force():
    import itertools
    rng = np.random.default_rng(1)
    lens = [0, 1, 5, 3]
    first = np.append(0, np.cumsum(lens))
    s = np.log(rng.random((first[-1], 3))) * 4
    label = language_id.viterbi(s, first)
    for a, b in zip(first, first[1:]):
        def worth(path):
            return sum(s[a + i, k] for i, k in enumerate(path)) - language_id.SWITCH * sum(x != y for x, y in zip(path, path[1:]))
        if b > a:
            assert abs(worth(label[a:b]) - max(map(worth, itertools.product(range(3), repeat=int(b - a))))) < 1e-9


def test_pseudo_likelihood_is_a_distribution_and_learns(spark):
    docs = table(spark, SF01, "documents")
    counts = masked_lm.count_words(docs)
    words = docs.selectExpr("sum(regexp_count(text, '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+')) AS n").first()["n"]
    assert counts.sum() == words
    cls, share = masked_lm.vocabulary(counts)
    p = masked_lm.train(docs, cls)
    near = np.array([[3], [4], [5], [6]])
    assert abs(masked_lm.forward(p, near)[1].sum() - 1) < 1e-4
    text = docs.filter("n_chars > 500").orderBy("doc_id").first()["text"].encode()
    raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    trained, first = masked_lm.log_probabilities(p, cls, share, raw, offsets)
    blank, _ = masked_lm.log_probabilities(masked_lm.initial(), cls, share, raw, offsets)
    assert trained.sum() > blank.sum() and first[-1] == len(text.split())


def test_awkward_rows(awkward, nothing, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (9, None, None)],
                                   "doc_id long, quality int, toxic int")
    for found in (quality_gam.quality_scores(awkward, labels), toxicity_fm.toxicity_scores(awkward, labels)):
        r = found.collect()
        assert len(r) == 12 and all(0 <= x["score"] <= 1 for x in r)
    r = {x["doc_id"]: x for x in language_id.language_spans(awkward).collect()}
    assert [r[i]["lang_pred"] for i in (1, 2, 3, 10)] == ["und"] * 4 and r[9]["lang_pred"] == "en"
    r = {x["doc_id"]: x for x in masked_lm.pseudo_likelihood(awkward).collect()}
    assert r[1]["n_words"] == 0 and r[1]["log_likelihood"] == 0 and r[6]["n_words"] == 30_000
    assert quality_gam.quality_scores(nothing, labels.limit(0)).collect() == []
    assert toxicity_fm.toxicity_scores(nothing, labels.limit(0)).collect() == []
    assert language_id.language_spans(nothing).collect() == masked_lm.pseudo_likelihood(nothing).collect() == []
    kept = quality_gam.accepted(awkward, labels)
    assert kept.columns == awkward.columns
