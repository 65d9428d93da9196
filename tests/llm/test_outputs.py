import random

import numpy as np
from llm_rows import DOCS, row

from envseries.llm import catalog, decontamination, mixing, token_shards, warc
from envseries.llm.storage import shared_dir, table, written

SF01 = "/root/testdata/sf0.01"


def archive(n=40):
    rng = random.Random(3)
    parts = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(50, 400)))
        import hashlib
        data = warc.record(str(i), f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), len(body), None)
        parts.append(warc.member(data) if i % 3 else data)
    return parts


def test_salvage_recovers_all_but_the_damaged():
    parts = archive()
    whole = list(warc.salvage(b"".join(parts)))
    assert [r["page_id"] for r in whole] == [str(i) for i in range(40)] and all(r["status"] == "ok" for r in whole)
    bad = list(parts)
    bad[7] = bad[7][:20] + bytes([bad[7][20] ^ 255]) + bad[7][21:]      # a bit error inside a member
    bad[12] = bad[12][:len(bad[12]) // 2]                               # a plain record cut off
    bad[20] = b"\x1f\x8b\x08junk\nWARC/1.1 not a record"                # noise that looks like a start
    data = b"".join(bad) + bad[5][:30]
    got = list(warc.salvage(data))
    assert {r["page_id"] for r in got if r["status"] == "ok"} == {str(i) for i in range(40)} - {"7", "12", "20"}
    assert sum(r["length"] for r in got) == len(data) and sum(r["status"] == "gap" for r in got) == 4
    assert list(warc.salvage(b"")) == []


def test_archive_round_trip_of_awkward_pages(spark):
    big = "é" * 200_000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (2, None, big), (3, None, None), (4, "u", "small"),
            (5, "u", "small"), (None, "u", "z" * 150), (6, "u", "z" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS n")
    got = sorted((r["page_id"] or "", r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect())
    assert got == [("", "revisit", "6", 150), ("1", "response", None, 400_000), ("2", "revisit", "1", 400_000),
                   ("2", "revisit", "1", 400_000), ("3", "response", None, 0), ("4", "response", None, 5),
                   ("5", "response", None, 5), ("6", "response", None, 150)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_mix_budgets_and_awkward_rows(awkward, nothing):
    r = mixing.mix_plan(awkward).toPandas()
    assert len(r) == 12 and (r.taken <= 3 * r["size"]).all() and mixing.mix_plan(nothing).collect() == []
    again = mixing.mix_plan(awkward.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert r[key].sort_values(key).values.tolist()[:8] == again[key].sort_values(key).values.tolist()[:8]
    rows = mixing.mixed(awkward)
    assert rows.columns == awkward.columns
    assert rows.selectExpr("sum(regexp_count(text, '[^ \\\\t\\\\n]+')) AS n").first()["n"] == r.taken.sum()


def test_mix_on_given_table_meets_targets(spark):
    r = mixing.mix_plan(table(spark, SF01, "documents")).toPandas()
    total = r["size"].sum()
    by = r.groupby("target").agg(taken=("taken", "sum"))
    assert abs(r.taken.sum() - total) < 0.05 * total and len(by) == 3


def test_feistel_is_a_permutation():
    for domain in (1, 2, 3, 17, 1000, 4097):
        out = token_shards.feistel(np.arange(domain), domain, 7)
        assert sorted(out.tolist()) == list(range(domain))
    assert token_shards.feistel(np.arange(50), 50, 7).tolist() != token_shards.feistel(np.arange(50), 50, 8).tolist()


def test_shards_hold_every_token_once_and_resume(spark, awkward, tmp_path):
    path = f"{tmp_path}/docs"
    awkward.write.parquet(path)
    docs = spark.read.parquet(path)
    folder = shared_dir(spark, "tokens-test")
    manifest = token_shards.write_shards(docs, folder)
    rows = manifest.collect()
    got = token_shards.read_shards(spark, folder, manifest).orderBy("position").toPandas()
    assert got.position.tolist() == list(range(len(got))) and got.slot.is_monotonic_increasing and got.slot.is_unique
    encode = token_shards.encoder(token_shards.vocabulary_path()).encode_ordinary
    want = sum(len(encode(r["text"] or "")) + 1 for r in docs.collect())
    assert got.n_tokens.sum() == want
    everything = [t.tolist() for t in token_shards.read_from(folder, rows, 0, 10**9)]
    middle = len(got) // 2
    assert [t.tolist() for t in token_shards.read_from(folder, rows, middle, 3)] == everything[middle:middle + 3]
    assert token_shards.materialised(docs.limit(0)).count() == 0
    one = got[got.doc_id == 9].sort_values("seq_no")
    ids = sum((everything[p] for p in one.position), [])
    assert ids == [*encode("été 北京 ñandú"), token_shards.END_TOKEN]


def test_leaks_verbatim_recased_and_with_new_values(spark, awkward, nothing):
    item = "A train leaves Boston at 7 am and travels 120 km toward Denver before a storm stops it near Boston again."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    filler = "some other words come here first and then go on for a while "
    new = item.replace("Boston", "Madrid").replace("Denver", "Berlin").replace("120", "455").replace(" 7 ", " 9 ")
    torn = item.replace("Boston", "Madrid", 1).replace("Denver", "Berlin").replace("120", "455")
    rows = [row(1, filler + item + " " + filler), row(2, filler + item.upper()), row(3, filler + item.lower()),
            row(4, filler + new + filler), row(5, filler * 5), row(6, "it travels 120 km toward Denver " + filler),
            row(7, "Too, short!"), row(8, None), row(9, filler + torn)]
    docs = spark.createDataFrame(rows).toDF("doc_id", "text", "lang", "source", "n_chars")
    got = decontamination.leaked_pairs(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(1, 1), (2, 1), (3, 1), (4, 1), (7, 3)}
    assert not {r["doc_id"] for r in got} & {5, 6, 8}
    assert {r["doc_id"]: r["conflicts"] for r in got}.get(4) == 0
    assert all(r["conflicts"] > 0 for r in got if r["doc_id"] == 9)
    left = decontamination.decontaminated(docs, bench)
    assert left.columns == docs.columns and {5, 6, 8} <= {r["doc_id"] for r in left.collect()}
    assert decontamination.leaked_pairs(nothing, bench).collect() == []
    assert decontamination.leaked_pairs(awkward, bench.limit(0)).collect() == []


def test_leaks_on_given_table_equal_brute_force(spark):
    import re
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs, bench = table(spark, SF01, "documents").collect(), table(spark, SF01, "benchmark").collect()
    want = set()
    items = {b["item_id"]: words(b["text"]) for b in bench}
    for d in docs:
        w = words(d["text"])
        have = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        want |= {(d["doc_id"], i) for i, x in items.items()
                 if sum(tuple(x[j:j + 5]) in have for j in range(len(x) - 4)) >= 0.5 * (len(x) - 4)}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.QUERIES["op3_template_decontamination"](spark, SF01).collect()}
    assert got == want


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = table(spark, SF01, "documents")
    names = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF01), "test-stage")
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF01)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def records(n, size=400):
    import hashlib
    rng = random.Random(9)
    out = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(size))
        out.append(warc.record(str(i), f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), len(body), None))
    return out


def test_salvage_inside_a_member():
    """Ten records in one member: a bad one costs no other; of a torn member those before the tear are kept."""
    made = records(10)
    bad = made[4].replace(b"sha256:", b"sha256:0", 1)
    one = warc.member(b"".join([*made[:4], bad, *made[5:]]))
    after = warc.member(made[0])
    rows = list(warc.salvage(one + after))
    assert [r["page_id"] for r in rows if r["status"] == "ok"] == [str(i) for i in (0, 1, 2, 3, 5, 6, 7, 8, 9, 0)]
    gaps = [r for r in rows if r["status"] == "gap"]
    assert len(gaps) == 1 and "digest" in gaps[0]["reason"] and "of the member's content" in gaps[0]["reason"]
    assert sum(r["length"] for r in rows) == len(one + after)
    stray = warc.member(b"".join(made) + b"stray bytes")
    assert sum(r["status"] == "ok" for r in warc.salvage(stray)) == 10

    whole = warc.member(b"".join(made))
    cut = list(warc.salvage(whole[:-40] + after))
    assert [r["page_id"] for r in cut if r["status"] == "ok"] == [*map(str, range(9)), "0"]
    assert [(r["offset"], r["length"]) for r in cut if r["status"] == "gap"] == [(0, len(whole) - 40)]
    assert sum(r["length"] for r in cut) == len(whole) - 40 + len(after)

    torn = bytearray(whole)
    torn[len(whole) // 2:len(whole) // 2 + 60] = bytes(60)
    rows = list(warc.salvage(bytes(torn) + after))
    kept = [int(r["page_id"]) for r in rows if r["status"] == "ok"]
    assert kept[:4] == [0, 1, 2, 3] and kept[-1] == 0 and len(kept) < 11
    assert sum(r["length"] for r in rows) == len(whole) + len(after)
    assert [r["reason"] for r in warc.salvage(warc.member(b""))] == ["member is empty"]


def test_near_duplicate_stage_drops_rows_not_ids(spark):
    import corpus_pipeline
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "other")
    only = " ".join(f"u{i}" for i in range(40))
    rows = [row(1, text), row(2, text), row(2, only), row(3, near), row(4, "alone here"), row(4, "alone here"),
            row(None, only + " more"), row(None, "a null id of its own"), row(5, None), row(5, None), row(6, ""), row(7, text)]
    docs = written(spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS kept", "1 AS n_shingles", "7 AS _key"), "test-docs")
    out = corpus_pipeline.near_duplicates(spark, docs, None)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    texts = [t for _, t in left]
    assert sum(t in (text, near) for t in texts) == 1 and sum(t is not None and t.startswith("u0") for t in texts) == 1
    assert texts.count("alone here") == 1 and texts.count("a null id of its own") == 1
    assert texts.count(None) == 2 and texts.count("") == 1 and len(texts) == 7


def test_stages_on_awkward_rows(spark, awkward):
    """Every stage keeps its columns and loses no clean text: nulls, blanks, repeated ids, long texts, clashing columns."""
    import corpus_pipeline
    docs = written(awkward.selectExpr("*", "'leak' AS _leak_key"), "test-awkward")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = written(stage(spark, docs, SF01), "test-awkward")
        assert out.columns == docs.columns, name
        if name == "near-duplicate removal":  # ids 4, 5, 5 and null are copies, 7 is nearly 6
            assert out.filter("text = 'solo'").count() == 1 and out.filter("length(text) > 1000").count() == 1
            assert out.filter("lower(text) LIKE 'one two%'").count() == 1
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF01).count() >= 0
    empty = written(awkward.limit(0), "test-empty")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF01)
        assert out.columns == empty.columns and out.count() == 0, name
