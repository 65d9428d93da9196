from llm_rows import row

from envseries.llm import decontamination


def test_copied_number_series_and_tables_count_in_full(spark):
    series = "Continue the sequence 2 4 8 16 32 64 128 256 512 1024 2048 4096"
    table = "min 5 km 7 km 9 km 11 km 13 km 15 km"
    bench = spark.createDataFrame([(1, series), (2, table)], "item_id long, text string")
    other = series.replace("2 4 8 16 32 64 128 256 512 1024 2048 4096", "3 9 27 81 243 729 2187 6561 19683 59049 7 5")
    rows = [row(1, "Now try this. " + series + " and more"), row(2, other), row(3, series.lower()),
            row(4, "it took 7 " + table + " in all"), row(5, table.replace("11", "12").replace("7", "8").replace("13", "6"))]
    docs = spark.createDataFrame(rows).toDF("doc_id", "text", "lang", "source", "n_chars")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontamination.leaked_pairs(docs, bench).collect()}
    assert got == {(1, 1): 1.0, (3, 1): 1.0, (4, 2): 1.0}
