import random

from test_lines import DOCS, brute, got, variants

from skyloom.llm import lines
from skyloom.llm.queries import op8_lines


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def report(spark, rows, tmp_path):
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r["dropped"] for r in op8_lines(spark, str(tmp_path)).collect()}


def test_query_finds_three_edits(spark, tmp_path):
    line = "they met at nine and walked along the river nst der garden"
    rows = [(1, line), (2, f"{line.replace('der', 'dieb')}\nan own line which no other document has at all, and long")]
    assert report(spark, rows, tmp_path) == {1: "", 2: "0"}


def test_hot_keys_at_three_edits(spark):
    rng = random.Random(8)
    head, tail = "a common beginning of lines ", " and a common end"
    pool = []
    for _ in range(14):
        base = head + "".join(rng.choice("abcdefghij") for _ in range(rng.choice([14, 16]))) + tail
        pool += variants(rng, base, 4, 3)
    rows = [(i, x) for i, x in enumerate(pool)]
    assert got(frame(spark, rows), edits=3, hot_key=3, max_share=1.0) == brute(rows, 3, max_share=1.0)


def test_query_finds_short_lines(spark, tmp_path):
    own = "an own line which no other document has at all, and long"
    assert report(spark, [(1, "All rights reserved.\n\n"), (2, f"{own}\nALL rights reserved. \n\n")], tmp_path) == {1: "", 2: "1"}


def test_query_drops_repeats_whatever_their_share(spark, tmp_path):
    line = "they met at nine and walked along the river nst der garden"
    assert report(spark, [(1, line), (2, line)], tmp_path) == {1: "", 2: "0"}
