import random

from pyspark.sql import functions as F

from skyloom.llm import line_keys, lines


def table(spark, texts):
    return spark.createDataFrame([(x,) for x in texts], "line string").withColumn("h", F.xxhash64("line"))


def close(x, y):
    return lines.close_lines(x, y, 3)


def test_a_shared_key_costs_a_row_a_line_not_a_row_a_pair(spark):
    """Fifty lines with one segment in common made 1,225 candidates; only close pairs leave the join now."""
    rng = random.Random(3)
    head = "thirty characters at the front"
    texts = [head + "".join(rng.choice("abcdefghij") for _ in range(90)) for _ in range(50)]
    df = table(spark, texts)
    found = line_keys.candidates(df, lines.key_shapes(3), 3, 64)
    assert found.count() <= 2 * len(texts)
    assert line_keys.in_need(found).count() <= 2 * len(texts)
    assert line_keys.pairs(found).count() == 1225
    assert line_keys.group_pairs(found, df, close).count() == 0
    near = texts[7].replace(texts[7][60:62], "é")
    df = table(spark, [*texts, near])  # the one line's keys are cut from bytes, the other's from characters
    met = line_keys.group_pairs(line_keys.candidates(df, lines.key_shapes(3), 3, 64), df, close).collect()
    assert {frozenset((r["x"], r["y"])) for r in met} == {frozenset((texts[7], near))}


def test_links_of_a_group_of_near_copies_grow_with_its_lines(spark):
    """Lines that differ in three digits are all within three edits: 7,140 links of 120 lines."""
    texts = [f"the order with the number {k:03d} left the house in the usual way this morning" for k in range(120)]
    edges = [(r["a"], r["b"]) for r in lines.line_links(table(spark, texts), 3, 8).collect()]
    assert len(edges) <= 14 * len(texts)
    roots = lines.components(spark.createDataFrame(edges, "a long, b long"))
    assert roots.count() == len(texts) and roots.select("root").distinct().count() == 1


def test_lines_of_different_stars_still_meet(spark):
    """Stars spare pairs of one star only: classes are those of all close pairs."""
    rng = random.Random(12)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 6))) for _ in range(14)]
    pool = set()
    for _ in range(60):
        own = list(words)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = "".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 6)))
        pool.add(" ".join(own))
    df = table(spark, sorted(pool))
    every = df.select(F.col("h").alias("a"), F.col("line").alias("x")).crossJoin(df.select(F.col("h").alias("b"), F.col("line").alias("y")))
    want = lines.components(every.where((F.col("a") < F.col("b")) & (F.levenshtein("x", "y") <= 3)).select("a", "b"))
    classes = lambda found: {(r["node"], r["root"]) for r in found.collect()}
    assert classes(want) == classes(lines.components(lines.line_links(df, 3, 4)))
    assert len({root for _, root in classes(want)}) > 1
