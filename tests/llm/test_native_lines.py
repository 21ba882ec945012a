import random

from pyspark.sql import functions as F
from test_lines import DOCS, distance, variants

from skyloom.llm import line_keys, lines


def test_line_dedup_runs_no_python(spark):
    """Module line_keys made candidates and signatures in Arrow batches."""
    df = spark.createDataFrame([(i, f"one of the lines that only differ by the number {i % 3}", "x", "y") for i in range(9)], DOCS)
    own = lines.lines_of(df, "doc_id", "text", 24)
    plans = [line_keys.candidates(own, lines.key_shapes(3), 3, 2), line_keys.marks(own, 3), lines.line_report(df, **lines.WHOLE)]
    assert not any("MapInArrow" in x._jdf.queryExecution().executedPlan().toString() or "Python" in x._jdf.queryExecution().executedPlan().toString() for x in plans)
    source = open(line_keys.__file__).read() + open(lines.__file__).read()
    assert "mapInArrow(" not in source and "mapInPandas(" not in source


def test_hot_lines_meet_once_and_lose_no_close_pair(spark):
    """Variants of one line with other words: few pairs, each once, and all within the edits among them."""
    rng = random.Random(9)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    pool = set()
    for _ in range(120):
        own = list(words)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = "".join(rng.choice("aehinorst") for _ in range(rng.randint(2, 7)))
        pool |= {x for x in variants(rng, " ".join(own), 1, 3)} | {" ".join(own)}
    texts = sorted(pool)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "h long, line string")
    for edits in (2, 3):
        met = [(r["a"], r["b"]) for r in line_keys.hot_pairs(line_keys.marks(df, edits), edits).collect()]
        close = {(r["a"], r["b"]) for r in df.select(F.col("h").alias("a"), F.col("line").alias("x")).join(df.select(F.col("h").alias("b"), F.col("line").alias("y")), F.col("a") < F.col("b")).where(F.levenshtein("x", "y") <= edits).collect()}
        assert len(met) == len(set(met)) and close and close <= set(met)
        assert len(met) < 0.1 * len(texts) ** 2 / 2
        a, b = min(close)
        assert distance(texts[a], texts[b]) <= edits
