import random

from pyspark.sql import functions as F
from test_lines import variants

from skyloom.llm import line_keys, lines


def by_hand(texts, edits, hot_key):
    """Pairs of keys with few lines, and the lines of the others, by substrings themselves."""
    held = {}
    for x in texts:
        for j, (i, less, offset) in enumerate(lines.key_shapes(edits)):
            n = len(x) - less
            sizes = [n // (edits + 1) + (k >= edits + 1 - n % (edits + 1)) for k in range(edits + 1)]
            start = sum(sizes[:i]) + offset
            held.setdefault((n, i, x[start : start + sizes[i]]), set()).add((x, j))
    pairs, hot = set(), set()
    for own in held.values():
        if any(j <= edits for _, j in own):
            if len(own) > hot_key:
                hot |= own
            else:
                pairs |= {(min(x, y), max(x, y)) for x, j in own for y, k in own if x != y and (j <= edits or k <= edits)}
    return pairs, hot


def test_candidates_are_those_of_substrings(spark):
    rng = random.Random(4)
    texts = sorted({x for k in range(8) for x in variants(rng, f"a common head {k % 2} " + "".join(rng.choice("abc😀") for _ in range(20)) + " and tail", 6, 3)})
    df = spark.createDataFrame([(x,) for x in texts * 2], "line string").withColumn("h", F.xxhash64("line"))
    name = {r["h"]: r["line"] for r in df.collect()}
    for edits, hot_key, buffer in ((3, 5, 1 << 20), (2, 5, 1 << 20), (3, 1000, 20)):
        found = line_keys.candidates(df, lines.key_shapes(edits), edits, hot_key, buffer)
        pairs = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in line_keys.pairs(found).collect()}
        hot = {(name[r["h"]], r["j"]) for r in line_keys.hot_lines(found).collect()}
        assert (pairs, hot) == by_hand(texts, edits, hot_key)
    streamed = line_keys.candidates(df.repartition(1), lines.key_shapes(3), 3, 5, 20)
    assert {(name[r["h"]], r["j"]) for r in line_keys.hot_lines(streamed).collect()} >= by_hand(texts, 3, 5)[1]
    assert line_keys.candidates(df.limit(0), lines.key_shapes(3), 3, 5).count() == 0


def test_signatures_and_ends_keep_all_close_pairs(spark):
    draw = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(draw.choice("abcé 𝒳") for _ in range(draw.randint(24, 300)))
        b = list(a)
        for _ in range(draw.randint(0, 3)):
            at, kind = draw.randrange(len(b)), draw.randrange(3)
            b[at : at + (kind < 2)] = [] if kind == 0 else [draw.choice("abx")]
        pairs.append((a, "".join(b)))
    left, right = (line_keys.signatures([x[i] for x in pairs]).view("<u8") for i in (0, 1))
    differ = [sum(int(x).bit_count() for x in left[:, i] ^ right[:, i]) for i in range(len(pairs))]
    assert max(differ) <= 12
    alone = [line_keys.signatures([a]).view("<u8")[:, 0].tolist() for a, _ in pairs[:20]]
    assert alone == left.T[:20].tolist()
    df = spark.createDataFrame([*pairs, ("aaaa", "aa"), ("abab", "ab"), ("x", "x"), ("", "b")], "x string, y string")
    ends = lines.let(lines.without_ends(F.col("x"), F.col("y")), lambda c: F.levenshtein(c["p"], c["t"]))
    assert df.where(ends != F.levenshtein("x", "y")).count() == 0


def test_far_lines_of_one_key_are_told_apart_by_counts(spark):
    """Copies with a word exchanged share keys; the counts of four characters let most of their pairs through to be compared."""
    rng = random.Random(6)
    words = ["".join(rng.choice("hinorsldcu") for _ in range(7)) for _ in range(30)]
    texts = []
    for _ in range(40):
        own = list(words)
        for k in rng.sample(range(30), 2):
            own[k] = "".join(rng.choice("hinorsldcu") for _ in range(7))
        texts.append(" ".join(own))
    df = spark.createDataFrame([(x,) for x in texts], "line string").withColumn("h", F.xxhash64("line"))
    found = line_keys.candidates(df, lines.key_shapes(3), 3, 64)
    every = line_keys.pairs(found).count()
    asked = line_keys.group_pairs(found, df, lambda x, y: F.length(x) > 0).select("a", "b").distinct().count()
    assert every > 500 and asked < 0.1 * every
