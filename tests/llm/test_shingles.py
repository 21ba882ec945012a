import random

from skyloom.llm import shingles, simhash

DOCS = "doc_id long, text string"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The identifiers kept, over all pairs."""
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = {i: grams(t) for i, t in rows}
    for i, a in own.items():
        for j, b in own.items():
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted({top(i) for i in own})


def texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [None, "", "  ", "one two", "ONE  two", "one two three"]
    for _ in range(8):
        base = [word() for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(10):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def test_all_similar_pairs_are_linked(spark):
    rows = list(enumerate(texts(random.Random(4))))
    df = spark.createDataFrame(rows, DOCS)
    want = brute(rows)
    for pairs in (2, 16):
        assert sorted(r["doc_id"] for r in shingles.drop_near_copies(df, pairs=pairs).collect()) == want
    assert simhash.drop_near_duplicates(df).count() > len(want)  # three of 64 bits miss copies at this similarity
    assert shingles.drop_near_copies(df.limit(0)).count() == 0


def test_the_pipeline_drops_a_copy_at_this_similarity(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" if i in (30, 90, 150) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "something else of five words or more")]
    assert (simhash.majority(simhash.shingle_digests(rows[0][1].encode(), 3)) ^ simhash.majority(simhash.shingle_digests(rows[1][1].encode(), 3))).bit_count() > 3
    kept = corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
