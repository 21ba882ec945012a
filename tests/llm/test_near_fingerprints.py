from skyloom.llm import shingles, simhash


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_the_pipeline_links_by_fingerprints_too(spark):
    """Texts that op2 links although their sets of five-word shingles are below a similarity of 0.8: the stage kept both."""
    import corpus_pipeline

    one = "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 " * 30
    two = one + "a b c"
    sets = [shingles.shingle_set(x.encode()).tolist() for x in (one, two)]
    prints = [simhash.majority(simhash.shingle_digests(x.encode(), 3)) for x in (one, two)]
    assert jaccard(*sets) < 0.8 and (prints[0] ^ prints[1]).bit_count() <= 3
    rows = [(1, two), (2, one), (3, "something else of five words or more"), (4, None), (5, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, df, "").collect()) == [1, 3, 4]
    assert sorted(r["doc_id"] for r in shingles.drop_near_copies(df).collect()) == [1, 2, 3, 4]
