import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from skyloom.llm import simhash
from skyloom.llm.common import load

DOCS = "doc_id long, text string, root string, known_kept string"


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """(fingerprint, component) by id, over all pairs of distinct fingerprints."""
    by = defaultdict(list)
    for i, text in rows:
        by[fingerprint(text)].append(i)
    fps, parent = list(by), {f: f for f in by}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    least = defaultdict(lambda: None)
    for f in fps:
        least[top(f)] = min((x for x in [least[top(f)], *by[f]] if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[top(f)]) for f in fps for i in by[f]), key=str)


def found(df, **options):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, **options).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    docs = load(spark, sf.replace("0.001", "0.01"), "documents")
    assert found(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "one"), (8, "ONE"), (7, "a b"), (6, "É É É é"), (6, "É É É é"), (None, "one"), (2, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, "r", "h") for i, t in rows], DOCS)
    assert found(docs) == brute(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})
    assert found(docs.limit(0)) == [] and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_only_null_identifiers(spark):
    docs = spark.createDataFrame([(None, "one two three four", "", ""), (None, "one two three four", "", "")], DOCS)
    assert {c for _, _, c in found(docs)} == {None}
    assert simhash.drop_near_duplicates(docs).count() == 1


def test_hot_keys_lose_no_link(spark):
    """A dense group of fingerprints, with keys cut again beyond three members: the same components."""
    rng = random.Random(7)
    base = rng.getrandbits(64)
    bits = rng.sample(range(64), 14)
    fps = {base ^ sum(1 << b for b in rng.sample(bits, rng.randint(0, 7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def classes(edges):
        parent = {x: x for x in signed}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[top(a)] = top(b)
        out = defaultdict(set)
        for x in signed:
            out[top(x)].add(x)
        return sorted(map(sorted, out.values()))

    want = classes((a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    for members in (3, 4096):
        assert classes(tuple(r) for r in simhash.links(df, members).collect()) == want


def test_components(spark):
    from skyloom.llm.graph import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (5, 3), (3, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
