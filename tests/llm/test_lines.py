import random

import duckdb
from pyspark.sql import functions as F

from skyloom.llm import lines
from skyloom.llm.common import load

DOCS = "doc_id long, text string, ih string, dropped string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def near(a, b, edits):
    return abs(len(a) - len(b)) <= edits and distance(a, b) <= edits


def brute(rows, edits=1, min_chars=24, max_share=0.5):
    """Kept text by (doc_id, text)."""
    docs = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    own = [(i, t, k, y) for i, t in docs for k, x in enumerate(t.split("\n")) if len(y := x.strip(" ").lower()) >= min_chars]
    distinct = sorted({x[3] for x in own})
    parent = {x: x for x in distinct}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if near(a, b, edits):
                parent[top(a)] = top(b)
    owner = {}
    for i, _, _, y in own:
        c = top(y)
        if i is not None and (c not in owner or owner[c] is None or i < owner[c]):
            owner[c] = i
        owner.setdefault(c, None)
    out = {}
    for i, t in docs:
        mine = [(k, y) for j, s, k, y in own if (j, s) == (i, t)]
        foreign = {k for k, y in mine if owner[top(y)] != i}
        seen, repeats = set(), set()
        for k, y in mine:
            if top(y) in seen:
                repeats.add(k)
            seen.add(top(y))
        share = sum(len(y) for k, y in mine if k in foreign)
        drop = repeats | (foreign if share <= max_share * sum(len(y) for _, y in mine) else set())
        out[(i, t)] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
    return sorted(((i, out[(i, t)] if t is not None else None) for i, t in rows), key=str)


def got(df, **options):
    return sorted(((r["doc_id"], r["text"]) for r in lines.dedup_lines(df, **options).select("doc_id", "text").collect()), key=str)


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é", "😀"])
        out.append("".join(x))
    return out


def test_edit_distance(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("", "a"), ("ab", ""), ("abc", "abd"), ("kitten", "sitting"), ("a" * 70, "a" * 69 + "b")]
    for _ in range(300):
        base = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 30)))
        pairs.append((base, variants(rng, base or "x", 1, 4)[0]))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        found = df.withColumn("d", lines.edit_distance(F.col("a"), F.col("b"), most)).where(F.abs(F.length("a") - F.length("b")) <= most).collect()
        assert len(found) > 50
        for r in found:
            assert (r["d"] if r["d"] <= most else None) == (d if (d := distance(r["a"], r["b"])) <= most else None), (r, most)


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(22, 40))).strip() for _ in range(12)]
    pool = [x for b in bases for x in variants(rng, b, 6, 3)] + ["short", "", "  Padded LINE of some thirty chars  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    for edits in (1, 2):
        for hot in (2, 64):
            assert got(df, edits=edits, hot_key=hot) == brute(rows, edits)


def test_edges(spark):
    line = "this line is longer than the least length"
    rows = [(3, None), (1, ""), (None, line), (4, f"{line}\nx\n{line}\n"), (4, f"{line}\nx\n{line}\n"), (2, f"{line}s\nanother line that only this document has\n\nand one more of them, to be sure of it"), (9, f"{line}\n{line}?"), (7, "w" * 50_000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and got(df) == brute(rows)
    assert got(df.limit(0)) == [] and lines.line_report(df.limit(0)).count() == 0
    only_null = [(None, line), (None, f"{line}\n{line}")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in only_null], DOCS)
    assert got(df) == brute(only_null)


def test_whole_table(spark, sf):
    docs = load(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == brute(rows)
