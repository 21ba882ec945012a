import hashlib
import random
import zlib

import numpy as np

from skyloom.llm import runs
from skyloom.llm.common import load
from skyloom.llm.queries import op13_runs


def brute(words, least=24, times=3):
    """Runs of a text, each period by itself."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def found(texts, **how):
    owner, *rest = runs.word_runs([np.array(x, np.int64) for x in texts], **how)
    out = [[] for _ in texts]
    for k, *r in zip(owner.tolist(), *[x.tolist() for x in rest], strict=True):
        out[k].append(tuple(r))
    return out


def periodic(rng):
    out = []
    for _ in range(rng.randint(1, 4)):
        p = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33])
        unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(p)]
        out += (unit * 9)[: rng.randint(1, 6 * p)] + [rng.randrange(9) for _ in range(rng.randint(0, 3))]
    return out


def test_runs_against_brute_force():
    rng = random.Random(5)
    texts = [periodic(rng) for _ in range(250)] + [[rng.randrange(2) for _ in range(rng.randint(0, 200))] for _ in range(80)]
    texts += [[], [1], [1] * 23, [1] * 24, [0, 1] * 12, [1] * 500, ([0] * 7 + [1]) * 9, ([1, 1, 2] * 8 + [3]) * 4]
    assert found(texts) == [brute(x) for x in texts]
    assert any(len(brute(x)) > 1 for x in texts)
    assert found(texts[:120], least=1) == [brute(x, 1) for x in texts[:120]]
    assert found(texts[:120], least=60, times=4) == [brute(x, 60, 4) for x in texts[:120]]
    assert [found([x])[0] for x in texts[:60]] == [brute(x) for x in texts[:60]]


def test_long_runs_take_little():
    n = 300_000
    texts = [[7] * n, list(range(n)), list(range(70_000)) * 4, [i % 2 for i in range(n)]]
    assert found(texts) == [[(0, n, 1)], [], [(0, 280_000, 70_000)], [(0, n, 2)]]
    a, b = [0], [1]
    for _ in range(14):
        a, b = a + b, b + a
    assert found([a]) == [[]]


def digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    all_ = brute(words) if len(words) < 700 else found([np.unique(words, return_inverse=True)[1]])[0]
    gone = {i for s, m, q in all_ for i in range(s + q, s + m)}
    best = min(all_, key=lambda r: (-r[1] / r[2], r[0], r[2])) if all_ else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(all_), *best, None if not all_ else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in all_).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in load(spark, sf, "documents").collect()}
    got = [tuple(r) for r in op13_runs(spark, sf).collect()]
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got) > 5
    assert sorted(got) == sorted(digest(*x) for x in rows.items())


def test_edges(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (None, "a b " * 20, "x"), (4, "a b c é " * 9, "x"), (4, "a b c é " * 9, "x"), (40, "w " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()]
    assert out[:4] == [(1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 40, 2)], "a b")]
    assert out[4] == out[5] == (4, [], " ".join(["a b c é"] * 9)) and out[6] == (40, [(0, 200_000, 1)], "w")
    assert runs.find_runs(docs.withColumnRenamed("runs", "a").withColumnRenamed("doc_id", "runs"), "runs").columns == ["runs", "_runs", "collapsed"]
    assert runs.find_runs(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((digest(*r[:2]) if r[0] else (None, 1, 0, 40, 2, 20_000, *digest(1, rows[3][1])[-2:]) for r in rows), key=str)
