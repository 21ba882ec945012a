import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import mixing, packing
from skyloom.llm.common import load
from skyloom.llm.queries import op7_packing, tokenizer_path

DOCS = "doc_id long, text string, source string, target string, position double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "t", 0.5) for i, t, s in rows], DOCS)


def test_targets_and_positions(spark):
    rows = [(i, "w " * (1 + i % 7), "abcd"[i % 4] if i % 9 else None) for i in range(400)] + [(1000 + i, "w " * 40, "big") for i in range(300)] + [(1, None, "a"), (2, "", "zero"), (3, " \t", "zero"), (3, "w", None), (3, "w", None), (None, "x y", "a"), (7, "w " * 50_000, "long")]
    plan = mixing.plan_mix(frame(spark, rows)).collect()
    assert len(plan) == len(rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    sizes, targets, taken = {}, {}, Counter()
    key = {(r["source_size"], r["target"]) for r in plan}
    for r in plan:
        assert r["taken"] == r["size"] * len(r["positions"]) and len(r["positions"]) <= 3 and all(0 <= p <= 1 for p in r["positions"]) and sorted(r["positions"]) == r["positions"]
        assert r["target"] <= 3 * r["source_size"] + 1e-9
        taken[(r["source_size"], r["target"])] += r["taken"]
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += len((t or "").split())
    assert Counter(by.values()) == Counter(s for s, _ in key) and abs(sum(t for _, t in key) - total) < 1e-6 * total
    longest = defaultdict(int)
    for r in plan:
        longest[(r["source_size"], r["target"])] = max(longest[(r["source_size"], r["target"])], r["size"])
    assert all(abs(taken[k] - k[1]) <= longest[k] / 2 + 1e-6 for k in key), (sizes, targets)


def test_mix_is_the_same_again_and_in_order(spark, sf):
    docs = load(spark, sf, "documents")
    one = mixing.curriculum_mix(docs, 4)
    assert one.columns == docs.columns
    a = [r["doc_id"] for r in one.collect()]
    b = [r["doc_id"] for r in mixing.curriculum_mix(docs.repartition(5), 4).collect()]
    assert a == b and Counter(a) == {r["doc_id"]: len(r["positions"]) for r in mixing.plan_mix(docs).collect() if r["positions"]}
    order = [p for r in mixing.plan_mix(docs).collect() for p in r["positions"]]
    assert len(order) == len(a)
    assert mixing.curriculum_mix(docs.limit(0)).count() == 0 and mixing.plan_mix(docs.limit(0)).count() == 0


def test_schedules_shift_sources_in_time(spark):
    rows = [(i, "w w w", "abc"[i % 3]) for i in range(900)]
    plan = mixing.plan_mix(frame(spark, rows), keep=["source"]).collect()
    mean = {s: np.mean([p for r in plan if r["source"] == s for p in r["positions"]]) for s in "abc"}
    assert mean["a"] < 0.45 < mean["b"] < 0.55 < mean["c"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_patterns_hold_exactly_the_lengths(counts):
    patterns = packing.pack_histogram(counts, 64)
    held = Counter()
    for n, runs in patterns:
        assert n > 0 and sum(a * k for a, k in runs) <= 64
        for a, k in runs:
            held[a] += n * k
    assert held == counts
    whole = sum(a * k for a, k in counts.items())
    assert sum(n for n, _ in patterns) <= 2 * -(-whole // 64) + 1


def sequences(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_pieces_are_the_tokens(spark, sf):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] or "" for r in load(spark, sf, "documents").collect()}
    tokenizer, rows, own = Tokenizer.from_file(tokenizer_path()), op7_packing(spark, sf).collect(), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    assert own.keys() == docs.keys()
    for i, text in docs.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(own[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    n, total = sequences(rows), sum(r["length"] for r in rows)
    assert n <= -(-total // 4096) * 1.02 + 1


TEXTS = [None, "", " \n\t ", "Don't stop!! it's 'fine'...", "ÀÉ İstanbul ΣΑΣ ﬁ Å 한글 mixed字", "<|endoftext|> x<|startoftext|>", "a b c\x1cd", "word" * 4000, "tok " * 30_000, "é ño"]


def test_packing_edges(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(0, None, "s"), (None, "same", "s"), (None, "same", "s")]
    pieces = packing.pack_documents(frame(spark, rows), tokenizer_path(), with_ids=True).collect()
    sequences(pieces)
    got = defaultdict(bytes)
    for r in sorted(pieces, key=lambda r: (str(r["doc_id"]), r["start"])):
        got[r["doc_id"]] += bytes(r["ids"])
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in enumerate(TEXTS):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert got[i] == want * (2 if i == 0 else 1), text
    assert packing.pack_documents(frame(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    few = packing.WordEncoder(tokenizer_path())
    texts = [f"word{i % 37} other{i}, third{i * 7}!! the" for i in range(400)]
    got = [x for k in range(0, 400, 16) for x in few(texts[k : k + 16])]
    monkeypatch.undo()
    assert got == packing.WordEncoder(tokenizer_path())(texts) and len(few.known) < 400


def test_pipeline(spark, sf):
    docs = load(spark, sf, "documents")
    known = {r["doc_id"] for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf)
        now = now.persist()
        assert now.columns == docs.columns, name
        n, m = before.count(), now.count()
        assert 0 < m and (m <= n or name == "mixing"), name
        if name == "line dedup":
            assert m == n
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    sequences(last)
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in now.collect()} <= known
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, last))
    assert all(now.schema[f.name].dataType == f.dataType for f in docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near duplicates", "mixing", "packing"]


@pytest.mark.parametrize("k", range(4))
def test_stages_stand_empty_tables_and_odd_columns(spark, sf, k):
    docs = spark.createDataFrame([(1, None, "en", "a", 0, "x", "y"), (2, "one two three four five six", None, None, None, "x", "y"), (None, "", "en", "a", 0, "x", "y")], "doc_id long, text string, lang string, source string, n_chars long, hash string, position string")
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, docs, sf).columns == docs.columns and stage(spark, docs, sf).count() >= 0
    assert stage(spark, docs.limit(0), sf).count() == 0
