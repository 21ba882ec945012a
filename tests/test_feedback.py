"""Versions of a model by a stream in several runs, against one batch and a plain loop."""

import random

import pytest

from skyloom.streaming import feedback

ROW = "source string, seq long, score double, is_interesting boolean"


def looped(rows):
    """Each key's versions, one answer after the other."""
    out, own = {}, {}
    for source, _, score, good in sorted(rows, key=lambda r: r[1]):
        if score is None or good is None:
            continue
        seen = own.setdefault(source, {"rows": [], "since": 0})
        seen["rows"].append((score, good))
        seen["since"] += 1
        p, n = ([s for s, g in seen["rows"] if g is k] for k in (True, False))
        if seen["since"] >= 10 and len(p) >= 5 and len(n) >= 5:
            seen["since"] = 0
            out.setdefault(source, []).append((len(p), len(n), (sum(p) / len(p) + sum(n) / len(n)) / 2))
    return out


def answers(count=400):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i * 1000, rng.random(), rng.random() < 0.3) for i in range(count)]
    return [*rows, ("late", 9_000_000, 0.5, True), ("hot", 9_000_001, None, True), ("b", 9_000_002, 0.1, None)]


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.version):
        out.setdefault(r.source, []).append((r.n_pos, r.n_neg, pytest.approx(r.threshold)))
        assert r.version == len(out[r.source])
    return out


def test_versions_of_a_batch(spark):
    rows = answers()
    found, after = feedback.versions(spark.createDataFrame(rows, ROW), ["source"])
    assert told(found) == looped(rows)
    assert {r.source: r.first for r in after.collect()}["late"] is None
    none, _ = feedback.versions(spark.createDataFrame([], ROW), ["source"])
    assert none.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = answers()
    incoming, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(0, len(rows), 90):
        spark.createDataFrame(rows[i : i + 90], ROW).coalesce(1).write.mode("append").parquet(incoming)
        if i in (90, 360):  # a run takes what has come so far, the next one goes on from its state
            feedback.retrain(spark.readStream.schema(ROW).parquet(incoming), ["source"], folder)
    assert told(feedback.models(spark, folder)) == looped(rows)
    best = {r.source: r.version for r in feedback.latest(feedback.models(spark, folder), ["source"]).collect()}
    assert best == {k: len(v) for k, v in looped(rows).items()}
