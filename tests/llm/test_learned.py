import math
import random
from collections import Counter

import numpy as np

from skyloom.llm import langid, quality
from skyloom.llm.common import load
from skyloom.llm.queries import op3_language, op4_quality


def parse(sample, text):
    """Phrases of a greedy parse of symbols into substrings of sample."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def squeezed(text):
    read = "".join(x if x.isalpha() else " " for x in text)
    while "  " in read:
        read = read.replace("  ", " ")
    return read


def normal(text, sample):
    """text as the parser reads it: blanks for anything but letters, NUL for letters that sample lacks."""
    return "".join(x if x == " " or x in sample else "\0" for x in squeezed(text))


def check_phrases(sample, texts):
    clean = squeezed(sample)
    model = langid.Automaton(sample)
    points = [langid.code_points(x) for x in texts]
    got, sizes = langid.phrases(model, np.concatenate(points), np.cumsum([len(x) for x in points]))
    for text, c, n in zip(texts, got.tolist(), sizes.tolist(), strict=True):
        read = normal(text, clean)
        assert (c, n) == (parse(clean, read), len(read)), (text[:80], c)


def test_phrases_against_brute_force():
    rng = random.Random(2)
    sample = "".join(rng.choice("abc d") for _ in range(400))
    check_phrases(sample, ["a", "xyz", "xax", "aax xb", "".join(rng.choice("abc d!x") for _ in range(200)), sample[50:250]])
    for _ in range(20):
        check_phrases(sample, ["".join(rng.choice("abcdxy !é") for _ in range(rng.randint(1, 1500))) for _ in range(5)])


def test_phrases_of_long_texts_and_large_alphabets():
    rng = random.Random(3)
    ideographs = "".join(chr(0x4E00 + rng.randrange(1500)) for _ in range(6000))
    check_phrases(ideographs, [ideographs[1000:3000], ideographs[:700] + "\u9fa0" + ideographs[5:900], "".join(rng.sample(ideographs, 900))])
    sample = "".join(rng.choice("ab ") for _ in range(3000))
    check_phrases(sample, [sample, sample[7:2990] * 2, "ab" * 1500, "a" * 3000, "".join(rng.choice("ab ") for _ in range(5000))])


def test_predictions_against_brute_force(spark):
    rng = random.Random(6)
    words = {"x": ["abra", "cada", "bra"], "y": ["cadab", "rara", "dab"], "z": ["żółć", "abra", "łka"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 300))), k if i % 5 else None) for i in range(60) for k in [rng.choice("xyz")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(docs, docs.doc_id % 4 != 2, "doc_id", "text", "lang", rows=3, row_chars=400)
    whole = {t for i, t, k in rows if k and i % 4 != 2 and len(t) <= 400}
    assert set(samples) == {"x", "y", "z"} and all(any(t in s for t in whole) for s in samples.values())

    def rate(text, sample):
        clean = squeezed(sample)
        read = normal(text.lower(), clean)
        return parse(clean, read) * math.log2(len(clean) + 2) / len(read)

    for r in langid.predict(docs, samples).collect():
        rates = sorted((rate(rows[r["doc_id"]][1], s), k) for k, s in samples.items())
        assert r["lang_pred"] == rates[0][1] and abs(r["score"] - (1 - rates[0][0] / rates[1][0])) < 1e-9


def test_language_accuracy_and_edges(spark, sf):
    sf = sf.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in load(spark, sf, "documents").select("doc_id", "lang").collect()}
    rows = op3_language(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 200
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 34"), (None, "the and the"), (5, "ж" * 300), (6, "der die das " * 20_000), (6, "der")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, {"de": "der die und das", "en": "the and of the"}).collect()]
    assert got[:4] == [(1, "und"), (2, "und"), (3, "und"), (None, "en")] and got[5:] == [(6, "de"), (6, "de")]
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(docs.limit(0), {"de": "der"}).count() == 0


def test_quality_accuracy_and_edges(spark, sf):
    sf = sf.replace("0.001", "0.1")
    truth = {r["doc_id"]: r["quality"] for r in load(spark, sf, "labels").collect()}
    rows = op4_quality(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    good = Counter((truth[r["doc_id"]], r["predicted"]) for r in held)
    assert good[1, 1] / (good[1, 1] + good[1, 0]) > 0.97 and good[0, 0] / (good[0, 0] + good[0, 1]) > 0.85, good
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, " \n", "c"), (4, "word " * 50_000, "d"), (4, "é", "e")], "doc_id long, text string, score string")
    model = quality.fit(np.random.default_rng(0).normal(size=(300, len(quality.FEATURES))), (np.arange(300) % 2).astype(float), rounds=5, pair_rounds=5)
    out = quality.score(docs, model).collect()
    assert [r["doc_id"] for r in out] == [1, 2, None, 4, 4] and all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in out)
    assert {r["score"] for r in quality.score(docs, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect()} == {0.5}
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.9
