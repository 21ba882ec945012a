import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyloom.llm import katz
from skyloom.llm.common import load
from skyloom.llm.queries import op11_backoff


class Plain:
    """The model, a probability at a time."""

    def __init__(self, texts):
        self.one, self.two, self.after = Counter(), Counter(), defaultdict(dict)
        for words in texts:
            for h, w in zip([" s", *words], [*words, " e"], strict=True):
                self.one[w] += 1
                self.two[h, w] += 1
        for (h, w), c in self.two.items():
            self.after[h][w] = c
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = self.discounts(self.one), self.discounts(self.two)
        self.freed = sum(c * (1 - self.d1.get(c, 1)) for c in self.one.values())
        self.back = {}

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        far = 6 * n[6] / n[1] if n[1] else 1
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - far) / (1 - far) if far < 1 and n[r] else 1 for r in range(1, 6)}
        return {r: x if 0 < x < 1 else 1 for r, x in d.items()}

    def single(self, w):
        whole = self.n if self.freed else self.n + 1
        return self.d1.get(self.one[w], 1) * self.one[w] / whole if w in self.one else (self.freed or 1) / whole

    def given(self, h, w):
        own = self.after.get(h)
        if not own:
            return self.single(w)
        if h not in self.back:
            freed = sum(c * (1 - self.d2.get(c, 1)) for c in own.values())
            whole = sum(own.values()) + (0 if freed else 1)
            self.back[h] = whole, (freed or 1) / whole / (1 - sum(map(self.single, own)))
        whole, weight = self.back[h]
        return self.d2.get(own[w], 1) * own[w] / whole if w in own else weight * self.single(w)

    def score(self, words):
        return sum(math.log10(self.given(h, w)) for h, w in zip([" s", *words], [*words, " e"], strict=True))

    def base(self, words):
        return sum(math.log10((self.one[w] + 1) / (self.n + self.v + 1)) for w in [*words, " e"])


def small(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"W{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    out = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 90])))) for i in range(150)]
    out += [(200, None), (201, ""), (202, "new words É é here"), (None, "w1 W2 w1"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (204, "w0 w1 " * 700)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"block": 50, "part": 40, "hot": 30}, {"block": 9, "part": 70, "hot": 3}])
def test_scores_against_plain_model(spark, rows, sizes):
    if sizes.get("block") == 9:
        rows = [r for r in rows if len(r[1] or "") < 90][:25]
    model = Plain([small(t) for i, t in rows if i is None or i % 7 != 2])
    for h in [" s", "w0", "w3", "w50", "never"]:
        assert abs(sum(model.given(h, w) for w in [*model.one, "never"]) - 1) < 1e-9
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = katz.score_texts(docs, docs.doc_id.isNull() | (docs.doc_id % 7 != 2), **sizes).collect()
    want = Counter((i, i is None or i % 7 != 2, len(small(t)) + 1, sum(w in model.one for w in [*small(t), " e"]), model.n, round(model.base(small(t)), 6), round(model.score(small(t)), 6)) for i, t in rows)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_edges(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, None)], "score string, text string")
    out = katz.score_texts(docs, docs.text == "none", "score")
    assert out.columns == ["score", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "_score"]
    assert sorted((r[0] or "", *r[1:5], r[6]) for r in out.collect()) == [("", False, 1, 0, 0, 0.0), ("a", False, 3, 0, 0, 0.0)]
    assert katz.score_texts(docs.limit(0), docs.text == "x", "score").count() == 0
    n = np.array([3, 2**40], np.int64)
    assert all((a == b).all() for a, b in zip(katz.unpacked(katz.packed(n, n[:0], n.astype(np.uint8))), (n, n[:0], n.astype(np.uint8)), strict=True))


def test_query(spark, sf):
    docs = load(spark, sf, "documents").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([small(r["text"]) for r in docs if not held(r["doc_id"])])
    got = {r["doc_id"]: r for r in op11_backoff(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        words, own = small(r["text"]), got[r["doc_id"]]
        assert own["held_out"] == held(r["doc_id"]) and own["n_tokens"] == len(words) + 1 and own["train_tokens"] == model.n
        assert own["n_known"] == sum(w in model.one for w in [*words, " e"]) and abs(own["base_score"] - model.base(words)) < 1e-6 * len(words) + 1e-6
        if len(words) < 3000:
            assert abs(own["score"] - model.score(words)) < 1e-6 * len(words) + 1e-6
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
