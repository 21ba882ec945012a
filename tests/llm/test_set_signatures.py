import numpy as np

from skyloom.llm import shingles


def test_signatures_keep_all_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(5, 800))
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        keep = a[rng.random(len(a)) > rng.uniform(0, 0.1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 64, int(rng.integers(0, n // 10 + 1)), np.uint64, endpoint=False)]))
        differ = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(shingles.signature(a), shingles.signature(b), strict=True))
        assert differ <= len(np.setxor1d(a, b))
        if len(b) and shingles.similar(a, b):
            assert 9 * differ <= len(a) + len(b)
