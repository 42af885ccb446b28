"""Common blocks of long texts take time in proportion to them, and are those of the plain recursion."""

import random
import time

import numpy as np
import pytest
from isogloss.operators import pairs


def plain(a, b, i0, i1, j0, j1):
    best, at = 0, None
    for i in range(i0, i1):
        for j in range(j0, j1):
            n = 0
            while i + n < i1 and j + n < j1 and a[i + n] == b[j + n]:
                n += 1
            if n > best:
                best, at = n, (i, j)
    if not best:
        return []
    i, j = at
    return [*plain(a, b, i0, i, j0, j), (i, j, best), *plain(a, b, i + best, i1, j + best, j1)]


@pytest.mark.parametrize("small", [0, 30, 512])
def test_blocks(monkeypatch, small):
    monkeypatch.setattr(pairs, "SMALL", small)
    rng = random.Random(small)
    for k in range(600):
        v = rng.choice([1, 2, 3, 8])
        a = [rng.randrange(v) for _ in range(rng.randrange(30))]
        b = [rng.randrange(v) for _ in range(rng.randrange(30))] if k % 2 else [x if rng.random() > 0.2 else rng.randrange(v + 2) for x in a]
        assert pairs.common_blocks(np.array(a, np.int64), np.array(b, np.int64)) == plain(a, b, 0, len(a), 0, len(b))


def test_long_texts():
    """20,000 tokens with 5,000 blocks; each block looked at all pairs of tokens of its part."""
    rng = random.Random(1)
    a = np.array([min(int(rng.paretovariate(0.9)), 3000) for _ in range(20_000)])
    b = np.where(a <= 1, 4000, a)
    t = time.process_time()
    found = pairs.common_blocks(a, b)
    assert time.process_time() - t < 10
    assert all(i == j for i, j, _ in found) and sum(n for *_, n in found) == int((a == b).sum())
