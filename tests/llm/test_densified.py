"""Sketches of very small sets estimate their similarity."""

import numpy as np

from jobtrail.llm import near_dedup


def test_small_sets_meet_as_often_as_they_are_similar():
    rng = np.random.default_rng(4)
    same = []
    for _ in range(600):
        h = rng.integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2)
        same.append((near_dedup.densified(np.sort(h)) == near_dedup.densified(np.sort(h[1:]))).mean())
    assert abs(np.mean(same) - 0.8) < 0.03  # 5 and 4 shingles
    assert len(set(near_dedup.densified(h[:1]).tolist())) == 1
