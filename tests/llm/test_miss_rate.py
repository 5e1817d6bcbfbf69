"""Near dedup misses next to no link, whatever its threshold."""

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from cataloom.llm import near_dedup as module


def missed(threshold, coordinates=module.COORDINATES):
    p = threshold / 100
    return sum(comb(coordinates, k) * p**k * (1 - p)**(coordinates - k) for k in range(module.least_matches(threshold)))


def test_links_at_the_threshold_are_seldom_missed():
    assert (module.least_matches(80), module.least_matches(85)) == (35, 40)
    assert all(missed(t) < 3e-6 for t in range(80, 101))


@pytest.mark.parametrize("matches", [35, 40])
def test_pairs_that_collide_least(matches):
    x, far = np.arange(64, dtype=np.uint32), np.arange(100, 164, dtype=np.uint32)
    just, less = (np.where(np.arange(64) < k, x, far + 100) for k in (matches, matches - 1))
    sigs = [s.astype(np.uint32).tobytes() for s in (just, less)]
    batch = pa.RecordBatch.from_pydict({"a": [1, 2], "b": [3, 3], "sig": sigs, "pivot_sig": [x.tobytes()] * 2})
    assert [b.to_pylist() for b in module._colliding(matches)([batch])] == [[{"a": 1, "b": 3}]]
    rows = pd.DataFrame({"token": [5, 5, 5], "rep": [1, 2, 3], "group": [1, 2, 3], "sig": [*sigs, x.tobytes()]})
    found = {frozenset(p) for p in module._collide(matches)(rows).itertuples(index=False)}
    assert frozenset((1, 3)) in found and frozenset((2, 3)) not in found
