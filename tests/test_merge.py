import time

import numpy as np
import pytest

from tests import plain_merge
from tidemill.operators import merge


def made(seed, k, spread, sizes, whole=False):
    g = np.random.default_rng(seed)
    means = g.integers(0, k // 2, k).astype(float) if whole else g.normal(0, spread, k)
    return {int(x): merge.Group(int(n), float(m), float(n * g.gamma(2))) for x, n, m in zip(g.permutation(k), g.integers(*sizes, k), means, strict=True)}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("spread,sizes,whole", [(3.0, (2, 40), False), (0.3, (2, 400), False), (20.0, (1, 60), False), (1.0, (1, 30), True)])
def test_equals_all_pairs_in_all_rounds(seed, spread, sizes, whole):
    groups = made(seed, 16, spread, sizes, whole)
    left, to = merge.absorb_small(groups, 20)
    left0, to0 = plain_merge.absorb_small(groups, 20)
    assert to == to0 and left == left0
    after, to = merge.merge_alike(groups, 0.05)
    after0, to0 = plain_merge.merge_alike(groups, 0.05)
    assert to == to0 and set(after) == set(after0)


def test_groups_without_spread():
    groups = {3: merge.Group(5, 1.0, 0.0), 1: merge.Group(5, 1.0, 0.0), 2: merge.Group(5, 2.0, 0.0)}
    assert merge.merge_alike(groups, 0.05)[1] == plain_merge.merge_alike(groups, 0.05)[1] == {3: 1, 1: 1, 2: 2}
    assert merge.merge_alike({}, 0.05) == ({}, {}) and merge.absorb_small({}, 20) == ({}, {})


def test_twenty_thousand_labels():
    groups, start = made(1, 20_000, 30.0, (5, 60)), time.time()
    left, to = merge.merge_alike(merge.absorb_small(groups, 20)[0], 0.05)
    assert 1 < len(left) < 2000 and time.time() - start < 30
