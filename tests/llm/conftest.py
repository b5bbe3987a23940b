from __future__ import annotations

import datetime

import numpy as np
import pytest

DAY = datetime.datetime(2025, 1, 1)


@pytest.fixture
def at():
    return lambda n: DAY + datetime.timedelta(days=n)


@pytest.fixture
def crowd():
    """Vectors of 30 values: tight groups, a chain, singles; ids and rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 8, (12, 30))
    x = np.vstack([
        np.repeat(centres[:4], [300, 90, 20, 2], axis=0) + rng.normal(0, 0.06, (412, 30)),
        centres[4] + np.outer(np.arange(40) * 1.2, np.eye(30)[0]),
        rng.normal(0, 9, (150, 30)),
    ]).astype(np.float32)
    ids = rng.permutation(5000)[: len(x)] + 10
    return ids, x
