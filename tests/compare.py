"""Compare two pandas frames as sets of rows."""

import numpy as np
import pandas as pd


def plain(value):
    if isinstance(value, np.ndarray):
        return [plain(v) for v in value]
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return None
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    found = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False)]
    return sorted(found, key=lambda row: tuple((v is None, str(v)) for v in row))


def assert_same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, (sorted(left.columns), different[:3], len(different))
