"""Every registered query against its oracle, or at least to the end."""

from __future__ import annotations

import math

import pytest

from hostvigil.plans import all as _all  # noqa: F401
from hostvigil.registry import ORACLES, QUERIES


def plain(frame) -> list[str]:
    def value(x):
        if x is None or x != x:
            return None
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb":
            return float(x) if math.isfinite(float(x)) else str(x)
        return str(x)

    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted(str(tuple(map(value, r))) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
