"""Every query beside its DuckDB twin, on the smallest tables."""

from __future__ import annotations

import pytest

from millrace.plans import registry

from .conftest import DATA, rows_of

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        got, want = (f.astype({c: float for c in columns if f[c].dtype.kind in "iuf"}) for f in (got, want))
        assert rows_of(got, columns) == rows_of(want, columns)
