"""Every registered query of the engine against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from groundweave.plans import registry

SQL = registry.oracle_sql()


#: Queries that need full neighbourhoods of pixels, which the smallest tables don't have.
DENSE = {f"{kind}_{name}" for kind in ("rst", "pixels") for name in ("slope", "aspect", "tri", "tpi", "roughness", "convolve", "hillshade")}


@pytest.fixture(scope="module")
def duck(sf_dir):
    def connected(folder):
        made = duckdb.connect()
        for f in Path(folder).glob("*.parquet"):
            made.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        return made

    return {folder: connected(folder) for folder in (sf_dir, "/root/testdata/sf0.01")}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    folder = "/root/testdata/sf0.01" if name in DENSE else sf_dir
    got = registry.queries()[name](spark, folder).toPandas()
    assert len(got), "no rows: nothing is tested"
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck[folder].execute(SQL[name]).df()
    assert len(want)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
