"""Every query that has SQL, against DuckDB on the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from spindrel.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.6f}".rstrip("0").rstrip(".")
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return "null" if x is None else str(x)


def rows(found, names):
    return sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(got, df.columns) == rows(want.fetchall(), columns)
