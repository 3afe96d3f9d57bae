"""Each registered query against its SQL in DuckDB, at the smallest scale."""

import math
import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from quillon.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{float(value):.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def results(spark):
    """Every query's columns and rows, or its error; several queries run at a time, as most are many small jobs."""

    def run(name):
        try:
            df = QUERIES[name](spark, SF)
            return df.columns, df.collect()
        except Exception as error:  # raised by the test of that name
            return error

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(sorted(QUERIES), pool.map(run, sorted(QUERIES)), strict=True))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, duck, name):
    if isinstance(results[name], Exception):
        raise results[name]
    columns, rows = results[name]
    mine = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows)
    if name not in ORACLE_SQL:
        return
    told = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in sorted(names)]
    assert mine == sorted(tuple(plain(row[i]) for i in order) for row in told.fetchall())
