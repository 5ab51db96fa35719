"""Every registered query of the catalogue against its SQL in DuckDB, on the driver's tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from windlass.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    """A value as both engines can say it: floats to six places, nested values as tuples."""
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.5f}".replace("-0.00000", "0.00000")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return str(x)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    made = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    wanted = canonical(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(made) == len(wanted)
    assert made == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE)))
def test_other_queries_return_rows(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0
