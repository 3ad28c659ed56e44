"""Every query against the SQL that describes it."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from shelfmark.bindings import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    relation = duck.sql(ORACLES[name])
    assert list(relation.columns) == df.columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    quoted = ", ".join(f'"{c}"' for c in names)
    want = duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    want = [tuple(map(_plain, r)) for r in want]
    assert len(got) == len(want)
    got, want = sorted(got, key=_key), sorted(want, key=_key)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, (len(wrong), [str(p)[:600] for p in wrong[:3]])
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
