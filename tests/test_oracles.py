"""Engine queries against their DuckDB SQL."""

import math

import duckdb
import pytest

from tests.conftest import DATA
from tidemark.oracles import ORACLES
from tidemark.queries import QUERIES

SF = f"{DATA}/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    try:
        v = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cur.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
