"""Queries on tables without whole windows, or without windows to fit on, against their DuckDB SQL."""

import duckdb
import pytest

from tests.conftest import DATA
from tests.test_oracles import plain
from tidemark.oracles import ORACLES
from tidemark.queries import QUERIES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """tied: each reading twice, so that the median lag is 0. odd: no healthy windows with whole lags, but others."""
    out = tmp_path_factory.mktemp("tables")
    spans = [("2024-01-04 00:00", 5), ("2024-01-05 00:00", 5), ("2024-01-24 20:00", 18), ("2024-01-30 00:00", 5)]
    kept = " OR ".join(f"(ts >= TIMESTAMP '{t}' AND ts < TIMESTAMP '{t}' + INTERVAL {h} HOURS)" for t, h in spans)
    for name, rows in (("tied", f"SELECT e.* REPLACE (event_id * 2 + k AS event_id) FROM '{DATA}/sf0.001/events.parquet' e, range(2) r(k)"), ("odd", f"SELECT * FROM '{DATA}/sf0.01/events.parquet' WHERE {kept}")):
        (out / name).mkdir()
        duckdb.sql(f"COPY ({rows}) TO '{out / name}/events.parquet' (FORMAT parquet)")
    return out


def both(spark, folder, name):
    df = QUERIES[name](spark, str(folder))
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    return ours, sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())


@pytest.mark.parametrize(("table", "name"), [("tied", "a30_pivot"), ("tied", "a39_describe_scores"), ("tied", "ev8_sweep"), ("tied", "j5_failure_rows"), ("odd", "m8_forecast_residual"), ("odd", "ev12_scorers")])
def test_query_equals_oracle_without_windows(spark, tables, table, name):
    ours, theirs = both(spark, tables / table, name)
    assert ours == theirs and ours


@pytest.mark.parametrize("name", ["ev12_tree_scorers", "m9_anchored_residual"])
def test_nothing_to_fit_gives_no_rows(spark, tables, name):
    assert QUERIES[name](spark, str(tables / "tied")).collect() == []
