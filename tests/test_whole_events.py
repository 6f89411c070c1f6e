"""Queries that judge the scopes of all users, against their SQL."""

import datetime

import duckdb
import pytest

from tidemark.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    days = [(day, user, kind) for day in (1, 2, 3) for user in (0, 7, 9) for kind in ("view", "buy")]
    days += [(3, 7, "view")] * 4 + [(3, 9, "view"), (3, 9, "buy"), (2, None, "view")]
    rows = [(i, at(day, i % 24), user, kind, 1.5, "{}") for i, (day, user, kind) in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["signal_owners", "scoped_values"])
def test_all_users_count(spark, events, name):
    got = QUERIES[name](spark, events)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/events.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = {tuple(r[c] for c in columns) for r in got.collect()}
    assert sorted(columns) == sorted(got.columns) and rows == set(want.fetchall())
    if name == "signal_owners":
        assert {r[columns.index("owner")] for r in rows if r[columns.index("run")] == "2024-01-03" and r[columns.index("user_id")] == 7} == {"view"}
    else:
        assert {r[columns.index("scope_id")] for r in rows} == {0, 7, 9, None}
