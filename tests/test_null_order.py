"""Rows without a place in time come last, as in the SQL."""

import datetime

import duckdb

from loomwork.plans import registry


def both(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    cur = con.execute(registry.ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in got.columns]
    return sorted(map(tuple, got.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def test_duplicate_guards(spark, tmp_path):
    turns = [(1, 0, "user", "I like 3 cats."), (1, 1, "user", "I like 3 cats."), (1, None, "user", "I do not like 4 cats."), (2, None, "user", None), (2, 5, "user", "It is 7.")]
    got, want = both(spark, tmp_path, "duplicate_guards", conversations=(turns, "conv_id long, turn long, role string, text string"))
    assert len(want) == 3 and got == want


def test_consent_gate(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = [(1, at, 7, "view", 900.0), (2, None, 7, "view", 600.0), (3, at + datetime.timedelta(1), 7, "view", 50.0), (None, at, 7, "click", 45.0)]
    got, want = both(
        spark, tmp_path, "consent_gate", events=(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
        customer=([(7, 1.0)], "c_custkey long, c_acctbal double"),
    )
    assert ("over_budget" in {v for _, v in want}) and got == want
