"""The driver's contract: every query has columns as its SQL, and the small tables agree."""

import duckdb
import pytest

import __spark_entry__ as entry
from touchline.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, (str, bool)) else int(v) for v in r))
    return sorted(out, key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["run_id", "type", "frame", "match_time", "player_id", "team", "outcome"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in ("orders", "nation", "lineitem", "embeddings", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = plain(df.select(*columns).collect())
    if name not in ORACLE_SQL:  # held against plain versions in tests of their own
        assert rows
        return
    assert rows == plain(db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
