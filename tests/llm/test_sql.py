"""The operators that SQL can express, against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pytest

from admitflow.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=repr)
