"""Holds a query's rows against those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table) -> list[str]:
    names = sorted(table.schema.names)
    return sorted(map(repr, zip(*(table.column(c).to_pylist() for c in names))))


def same(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert rows(got) == rows(want)
