"""Compare a Spark result with a DuckDB result: same columns, same rows in any order."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    mine, mine_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    theirs, their_rows = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if mine != theirs:
        return f"columns {mine} and {theirs}"
    if len(mine_rows) != len(their_rows):
        return f"{len(mine_rows)} and {len(their_rows)} rows"
    differing = [(a, b) for a, b in zip(mine_rows, their_rows) if a != b]
    if differing:
        a, b = differing[0]
        fields = [(c, x, y) for c, x, y in zip(mine, a, b) if x != y]
        return f"{len(differing)} rows differ, first: {a[:2]} {fields}"
    return None
