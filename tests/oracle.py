"""Compare a registered Spark query with its SQL twin on DuckDB."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if value != value else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, type(v).__name__, str(v)) for v in r])


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted(tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = cursor.fetchall()
    return sorted(names), _sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when both give the same columns, row count and values."""
    names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None
