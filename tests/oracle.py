"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same_rows(ours, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = pd.DataFrame(cursor.fetchall(), columns=names)
    columns = sorted(ours.columns)
    assert columns == sorted(names)
    rows = [tuple(r) for r in ours.select(*columns).collect()]
    wanted = [tuple(r) for r in theirs[columns].astype(object).itertuples(index=False)]
    assert len(rows) == len(wanted)

    def plain(row: tuple) -> tuple:
        return tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x for x in row)

    key = lambda r: tuple((x is None, str(type(x).__name__ == "str"), str(x)) for x in r)
    different = [(a, b) for a, b in zip(sorted(map(plain, rows), key=key), sorted(map(plain, wanted), key=key), strict=True) if a != b]
    assert not different, different[:3]
