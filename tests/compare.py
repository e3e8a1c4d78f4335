"""A query against its SQL in DuckDB."""

from pathlib import Path

import duckdb


def rows(columns, values):
    plain = lambda v: None if v is None or v != v else v
    return sorted((tuple(plain(v) for v in r) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    theirs = [tuple(r[names.index(c)] for c in order) for r in got.fetchall()]
    assert rows(order, [tuple(r[c] for c in order) for r in df.collect()]) == rows(order, theirs)
