"""Row-by-row comparison of a Spark result with DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(tidy(row[i]) for i in order) for row in rows), key=repr)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) == len(got)
    for w, g in zip(want, got):
        for x, y in zip(w, g):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                assert math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-5), (w, g)
            else:
                assert x == y, (w, g)
