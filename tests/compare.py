"""Compare a Spark result with DuckDB's, whatever the order of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def key(row):
    return [(v is not None, str(float(v)) if isinstance(v, (int, float)) else str(v)) for v in row]


def assert_same(df, c, sql):
    result = c.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = sorted((tuple(norm(r[names.index(k)]) for k in columns) for r in result.fetchall()), key=key)
    got = sorted((tuple(norm(r[k]) for k in columns) for r in df.collect()), key=key)
    assert got == want
