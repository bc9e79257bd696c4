"""Side by side: a Spark query and its DuckDB SQL on the same Parquet files."""

import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return value if isinstance(value, bool | str) else round(value, 4) if isinstance(value, float) else str(value)


def rows(dicts):
    return sorted(repr(sorted((k, plain(v)) for k, v in r.items())) for r in dicts)


def expected(con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return rows(dict(zip(names, r, strict=True)) for r in cursor.fetchall())


def found(frame):
    return rows(r.asDict() for r in frame.collect())
