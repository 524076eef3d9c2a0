"""Compares queries with their SQL on the smallest data."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        name, path = f.split(".")[0], f"{DATA}/{f}"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def differences(con, df, sql, path):
    """(columns equal, rows only in Spark's result, rows only in the SQL's), repeats counted."""
    df.write.mode("overwrite").parquet(path)
    con.execute(f"CREATE OR REPLACE TEMP TABLE wanted AS {sql}")
    names = [r[0] for r in con.execute("DESCRIBE wanted").fetchall()]
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    got, want = f"SELECT {cols} FROM read_parquet('{path}/*.parquet')", f"SELECT {cols} FROM wanted"
    if sorted(names) != sorted(df.columns):
        return False, -1, -1
    one = con.execute(f"SELECT count(*) FROM ({got} EXCEPT ALL {want})").fetchone()[0]
    two = con.execute(f"SELECT count(*) FROM ({want} EXCEPT ALL {got})").fetchone()[0]
    return True, one, two
