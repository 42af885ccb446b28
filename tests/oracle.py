"""Compare a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: "<null>" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(map(tuple, df.values.tolist())), list(df.columns)


def assert_same(spark, con, f, sql, sf):
    got, exp = canonical(f(spark, sf).toPandas()), canonical(con.execute(sql).df())
    assert got[1] == exp[1]
    assert len(got[0]) == len(exp[0])
    assert got[0] == exp[0]
