"""Compares a query with its DuckDB SQL: rows, columns and values."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    text = pdf[cols].apply(lambda c: c.map(lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v).removesuffix(" 00:00:00")))
    return cols, sorted(map(tuple, text.values.tolist()))


def differences(df, con, sql):
    a, b = df.toPandas(), con.execute(sql).df()
    (ca, ra), (cb, rb) = rows(a), rows(b)
    if ca != cb:
        return f"columns {ca} and {cb}"
    kinds = [(c, str(a[c].dtype), str(b[c].dtype)) for c in ca if str(a[c].dtype) != str(b[c].dtype) and len(a) and "datetime" not in str(b[c].dtype) and not a[c].isna().any()]
    if len(ra) != len(rb):
        return f"{len(ra)} and {len(rb)} rows"
    bad = [(x, y) for x, y in zip(ra, rb, strict=True) if x != y]
    return f"{len(bad)} of {len(ra)} rows differ: {bad[:2]} {kinds}" if bad else ("types " + str(kinds) if kinds else "")
