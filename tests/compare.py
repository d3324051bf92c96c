"""Rows of a query against those of its SQL, as text, whatever the order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        x = frame[c]
        if str(x.dtype).startswith("datetime"):
            frame[c] = x.astype("datetime64[us]").astype(str)
        elif x.dtype == object or str(x.dtype) in ("bool", "str", "string"):
            frame[c] = x.map(lambda v: "None" if v is None or v is pd.NaT or v is pd.NA or v != v else str(v))
        else:
            frame[c] = x.map(lambda v: "None" if pd.isna(v) else f"{float(v):.9g}")
    return sorted(map(tuple, frame.astype(object).map(str).values.tolist()))
