"""Runs a query and its SQL side by side."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    plain = frame[cols].astype(object)
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  pandas turns integers with nulls to floats
    return sorted(repr([whole(v) for v in row]) for row in plain.where(frame[cols].notna(), None).values.tolist())


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
