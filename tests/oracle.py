"""Compares a registered query with its SQL in DuckDB, as multisets of rows."""

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr([plain(r[i]) if not isinstance(r[i], int) or isinstance(r[i], bool) else float(r[i]) for i in order]) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = df.collect()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    expected = rel.fetchall()
    assert sorted(df.columns) == sorted(names), name
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    assert a == b, (name, list((a - b).items())[:3], list((b - a).items())[:3])
    return got
