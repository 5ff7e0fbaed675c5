"""Comparing a query with its SQL."""

import datetime
import decimal
import math

import duckdb

from packetlake.plans.bindings import TABLES


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "date": "DATE"}


def compare(df, relation):
    assert sorted(df.columns) == sorted(relation.columns), (df.columns, relation.columns)
    names = sorted(df.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert [(c, KINDS.get(dict(df.dtypes)[c])) for c in names] == [(c, kinds[c]) for c in names]
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    at = [relation.columns.index(c) for c in names]
    want = sorted(([plain(r[i]) for i in at] for r in relation.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
    return len(got)
