import math
from collections import Counter

import duckdb
import pytest

from packetlake.llm.mixing import ORACLE, mix, op4_mix_sources, source_rates

DOCS = "doc_id long, text string, source string"


def test_whole_table_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = c.sql(ORACLE)
    got = op4_mix_sources(spark, d)
    assert sorted(want.columns) == sorted(got.columns)
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert sorted(rows) == sorted(want.fetchall())
    keys = [r[want.columns.index("shuffle_key")] for r in rows]
    assert keys == sorted(keys)  # over all partitions


def test_shares_approach_targets(spark):
    rows = [(i, "t", "big" if i % 10 else "small") for i in range(20_000)]
    docs = spark.createDataFrame(rows, DOCS)
    n = Counter(r.source for r in mix(docs, {"big": 0.5, "small": 0.5}, epochs=1.5).select("source").collect())
    assert all(abs(n[s] - 15_000) < 5 * math.sqrt(15_000) for s in n)
    copies = Counter(Counter(r.doc_id for r in mix(docs, {"big": 0.5, "small": 0.5}, epochs=1.5).where("source = 'small'").select("doc_id").collect()).values())
    for k in range(4, 11):
        p = math.exp(-7.5) * 7.5**k / math.factorial(k)
        assert abs(copies[k] - 2000 * p) < 5 * math.sqrt(2000 * p)


def test_rates(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, "", "a"), (3, "", "b"), (4, "", None)], DOCS)
    assert {r.source: r.rate for r in source_rates(docs, {"a": 0.5}, 1.0, 2.0).collect()} == pytest.approx({"a": 2.0, "b": 2.0, None: 2.0})
    assert {r.source: r.rate for r in source_rates(docs, {"a": 3, "b": 1, "c": 0}, 1.0).collect()} == pytest.approx({"a": 4 * 0.75 / 2, "b": 1.0, None: 0.0})
    with pytest.raises(ValueError):
        source_rates(docs, {"a": -1.0})


def test_large_rates_and_edges_of_the_input(spark):
    rows = [(1, None, None), (2, "", "s"), (2, "", "s"), (None, "x" * 100_000, "s"), (None, "other", "s")]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], DOCS + ", copy int, _key int")
    got = mix(docs, {"s": 1.0}, epochs=1000.0).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "copy", "_key", "_copy", "shuffle_key"}
    assert all(r.copy == 5 for r in got)
    n = Counter((r.doc_id, len(r.text)) for r in got)
    assert (1, 0) not in n and n[2, 0] % 2 == 0
    assert all(abs(n[k] / (2 if k == (2, 0) else 1) - 1250) < 6 * math.sqrt(1250) for k in n) and len(n) == 3
    assert mix(docs.limit(0)).count() == 0
