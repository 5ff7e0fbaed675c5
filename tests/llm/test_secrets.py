import hashlib
import re
from collections import Counter
from math import log2

import duckdb

from packetlake.llm.secrets import WINDOW, dense_windows, entropy_spans, op1_secret_scan, scan_secrets

ORDER = ["assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_base64url"]


def slow_base(text):
    out = []
    value = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, pattern in (("assign", value), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text or ""):
            if kind == "assign" and len(m[1]) >= 6 or kind == "access" and len(m[0]) >= 20 or kind == "hex" and len(m[0]) >= 24:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], ORDER.index(x[0])))


def write(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_whole_table_against_plain_patterns(spark):
    d = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    rows = op1_secret_scan(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = slow_base(texts[r.doc_id])
        count = Counter(k for k, _, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (count["assign"], count["access"], count["hex"])
        assert r.base_sha256 == hashlib.sha256(write(base).encode()).hexdigest()
        spans = [x.rsplit(":", 2) for x in r.spans.split(",") if x]
        assert [s for s in spans if s[0] in ORDER[:3]] == [[k, str(a), str(b)] for k, a, b in base]
        assert spans == sorted(spans, key=lambda s: (int(s[1]), ORDER.index(s[0])))


def test_entropy_windows_against_counting_each():
    run = "aaaaaaaaaaaaaaaaaaaaaaaaA9f3Kq0ZxT7bLm2WcV8eYnR5sJdU1hPgaaaaaaaaaaaaaaaaaaaaaaaaaaaa0f9e8d7c6b5a43210f1e"
    dense = set()
    for i in range(len(run) - WINDOW + 1):
        if -sum(c / WINDOW * log2(c / WINDOW) for c in Counter(run[i : i + WINDOW]).values()) >= 3.5 - 1e-9:
            dense |= set(range(i, i + WINDOW))
    assert {i for a, b in dense_windows(run, 3.5) for i in range(a, b)} == dense


def test_added_spans_and_allow_list():
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzKq01Aa"
    assert [s[0] for s in entropy_spans(f"aws {key} end", [])] == ["entropy_base64"]
    assert entropy_spans(f"aws {key} end", [("assign", 0, 50)]) == []
    for allowed in ("123e4567-e89b-12d3-a456-426614174000", "EXAMPLE" + key, "0123456789abcdef0123", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "unbeschreiblichkeitenverordnung", "some_long_snake_case_name_2"):
        assert entropy_spans(f"x {allowed} y", []) == [], allowed
    assert entropy_spans("9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B", [])[0][0] == "entropy_hex"


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdef"), (3, "secret=token:abcdefgh"), (3, "secret=token:abcdefgh"), (4, "é TOKEN = 'abc-123"), (5, "tokeN:abcde " * 3), (6, "ab" * 300_000), (7, "ſecret=abcdefg toKen=abcdefg")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, base string")
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.base]) for r in scan_secrets(docs).collect()), key=str)
    assert got == sorted(((d, slow_base(t)) for d, t in rows), key=str)
    assert scan_secrets(docs.limit(0)).count() == 0
