import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from packetlake.llm.winnow import GRAM, WINDOW, edited_likeness, fingerprints, gram_hashes, op8_winnow_fingerprints, window_minima, winnow


def slow_minima(h, w):
    w = min(w, len(h))
    out = []
    for i in range(len(h) - w + 1 if w else 0):
        p = min(range(i, i + w), key=lambda j: (h[j], -j))
        if p not in out:
            out.append(p)
    return out


def test_minima_against_each_window():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 16, 17, 200):
        for high in (2, 5, 10**9):
            for w in (1, 3, 8, 13, 16):
                h = rng.integers(0, high, n).astype(np.uint64)
                assert window_minima(h, w).tolist() == slow_minima(h.tolist(), w)


def test_equal_grams_have_equal_hashes_wherever_they_stand():
    text = np.array([ord(c) for c in "abcdefghijklmnopqrstuvwxyz" * 40], np.uint32)
    h = gram_hashes(text)
    assert all(len(set(h[i::26])) == 1 for i in range(26)) and len(set(h)) == 26


def test_guaranteed_match():
    rng = random.Random(2)
    letters = "abcdefgh éßλ"
    for _ in range(50):
        shared = "".join(rng.choices(letters, k=GRAM + WINDOW - 1))
        one, two = ("".join(rng.choices(letters, k=rng.randrange(90))) + shared + "".join(rng.choices(letters, k=rng.randrange(90))) for _ in range(2))
        assert set(winnow(one)[1]) & set(winnow(two)[1])


def slow(rows):
    order = sorted(rows, key=lambda x: -x[0])
    out = []
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        n = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest(), t[: len(t) - n] + following[:n], following))
    return out


def near(a, b):
    a, b = set(winnow(a)[1].tolist()), set(winnow(b)[1].tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_whole_table_against_plain_walk(spark):
    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in op8_winnow_fingerprints(spark, d).collect()}
    texts = dict(rows)
    assert len(got) == len(rows)
    for doc, n, sha, edited, following in slow(rows):
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near(texts[doc], edited)) < 1e-12 and abs(r.near_next - near(texts[doc], following)) < 1e-12
    assert len({r.fingerprint for r in got.values()}) == len({winnow(t)[1].tobytes() + winnow(t)[0].tobytes() for t in texts.values()})


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (3, "ab"), (7, "é" * 31), (9, "xyz " * 100_000), (None, "last one")]
    docs = spark.createDataFrame([(d, t, "o") for d, t in rows], "doc_id long, text string, order string")
    got = edited_likeness(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert by[9].edited_sha256 == hashlib.sha256(("xyz " * 50_000 + "é" * 31).encode()).hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(b"last" + b"xyz ").hexdigest()
    assert by[1].near_edited == 1.0 and by[1].near_next == 0.0 and by[2].near_next == 1.0
    assert [r.near_next for r in got if r.doc_id == 3].count(1.0) == 1
    assert edited_likeness(docs.limit(0)).count() == 0
    one = edited_likeness(docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0 and one.n_chars == 31
    kept = {r.doc_id: r for r in fingerprints(docs.where(F.col("doc_id") < 8)).collect()}
    assert kept[1].hashes == [] and kept[7].positions == sorted(kept[7].positions)
