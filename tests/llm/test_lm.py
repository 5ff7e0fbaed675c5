import math
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetlake.llm import lm
from packetlake.llm.common import remainder
from packetlake.llm.lm import CONTEXT, EDGE, KEY, STEP, WIDTH, WINDOW, Attention, classes, cut_windows, lines_of, op7_lm_score, places, score, score_texts


def small(seed=0, n=40, k=7):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 1000, n)
    m = Attention(counts, rng.standard_normal((n, WIDTH)).astype(np.float32), np.arange(n) % k, rng.integers(0, 50, (k, k)).astype(float), seed)
    for name, w in m.weights.items():
        m.weights[name] = w + rng.standard_normal(w.shape).astype(np.float32) * np.float32(0.3)
    return m


def line_power(x):
    """2**x between whole x by straight lines."""
    return 2.0 ** math.floor(x) * (1 + x - math.floor(x))


def slow_log(m, window, target):
    """log10 of the probability of ``target`` after the last id of ``window``, step by step."""
    w = {k: v.astype(float) for k, v in m.weights.items()}
    x = m.place[window] + w["position"][: len(window)]
    parts = x @ w["project"]
    ask, answer, value, own = parts[-1, :KEY], parts[:, KEY : 2 * KEY], parts[:, 2 * KEY : -WIDTH], parts[-1, -WIDTH:]
    p = np.array([line_power(a @ ask / math.sqrt(KEY)) for a in answer])
    h = (p / p.sum()) @ value + own
    h = h / (1 + np.abs(h))
    follow = (m.follow[m.of[window[-1]]].astype(float) - float(lm.ZERO)) / lm.UNIT
    odds = np.array([line_power(z) for z in follow + h @ w["out"]])
    of = m.of[target]
    return math.log10(odds[of] / odds.sum()) + m.share[target] * math.log10(2)


def test_scores_against_each_position_alone(monkeypatch):
    monkeypatch.setattr(lm, "EDGE", 39)
    monkeypatch.setattr(lm, "HELD", 2 * STEP)
    m = small()
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 39, n).astype(np.int32) for n in (0, 1, STEP - 1, STEP, STEP + 1, 5 * STEP + 5)]
    for text, got in zip(texts, score_texts(m, texts), strict=True):
        line = [39] * (CONTEXT + 1) + text.tolist() + [39]
        want = 0.0
        for i in range(len(text) + 1):
            start = i // STEP * STEP
            want += slow_log(m, line[start : i + CONTEXT + 1], line[i + CONTEXT + 1])
        assert got == pytest.approx(want, rel=1e-4)


def test_windows_hold_each_target_once(monkeypatch):
    monkeypatch.setattr(lm, "HELD", 2 * STEP)
    texts = [np.arange(n, dtype=np.int32) + 7 for n in (0, 5, 24, 100)]
    for t in texts:
        windows, targets, counted, _ = cut_windows(lines_of(t))
        assert windows.shape[1] == WINDOW and targets[counted].tolist() == [*t.tolist(), EDGE]


def test_probabilities_sum_to_one():
    windows = np.random.default_rng(3).integers(0, 40, (2, WINDOW))
    every = np.exp2([small().log_probabilities(windows, np.full((2, STEP), i)) for i in range(40)])
    assert np.allclose(every.sum(axis=0), 1, atol=1e-4)


def test_gradients_against_differences():
    m = small(4)
    rng = np.random.default_rng(5)
    windows, targets, counted = rng.integers(0, 40, (3, WINDOW)), rng.integers(0, 40, (3, STEP)), rng.random((3, STEP)) < 0.7
    loss = lambda: -math.log(2) * float(np.where(counted, m.log_probabilities(windows, targets), 0).sum(dtype=float) / counted.sum())
    for k, g in m.gradients(windows, targets, counted).items():
        w = m.weights[k] = m.weights[k].astype(np.float64)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in g.shape)
            before = w[at]
            w[at] = before + 1e-3
            up = loss()
            w[at] = before - 1e-3
            down = loss()
            w[at] = before
            assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=1e-3), (k, at)


def test_a_step_asks_for_little_memory():
    """Batches write to the same arrays, and only scored positions are projected."""
    m = small()
    rng = np.random.default_rng(6)
    windows, targets, counted = rng.integers(0, 40, (128, WINDOW)), rng.integers(0, 40, (128, STEP)), rng.random((128, STEP)) < 0.7
    first = m.gradients(windows, targets, counted)
    m.gradients(windows[:5], targets[:5], counted[:5])
    tracemalloc.start()
    again = m.gradients(windows, targets, counted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20 and all(np.array_equal(first[k], again[k]) for k in first)


def test_words_are_parted_by_white_space_of_ascii_only():
    texts = [None, "", " \t", " A\x0bb\x0c\x1cC\n\x85\xa0\u00c9d  ", "x", "\u3000Y \u2028z\x00\r\na"]
    batch = pa.RecordBatch.from_arrays([pa.array([t and t.encode() for t in texts], pa.binary())], ["text"])
    words, of = lm.words_of(batch.column("text"))
    got = [[w.encode() for w, i in zip(words.to_pylist(), of, strict=True) if i == k] for k in range(len(texts))]
    assert got == [(t or "").encode().lower().split() for t in texts]
    assert [x for b in lm.sliced([batch, batch.slice(0, 0)]) for x in b.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_classes_and_places():
    counts = np.concatenate([[5000, 4000], np.full(98, 50)])
    beside = np.full((100, 6), 1.0)
    beside[2:50, 0] += 100
    beside[50:, 3] += 100
    at = places(counts, beside)
    assert at.shape == (100, WIDTH) and np.isfinite(at).all()
    assert np.abs(at[2:50, :2] - at[2, :2]).max() < 0.1 < np.abs(at[60, :2] - at[2, :2]).max()
    of = classes(counts, beside)
    assert of[0] != of[1] and not set(of[2:50]) & set(of[50:])


def plain_base(rows):
    counts = Counter()
    learned = [t or "" for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 10]
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
    for t in learned:
        counts.update(words(t))
    n, v = sum(counts.values()) + len(learned), len(counts) + bool(learned)
    counts["end"] = len(learned)
    out = {}
    for d, t in rows:
        own = [*words(t or ""), "end"]
        out[d, t] = (len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    return out


def test_whole_table_base_and_held_out_gain(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    monkeypatch.setattr(lm.base_scores, "__defaults__", (300,))
    got = {r.doc_id: r for r in op7_lm_score(spark, d).collect()}
    assert len(got) == len(rows)
    for (doc, _), (n, known, total, base) in plain_base(rows).items():
        r = got[doc]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 10 == 0)


def test_held_out_gain_as_shipped_and_any_partitions(spark):
    """Against the ids' shares alone the counts gain, and the fitted layer gains on the counts; partitions change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300")
    tokens = lm.tokenized(docs.repartition(5)).persist()
    held_out = docs.select("doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held"))
    held = {r.doc_id for r in held_out.where("held").collect()}
    training = tokens.join(held_out.where("not held").select("doc_id"), "doc_id", "left_semi").select(*tokens.columns)
    model = lm.train(training)
    texts = [np.frombuffer(r.ids, "<u2").astype(np.int32) for r in tokens.collect() if r.doc_id in held]
    counts = np.bincount(np.concatenate([[*np.frombuffer(r.ids, "<u2"), EDGE] for r in training.collect()]), minlength=lm.VOCABULARY) + 1
    shares = sum(np.log10(counts[[*t, EDGE]] / counts.sum()).sum() for t in texts)
    unfitted = lm.Attention(counts, model.place, model.of, np.ones((model.of.max() + 1,) * 2))
    unfitted.follow = model.follow
    plain, fitted = score_texts(unfitted, texts).sum(), score_texts(model, texts).sum()
    assert plain > 0.95 * shares and fitted > 0.97 * plain, (shares, plain, fitted)
    for n in (1, 8):
        other = lm.train(training.repartition(n))
        assert all(np.array_equal(model.weights[k], other.weights[k]) for k in model.weights)
        assert np.array_equal(model.of, other.of) and np.array_equal(model.place, other.place)


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "The the THE"), (3, "The the THE"), (4, "word " * 60_000), (None, "\u00e9 \x0b x"), (10, "unseen <|endoftext|>")]
    docs = spark.createDataFrame([(d, t, "w", 1.0) for d, t in rows], "doc_id long, text string, word string, score double")
    learned = docs.where("doc_id < 5")
    got = score(docs, learned).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known) for r in got), key=str) == sorted([(1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 60_001, 60_001), (None, 3, 1), (10, 3, 1)], key=str)
    assert all(math.isfinite(r.score) and r.score < 0 and r.train_tokens == 60_011 for r in got)
    assert len({(r.base_score, r.score) for r in got if r.doc_id == 3}) == 1
    nothing = score(docs, docs.limit(0)).collect()
    assert len(nothing) == len(rows) and {r.n_known for r in nothing} == {0} and {r.train_tokens for r in nothing} == {0}
    assert score(docs.limit(0), learned).count() == 0


def test_every_training_document_is_fitted(spark, monkeypatch):
    """Each text of a block changes its weights: those of blocks of one text each are changed by every one."""
    docs = spark.createDataFrame([(i, f"word{i} and other{i} things\n" * 3) for i in range(40)], "doc_id long, text string")
    tokens = lm.tokenized(docs).persist()
    monkeypatch.setattr(lm, "BLOCK", 1 << 30)
    model = lm.train(tokens)
    before = {k: v.copy() for k, v in model.weights.items()}
    assert all(np.abs(v).max() > 0 for v in before.values())
    one = lm.train(tokens.where("doc_id <> 7"))
    assert not np.array_equal(before["out"], one.weights["out"])


def test_ids_are_counted_in_whole_texts(spark):
    texts = ["The line\nbreaks\n\n  and\ttabs", "word\n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter({EDGE: len(texts)})
    for t in texts:
        want.update(lm.encoder().encode_ordinary((t or "").lower()))
    got = lm._summed(lm.tokenized(docs), lm.VOCABULARY, lambda line: (line[1:],))
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want
