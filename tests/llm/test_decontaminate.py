import random
import re

import pytest

from packetlake.llm.decontaminate import ORACLE, contamination, op12_decontaminate, remove_documents, remove_spans
from tests.oracle import compare, connect

DOCS, ITEMS = "doc_id long, text string, items string, N_words int", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain(text, items, n=10):
    """(words, hit words, items, spans) by comparing all windows."""
    found = list(WORD.finditer(lower(text)))
    words, hit, listed = [m.group() for m in found], set(), set()
    for item, item_text in items:
        w = WORD.findall(lower(item_text))
        k = min(n, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        at = [i for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in windows] if k else []
        hit |= {i + j for i in at for j in range(k)}
        if at and item is not None:
            listed.add(str(item))
    spans = []
    for i in sorted(hit):
        if i - 1 in hit:
            spans[-1] = found[i].end()
        else:
            spans += [found[i].start(), found[i].end()]
    return len(words), len(hit), sorted(listed), spans


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cc", "über", "日本", "x9", "long" * 50, "É"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\0"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 14, 40]))) for i in range(30)] + [(3, "a b"), (None, "x9 x9 cc"), (50, None), (51, " ... ")]
    docs = [text(rng.randrange(60)) for _ in range(60)]
    docs += [text(20) + rng.choice(items)[1] + text(20) if k % 2 else (rng.choice(items[:30])[1]).upper() for k in range(40)]
    return items, [*docs, None, "", "!!", "a b"]


@pytest.mark.parametrize("sets", [{}, {"entries": 40}, {"size": 3000}])
def test_equals_all_windows(spark, sets):
    items, texts = made(1)
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(texts)], DOCS)
    got = contamination(docs, spark.createDataFrame(items, ITEMS), **sets)
    assert got.columns == ["doc_id", "text", "items", "N_words", "_n_words", "n_hit", "_items", "spans"]
    rows = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        assert (rows[i]["_n_words"], rows[i].n_hit, rows[i]["_items"], rows[i].spans) == plain(t, items), t
        assert rows[i]["items"] == "kept" and rows[i].text == t
    assert sum(r.n_hit > 0 for r in rows.values()) > 40


def test_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame([(1, "Über (one two) three. End", "", 0), (2, "clean", "", 0), (3, None, "", 0), (4, "ONE two three", "", 0)], DOCS).select("doc_id", "text")
    marked = contamination(docs, spark.createDataFrame([(1, "one, two three")], ITEMS))
    assert dict(remove_spans(marked).select("doc_id", "text").collect()) == {1: "Über (. End", 2: "clean", 3: None, 4: ""}
    assert {r.doc_id for r in remove_documents(marked).collect()} == {2, 3}
    assert {r.doc_id for r in remove_documents(marked, most=0.7).collect()} == {1, 2, 3}


def test_no_items_no_documents_repeated_rows_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b c", "", 0)] * 2 + [(None, "a", "", 0)], DOCS)
    assert [r.n_hit for r in contamination(docs, spark.createDataFrame([], ITEMS)).collect()] == [0, 0, 0]
    assert contamination(docs.limit(0), spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    assert sorted(r.n_hit for r in contamination(docs, spark.createDataFrame([(1, "a")] * 3, ITEMS)).collect()) == [1, 1, 1]
    far = "w " * 400_000
    long = spark.createDataFrame([(1, far + "one two three " + "y" * 3_000_000 + " " + far + "one two three", "", 0)], DOCS)
    found = contamination(long, spark.createDataFrame([(1, "one two three"), (2, "y" * 3_000_000)], ITEMS)).first()
    assert (found["_n_words"], found.n_hit, found["_items"], found.spans[0]) == (800_007, 7, ["1", "2"], 800_000)


def test_query_equals_its_sql(spark):
    assert compare(op12_decontaminate(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001").sql(ORACLE)) == 200
