import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from packetlake.llm.langid import EVIDENCE, LONGEST, SMOOTH, Model, grams_of, identify, keep_identified, op9_language_id, train, words_of


def test_held_out_accuracy_on_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"select doc_id, lang from '{d}/documents.parquet'").fetchall())
    rows = op9_language_id(spark, d).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def plain_model(rows):
    """Counts by language of all words and n-grams, plainly."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        if text is not None and lang is not None:
            for w in words_of(text):
                words[lang][w] += 1
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        grams[lang][g] += 1
    return words, grams


def plain_scores(text, words, grams):
    """(language, posterior), word by word."""
    langs = sorted(words)
    own = words_of(text)
    if not own or not langs:
        return "und", 0.0
    seen = {w for c in words.values() for w in c}
    sizes = Counter(len(g) for g in {g for c in grams.values() for g in c})
    log = lambda n, total, v: math.log(n + SMOOTH) - math.log(total + SMOOTH * (v + 1))
    sums = [0.0] * len(langs)
    for w in own:
        if w in seen:
            for i, x in enumerate(langs):
                sums[i] += log(words[x][w], words[x].total(), len(seen))
            continue
        for n in range(LONGEST, 0, -1):
            if found := [g for g in grams_of(w, n) if any(grams[x][g] for x in langs)]:
                for i, x in enumerate(langs):
                    total = sum(k for g, k in grams[x].items() if len(g) == n)
                    sums[i] += sum(log(grams[x][g], total, sizes[n]) for g in found) / len(found)
                break
    mean = [s / len(own) * min(len(own), EVIDENCE) for s in sums]
    best = mean.index(max(mean))
    return langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)


@pytest.mark.parametrize("cached", [0, 30, 100_000])
def test_against_the_plain_scorer(spark, cached):
    """Whatever tasks hold beside the tables, all words and n-grams count."""
    rows = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 60").fetchall()
    learned = [(t, x) for d, t, x in rows if d % 3]
    model = train(spark.createDataFrame(learned, "text string, lang string"), cached)
    assert model.words.rest.count() + len(model.words.cache) == len({w for t, x in learned if x for w in words_of(t)})
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(900, "zzzq xxyy"), (901, "\u4e2d\u6587")], "doc_id long, text string")
    words, grams = plain_model(learned)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = identify(docs, model).collect()
    assert len(got) == len(text)
    for r in got:
        lang, score = plain_scores(text[r.doc_id], words, grams)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4), r


def test_counts_and_back_off(spark):
    rows = [("the cat", "en"), ("the dog", "en"), ("le chat", "fr"), (None, "fr"), ("ignored", None), ("", "de")]
    model = train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ["en", "fr"] and set(model.words.cache) == {"the", "cat", "dog", "le", "chat"}
    docs = spark.createDataFrame([(1, "THE"), (2, "le"), (3, "dogs"), (4, "zzz")], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "fr", "en", "en"] and got[4].score == 0.5  # dogs by " dog"; nothing known of zzz: a tie
    assert grams_of("ab", 1) == ["a", "b"] and grams_of("ab", 3) == [" ab", "ab "]
    assert words_of("x\u00b2 12 \u00c9_\u00e0") == ["\u00e9", "\u00e0"] and words_of("\u00b2") == [] and words_of("x\u00b2") == ["x"]


def test_more_equal_words_than_tasks_hold_are_all_kept(spark):
    rows = [("a " * 9 + "b " * 5 + "c " * 5 + "d", "en"), ("q r", "fr")]
    model = train(spark.createDataFrame(rows, "text string, lang string"), cached=2)
    assert model.words.cache == ["a"] and {r.word for r in model.words.rest.collect()} == {"b", "c", "d", "q", "r"}
    even = train(spark.createDataFrame([("a b c d", "en")], "text string, lang string"), cached=3)
    assert even.words.cache == [] and even.words.rest.count() == 4


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "the thex"), (4, "the thex"), (None, "le"), (5, "le " * 300_000)]
    docs = spark.createDataFrame([(d, t, "x", 2.0) for d, t in rows], "doc_id long, text string, lang_pred string, score double")
    model = train(spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string"))
    got = sorted(((r.doc_id, r.lang_pred) for r in identify(docs, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr"), (5, "fr")], key=str)
    assert identify(docs.limit(0), model).count() == 0
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    nothing = train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {"und"}
    assert isinstance(nothing, Model)
