from collections import Counter

import corpus_pipeline
from tests.llm.test_linededup import expect
from tests.llm.test_neardedup import slow


def test_stages_on_the_whole_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, stage(spark, docs, d))
        steps[name][1].write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == columns
    rows = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    first = spark.read.parquet(f"{d}/documents.parquet").collect()
    kept = {r.doc_id for r in rows("language_id")}
    assert all((r.doc_id in kept) == any(c.isalpha() for c in r.text) for r in first)
    want = {r[0]: r[3] for r in expect([(r.doc_id, r.text) for r in rows("language_id")])}
    lines = {r.doc_id: r.text for r in rows("line_dedup")}
    assert lines == {k: t for k, t in want.items() if t.strip() or t == next(r.text for r in first if r.doc_id == k)}
    assert all(r.n_chars == len(r.text) for r in rows("line_dedup"))
    groups = slow(list(lines.items()))
    near = {r.doc_id for r in rows("near_dedup")}
    assert near == {k for k, w in groups.items() if k == w}
    mixed = Counter(r.doc_id for r in rows("mix_sources"))
    assert mixed.keys() <= near and 0.6 * len(near) < sum(mixed.values()) < 1.4 * len(near)
    pieces = rows("packing")
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(n * tokens[k] for k, n in mixed.items())
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    whole = corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat sat", "en", None, 11), (3, "the cat sat", None, "s", 11), (3, "the cat sat", None, "s", 11), (4, "word " * 50_000, "en", "s", 250_000), (5, "12 34", "de", "s", 5)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema + ", node string")
    for part in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, "")
        part.collect()
