import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from packetlake.llm.packing import encoder, op10_pack_sequences, pack_documents, shortest_pack_first, slots


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, texts, longest=1024):
    """Each id in one piece, each sequence gapless from 0."""
    ids = {d: [*e.ids, 0] for d, e in zip(texts, tokenizer().encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and 0 < r.length <= longest and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4"))
            at += r.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= longest
    return sum(r.length for r in rows) / (longest * len(by_sequence))


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    assert check(op10_pack_sequences(spark, d).collect(), texts) > 0.98


def test_ids_are_those_of_the_json_vocabulary():
    rng = random.Random(4)
    some = ["", " ", "\n\n  x\t", "'s 'S don't I'LL", "<|endoftext|>", "é́ßİıſ中文字 한국어 العربية हिन्दी 😀👩‍👩‍👧", "   x​　", "½²Ⅷ٣", "a" * 50_000, "  " * 20_000, "\x00\x01\x7f\x85\x1c", "!?" * 9000]
    some += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F900)))) for _ in range(300)) for _ in range(40)]
    assert [encoder().encode_ordinary(x) for x in some] == [e.ids for e in tokenizer().encode_batch(some, add_special_tokens=False)]


def test_patterns_hold_the_histogram():
    rng = random.Random(1)
    for longest in (8, 64, 1024):
        histogram = {n: rng.randrange(1, 500) for n in rng.sample(range(1, longest + 1), min(longest, 300))}
        patterns = shortest_pack_first(histogram, longest)
        held = Counter()
        for n, pattern in patterns:
            assert sum(pattern) <= longest and list(pattern) == sorted(pattern, reverse=True)
            for x in pattern:
                held[x] += n
        assert held == histogram
        places = set()
        for length, ranks, sequences, offsets in slots(patterns):
            assert ranks[0] == 0 and ranks == sorted(ranks)
            for a, b, s, o in zip(ranks, [*ranks[1:], histogram[length]], sequences, offsets, strict=True):
                places |= {(s + k, o + j) for k in range(b - a) for j in range(length)}
        assert len(places) == sum(k * n for k, n in histogram.items())
    assert shortest_pack_first({}) == []


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a b"), (5, "x" * 5000)]
    docs = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], "doc_id long, text string, salt string, length long")
    check(pack_documents(docs).collect(), {d: t or "" for d, t in rows})
    twice = pack_documents(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.length, r.offset) for r in twice) == [(None, 3, 0), (None, 3, 3)] and len({r.sequence_id for r in twice}) == 1
    assert pack_documents(docs.limit(0)).count() == 0


def test_the_end_mark_in_a_text_is_its_id(spark):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b<|endoftext|>c", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>x", "<|endoftext| >", "<|ENDOFTEXT|>", "x  <|endoftext|>  'S", "<|endo<|endoftext|>ftext|>"]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [encoder().encode(x, allowed_special="all") for x in texts] == want and 50_256 in want[0]
    got = {r.doc_id: r for r in pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i].doc_tokens == len(x) + 1 and got[i].ids_crc32 == zlib.crc32(np.array([*x, 0], "<u4")) for i, x in enumerate(want))
