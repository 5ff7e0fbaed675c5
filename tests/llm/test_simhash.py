import random
from itertools import combinations

import xxhash

from packetlake.llm.simhash import fingerprint, fingerprints, near_duplicates, op2_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, max_bits=3):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= max_bits:
            root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted((doc, f"{prints[i]:016x}", min((d for d in groups[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows) if doc is not None)


def test_whole_table_against_all_pairs(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    assert sorted(map(tuple, op2_simhash(spark, d).collect())) == slow_components(rows)


def test_edges_of_the_input(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (5, "a"), (6, "a b c d"), (7, "A B\tC  D"), (9, long), (8, long + " x"), (None, "a")]
    docs = spark.createDataFrame([(d, t, "key", "fp", 1) for d, t in rows], "doc_id long, text string, key string, fp string, component_id long")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8), (None, 4)}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_many_near_fingerprints_and_chains(spark, monkeypatch):
    """Fingerprints in chains and clouds, dealt to many cells, against all pairs."""
    from packetlake.llm import components, simhash

    monkeypatch.setattr(simhash, "CELL", 8)
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
                x ^= 1 << b
            fps.add(x)
        for _ in range(40):
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(fps, 2):
        if (x ^ y).bit_count() <= 3:
            root[find(x)] = find(y)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(simhash.signed(x))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    got = {}
    for r in components.connected_components(simhash.fingerprint_links(df)).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert all(r == min(g) for r, g in got.items())


def test_spark_hash_is_the_one_named(spark):
    text = "One two  three FOUR five é"
    assert fingerprint(text.encode(), 3) == slow_fingerprint(text)
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert fingerprints(df).first().fp == df.selectExpr("xxhash64('one two three')").first()[0]
