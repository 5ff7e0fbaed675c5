import random
from itertools import combinations

import duckdb

from packetlake.llm import neardedup
from packetlake.llm.neardedup import dedup_near_copies, near_copies
from packetlake.llm.simhash import shingle_hashes

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow(rows, similarity=0.8):
    """{id: smallest id of its group} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    for a, b in {p for ds in by.values() for p in combinations(sorted(ds), 2)}:
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in sets}


def test_whole_table_against_all_pairs(spark):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = {r.k1: r.w1 for r in near_copies(docs).collect()}
    want = slow(rows)
    assert got == want
    kept = dedup_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.select("doc_id", "text").collect())) == sorted(r for r in rows if want[r[0]] == r[0])


def test_large_groups_in_cells(spark, monkeypatch):
    from packetlake.llm import neardedup, simhash

    monkeypatch.setattr(neardedup, "CELL_DOCUMENTS", 10)
    monkeypatch.setattr(simhash, "CELL", 10)
    rng = random.Random(3)
    rows = []
    for _ in range(4):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randrange(1, 6) for _ in range(200)]
        for _ in range(50):
            own = list(words)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(200)] = str(rng.random())
            rows.append((len(rows), " ".join(own)))
    got = {r.k1: r.w1 for r in near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = slow(rows)
    assert sum(got[d] != want[d] for d in want) <= 2  # candidates that share no band
    assert len(set(want.values())) < 60


def test_edges_of_the_input(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(5, None), (4, ""), (3, " \n"), (10, "A b"), (11, "a  B"), (12, "a b c"), (None, "a b"), (20, long), (19, long + " x"), (30, "same row"), (30, "same row"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "q", 1) for d, t in rows], SCHEMA + ", _k1 string, node int")
    kept = [(r.doc_id, r.text if len(r.text or "") < 99 else "long") for r in dedup_near_copies(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, " \n"), (10, "A b"), (12, "a b c"), (19, "long"), (30, "same row"), (None, "no id")], key=str)
    assert dedup_near_copies(docs.limit(0)).count() == 0


def test_repeated_shingles_do_not_hide_copies(spark):
    """Copies of the same words apart from a repeated phrase: their sets are alike, their SimHashes are not."""
    rng = random.Random(5)
    rows = []
    for _ in range(20):
        words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
        rows += [(len(rows), words), (len(rows) + 1, f"{words} {'- ' * 90}")]
    want = slow(rows)
    assert all(want[d] == d // 2 * 2 for d, _ in rows)
    assert {r.k1: r.w1 for r in near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_close_fingerprints_are_candidates(spark):
    """Texts of 9 shingles that share 8 of 10, 0.8, and no band: their SimHashes are within 3 bits."""
    rng = random.Random(215956)
    words = [f"w{rng.randrange(10**6)}" for _ in range(14)]
    rows = [(1, " ".join(words[:13])), (2, " ".join([*words[:12], words[13]])), (3, " ".join(f"v{i}" for i in range(13)))]
    bands, sets = [set(neardedup.band_keys(shingle_hashes(t.encode(), 5))) for _, t in rows], [shingles(t) for _, t in rows]
    assert not bands[0] & bands[1] and len(sets[0] & sets[1]) == 8 and len(sets[0] | sets[1]) == 10
    assert {r.k1: r.w1 for r in near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == slow(rows) == {1: 1, 2: 1, 3: 3}


def test_bands_link_only_what_fingerprints_leave_apart(spark):
    keys = {1: [10, 11], 2: [10, 12], 3: [12, 13], 4: [14], 5: [14]}
    fps = {1: 0, 2: 0b111, 3: 0b1111111 << 40, 4: -1, 5: -1}
    nodes = spark.createDataFrame([(n, fps[n], k) for n, k in keys.items()], "node long, fp long, keys array<long>")
    links = sorted({(max(r), min(r)) for r in neardedup.candidate_links(nodes).collect()})
    assert links == [(2, 1), (3, 1), (5, 4)]  # 2 hangs on 1, so its band with 3 links 3 to 1; 5 has the fingerprint of 4
    _, close = neardedup.fingerprint_links(nodes)
    assert {(r.a, r.b) for r in close.collect() if r.a != r.b} == {(2, 1)}
