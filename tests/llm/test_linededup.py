import random

import duckdb
import xxhash

from packetlake.llm.linededup import dedup_lines, op6_line_dedup

NOISE, GUARANTEE = 30, 50


def digest(hashes):
    """Spark's xxhash64 of an array of longs."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def words(line):
    line = line.strip(" ")
    return line.count(" ") + 1 if line else 0


def slow(rows):
    """{(id, text): deleted line numbers} by walking every document."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    docs = {}
    for d, t in rows:
        if t is not None:
            docs[(2**63 - 1 if d is None else d, signed(xxhash.xxh64_intdigest(t.encode(), 42)))] = t
    lines, grams, first = {}, {}, {}
    for key, t in sorted(docs.items()):
        own = lines[key] = [(i, signed(xxhash.xxh64_intdigest(x.encode(), 42)), words(x)) for i, x in enumerate(t.split("\n")) if words(x)]

        def until(i, least, own=own):
            n = 0
            for j in range(i, len(own)):
                n += own[j][2]
                if n >= least:
                    return j + 1
            return None

        hashed = [digest([h for _, h, _ in own[i : until(i, NOISE)]]) if until(i, NOISE) else None for i in range(len(own))]
        for i in range(len(own)):
            if until(i, GUARANTEE):
                ahead, j = 0, i
                best = None
                while j < len(own) and ahead <= GUARANTEE - NOISE:
                    if hashed[j] is not None and (best is None or hashed[j] <= hashed[best]):
                        best = j
                    ahead += own[j][2]
                    j += 1
                grams.setdefault(key, {})[best] = hashed[best]
        for p, g in grams.get(key, {}).items():
            first[g] = min(first.get(g, (key, p)), (key, p))
    gone = {}
    for key, own in grams.items():
        for p, g in own.items():
            other, q = first[g]
            if (other, q) != (key, p):
                a, b = lines[key], lines[other]
                for step in (1, -1):
                    i, j = p, q
                    while 0 <= i < len(a) and 0 <= j < len(b) and a[i][1] == b[j][1]:
                        gone.setdefault(key, set()).add(a[i][0])
                        i, j = i + step, j + step
    return {(d, t): gone.get((2**63 - 1 if d is None else d, signed(xxhash.xxh64_intdigest(t.encode(), 42))), set()) for d, t in rows if t is not None}


def expect(rows):
    gone = slow(rows)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, 0, 0, None))
        else:
            kept = [x for i, x in enumerate(t.split("\n")) if i not in gone[d, t]]
            out.append((d, t.count("\n") + 1, len(gone[d, t]), "\n".join(kept)))
    return sorted(out, key=str)


def test_whole_table_against_plain_walk(spark):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    got = [tuple(r) for r in op6_line_dedup(spark, d).collect()]
    assert sorted(got, key=str) == expect(rows)
    assert sum(r[2] for r in got) > 100


def make(rng, n, longest=14):
    return [" ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, longest))) for _ in range(n)]


def test_random_runs_against_plain_walk_and_the_guarantee(spark):
    rng = random.Random(7)
    passages = [make(rng, rng.randrange(1, 9)) for _ in range(12)] + [[" ".join(rng.choices("abcdefgh", k=51))], [" ".join(rng.choices("abcdefgh", k=12))]]
    rows = []
    for d in range(60):
        body = []
        for _ in range(rng.randrange(1, 6)):
            body += make(rng, rng.randrange(0, 6)) + rng.choice(passages) + rng.choice(([], [""]))
        rows.append((d, "\n".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in dedup_lines(docs.repartition(5)).select("doc_id", "n_lines", "n_deleted", "text").collect()]
    assert sorted(got, key=str) == expect(rows)
    left = {d: [x for x in t.split("\n") if x] for d, _, _, t in got}
    original = [x for _, t in rows for x in t.split("\n")]
    assert {x for xs in left.values() for x in xs} == {x for x in original if x}  # nothing is lost everywhere
    seen = set()
    for d in sorted(left):  # no passage of 50 words stands twice
        for p in passages:
            if sum(map(words, p)) >= GUARANTEE and any(left[d][i : i + len(p)] == p for i in range(len(left[d]))):
                assert tuple(p) not in seen
                seen.add(tuple(p))


def test_edges_of_the_input(spark):
    long = " ".join(["w"] * 60)
    other = " ".join(["v"] * 60)
    big = "\n".join(f"line {i} of a very long text" for i in range(4000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, f"top\n{long}\n\nend"), (5, f"{long}\nown"), (6, f"{other}\nx\n{other}\ny"), (7, long), (7, long), (None, other), (8, big), (9, big), (10, "few words\nfew words")]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, k1 string, n_lines int")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "k1", "n_lines", "_n_lines", "n_deleted"]
    rows_out = sorted(((r.doc_id, r._n_lines, r.n_deleted, r.text) for r in got.collect()), key=str)
    assert rows_out == expect(rows)
    by = {r[0]: r for r in rows_out}
    assert by[4][3] == f"top\n{long}\n\nend" and by[5][3] == "own" and by[6][3] == f"{other}\nx\ny" and by[9][3] == "" and by[None][3] == ""
    assert dedup_lines(docs.limit(0)).count() == 0
