import math
import random

import numpy as np
import pytest

from packetlake.llm.codes import ORACLE, compress, op13_vector_codes, restored, with_label_error
from tests.oracle import compare, connect

SCHEMA = "vec_id long, label int, embedding array<float>, codes string, Error int"


def plain(vectors, parts=16, entries=64, rounds=2):
    """(codes, error) of each vector of (id, whole numbers), and the codebooks, over all vectors."""
    width = -(-max(len(v) for _, v in vectors) // parts)
    cut = [(i, [tuple((v + [0] * width * parts)[p * width : (p + 1) * width]) for p in range(parts)]) for i, v in vectors]
    first = sorted(cut, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:entries]
    books = [[x[1][p] for x in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        after = []
        for p in range(parts):
            own = {}
            for _, x in cut:
                own.setdefault(near(p, x[p])[1], []).append(x[p])
            after.append([tuple(sum(c) // len(own[e]) for c in zip(*own[e], strict=True)) if e in own else c for e, c in enumerate(books[p])])
        books = after
    found = [[near(p, x[p]) for p in range(parts)] for _, x in cut]
    return [([e for _, e in f], sum(d for d, _ in f)) for f in found], books


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize(("n", "dims"), [(300, 32), (40, 16), (90, 21), (70, 3)])
def test_equals_plain_rounds(spark, n, dims):
    rng = random.Random(n)
    common = [rng.choice([-1.0, 0.0, 0.5]) for _ in range(dims)]
    rows = [(rng.randrange(500), rng.choice([1, 2, None]), common if rng.random() < 0.3 else [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(dims)], str(k), k) for k in range(n)] + [(None, 1, common, str(n), n)]
    bad = [(0, 1, None, "", -1), (1, 1, [*common[:-1], None], "", -1), (2, 1, [*common[:-1], float("nan")], "", -1), (3, 1, [float("-inf"), *common[1:]], "", -1)]
    coded, books = compress(spark.createDataFrame(rows + bad, SCHEMA))
    want, want_books = plain([(r[0], whole(r[2])) for r in rows])
    got = {r.Error: (r["_codes"], r["_error"]) for r in coded.collect()}
    assert [got[k] for k in range(n + 1)] == want and len(got) == n + 1
    assert books.astype(int).tolist() == [[list(c) for c in b] for b in want_books]
    totals = {}
    for r, (_, error) in zip(rows, want, strict=True):
        totals[r[1]] = totals.get(r[1], 0) + error
    assert {(r.label, r.label_error) for r in with_label_error(coded, error="_error").collect()} == set(totals.items())


def test_repeated_rows_and_restoring(spark):
    rows = [(1, 1, [0.5] * 16, "a", 0)] * 3 + [(2, None, [-0.25] * 16, "b", 0)]
    coded, books = compress(spark.createDataFrame(rows, SCHEMA))
    assert coded.count() == 4 and {r["_error"] for r in coded.collect()} == {0}
    assert all(r.restored == r.embedding for r in restored(coded, books, codes="_codes").collect())


def test_no_rows(spark):
    coded, books = compress(spark.createDataFrame([(1, 1, None, "", 0)], SCHEMA))
    assert coded.count() == 0 and books.size == 0 and coded.columns[-2:] == ["_codes", "_error"]
    assert with_label_error(coded, error="_error").count() == 0


def test_query_equals_its_sql(spark):
    assert compare(op13_vector_codes(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001").sql(ORACLE)) > 400
