import math
import random

import numpy as np
import pytest

from packetlake.llm.negatives import ORACLE, Part, hard_negatives, op11_hard_negatives, participants
from tests.oracle import compare, connect

SCHEMA = "vec_id long, label int, embedding array<float>, v string"


def plain(rows, positives=5, negatives=10):
    """The contract, over all pairs; ``rows`` are {id: (label, whole numbers)}."""
    out = []
    for a, (label, q) in rows.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), b, other) for b, (other, v) in rows.items() if b != a)
        for p, b, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(n, c) for n, c, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(a, b, i + 1, c, -p, -n) for i, (n, c) in enumerate(fit[:negatives])]
    return sorted(out)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def made(n, dims, seed, labels=4, copies=0.3):
    """Random vectors; a share of them are one vector, so that scores tie."""
    rng = random.Random(seed)
    common = [rng.uniform(-1, 1) for _ in range(dims)]
    return [(i * 10, rng.randrange(labels), common if rng.random() < copies else [rng.uniform(-1, 1) for _ in range(dims)], "x") for i in range(n)]


@pytest.mark.parametrize("cell", [64, 10_000])
def test_equals_all_pairs(spark, cell):
    rows = made(700, 6, 1)
    got = hard_negatives(participants(spark.createDataFrame(rows, SCHEMA)), cell=cell).collect()
    want = plain({i: (label, whole(v)) for i, label, v, _ in rows})
    assert sorted(map(tuple, got)) == want and len(want) > 1000


def test_many_labels_share_a_tree(spark):
    rows = made(400, 4, 2, labels=150, copies=0)
    got = hard_negatives(participants(spark.createDataFrame(rows, SCHEMA)), cell=128).collect()
    assert sorted(map(tuple, got)) == plain({i: (label, whole(v)) for i, label, v, _ in rows})


def test_rows_that_take_no_part(spark):
    rows = made(60, 3, 3, labels=2)
    odd = [(7, None, [0.1] * 3, ""), (8, 1, None, ""), (9, 1, [0.1, None, 0.2], ""), (11, 1, [0.1, float("nan"), 0.2], ""), (12, 1, [0.1, float("inf"), 0.2], ""), (None, 1, [0.9] * 3, "")]
    got = hard_negatives(participants(spark.createDataFrame(rows + odd + rows[:5], SCHEMA))).collect()
    assert sorted(map(tuple, got)) == plain({i: (label, whole(v)) for i, label, v, _ in rows})


def test_no_rows_one_row_and_short_vectors(spark):
    assert hard_negatives(participants(spark.createDataFrame([], SCHEMA))).count() == 0
    assert hard_negatives(participants(spark.createDataFrame([(0, 1, [0.5], "")], SCHEMA))).count() == 0
    assert hard_negatives(participants(spark.createDataFrame([(0, 1, [], ""), (1, 1, [], ""), (2, 2, [], "")], SCHEMA))).collect() == [(0, 1, 1, 2, 0, 0)]
    short = [(0, 1, [1.0, 1.0], ""), (1, 1, [1.0], ""), (2, 2, [0.5], "")]
    assert [tuple(r) for r in hard_negatives(participants(spark.createDataFrame(short, SCHEMA))).collect()] == [(0, 1, 1, 2, 65536, 32768)]


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="too long for exact sums"):
        participants(spark.createDataFrame([(0, 1, [1e30], "")], SCHEMA)).collect()


def test_balls_are_passed_over():
    rng = np.random.default_rng(5)
    middle = rng.integers(-200, 200, (40, 8)).astype(float)
    x = np.repeat(middle, 100, axis=0) + rng.integers(-3, 4, (4000, 8))
    part = Part(np.arange(4000), np.ones(4000, np.int64), x)
    seen = []
    leaf = part._leaf
    part._leaf = lambda tree, start, end, asked, *rest: (seen.append((end - start) * len(asked)), leaf(tree, start, end, asked, *rest))
    q = middle[:20]
    score = (q @ x.T).astype(np.int64)
    top = np.sort(score, axis=1)
    low, high = np.full((20, 1), -(1 << 62)), top[:, -50:-49] - 1
    keys = part.search(np.full(20, -1), np.zeros(20, np.int64), q, low, high, 10, False)
    want = [sorted((-s, i) for i, s in enumerate(row) if s <= h)[:10] for row, h in zip(score.tolist(), high[:, 0].tolist(), strict=True)]
    span = 1 << 18
    assert [[(-k // span if k % span == 0 else -(k // span), span - 1 - k % span) for k in sorted(row.tolist(), reverse=True)] for row in keys[:, 0]] == want
    assert sum(seen) < 0.5 * score.size


def test_query_equals_its_sql(spark):
    assert compare(op11_hard_negatives(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001").sql(ORACLE)) > 100
