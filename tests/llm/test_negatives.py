"""Hard negatives against all products of a small table."""

import random

import numpy as np
import pytest

from filewarden.llm import negatives as N

NAN, INF = float("nan"), float("inf")


def brute(rows):
    used = [
        (i, label, [int(np.floor(256.0 * float(np.float32(x)))) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, label, v) in enumerate(used):
        if i % 100:
            continue
        scored = [(-dot(v, w), j, other == label) for m, (j, other, w) in enumerate(used) if m != k and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j, _) in enumerate(fits[:10], 1)]
    return sorted(out)


def table(n=700, dims=8):
    r = random.Random(2)
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = r.randrange(4)
        length = r.choice([0.1, 1.0, 1.0, 5.0])
        rows.append((i, [length * (c + r.gauss(0, 0.7)) for c in centre[label]], label))
    rows += [(800 + i, rows[200][1], i % 2) for i in range(60)]  # copies, ties
    rows += [(900, [0.0] * dims, 1), (901, [0.0] * dims, 2), (1000, [0.5, 0.25], 1), (1001, [0.5, 0.25], 1), (1002, [0.25, 0.25], 2)]
    rows += [(1100, [], 1), (1101, [], 1), (1102, [], 2)]
    rows += [(1200, None, 1), (1300, [NAN] * dims, 1), (1400, [INF] * dims, 1), (1500, [None, *[1.0] * (dims - 1)], 1), (1600, rows[0][1], None), (None, rows[0][1], 1)]
    return [*rows, rows[100], rows[100], rows[101]]


def run(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "own", 9) for r in rows], "vec_id bigint, embedding array<float>, label int, anchor string, place int")
    return sorted(map(tuple, N.hard_negatives(df.repartition(3), **settings).collect()))


@pytest.mark.parametrize("settings", [{}, {"group": 100, "bucket": 16, "block": 3, "focus": 2}])
def test_equals_brute_force(spark, settings):
    rows = table()
    got = run(spark, rows, **settings)
    assert got == brute(rows) and len(got) > 200


def test_empty_and_unusable_tables(spark):
    assert run(spark, []) == [] and run(spark, [(0, None, 1), (100, [1.0], None)]) == [] and run(spark, [(0, [1.0], 1)]) == []


def test_huge_components_do_not_overflow(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 2), (3, [1.0, 1.0], 2)]
    assert all(r[4] == 2**63 - 1 for r in run(spark, rows))


def test_ranges_skip_rows_but_lose_none():
    r = np.random.default_rng(0)
    v = r.integers(-100, 100, (2000, 6)).astype(np.int64)
    unit, norms = N._unit(v)
    order = np.argsort(-norms)
    v, unit, norms = v[order], unit[order], norms[order]
    bucket = N.Bucket(order, order, order, v, np.argsort(unit, axis=0).T.astype(np.int32))
    q, at = v[5], np.argsort(-np.abs(unit[5]))[:3]
    for share in (0.5, 0.8, 0.95):
        least = int(norms[5] * norms[0] * share)
        rows = bucket.candidates(unit[5], float(norms[5]), least, at)
        assert set(np.nonzero(v @ q >= least)[0]) <= set(rows.tolist()) and len(rows) < 2000 * (1.3 - share)
    assert len(bucket.candidates(unit[5], float(norms[5]), int(norms[5] * norms[0] * 1.1), at)) == 0
