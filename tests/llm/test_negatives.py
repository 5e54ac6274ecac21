import math

import numpy as np

from peerwatch.llm import negatives

SHAPE = "vec_id bigint, embedding array<double>, label int"


def brute(rows, step=50, positives=5, kept=3, low=50, high=95):
    """Every anchor against every row, with whole numbers of any size."""
    out = []
    whole = {i: ([math.floor(256 * c) for c in v], y) for i, v, y in rows}
    for a, (va, ya) in whole.items():
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, y == ya) for i, (v, y) in whole.items() if i != a and len(v) == len(va)]
        for p, i, _ in sorted(s for s in scored if s[2])[:positives]:
            fits = sorted(s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p)
            out += [(a, i, rank, j, -p, -n) for rank, (n, j, _) in enumerate(fits[:kept], 1)]
    return sorted(out)


def mined(df, **options):
    got = negatives.mine(df, **options)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())


def made(n, dim, labels=3, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (scale * (rng.standard_normal(dim) + 0.5)).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((64, 64, 64), (33, 70, 129), (1, 64, 7), (130, 5, 40), (16, 0, 20), (48, 32, 100)):
        a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (n, k))
        for leaf in (1, 3, 16):
            assert (negatives.strassen(a, b, leaf) == a @ b.T).all()
    high = np.full((40, 64), negatives.largest(64))
    assert (negatives.strassen(high, high, 2) == 64 * negatives.largest(64) ** 2).all()


def test_heaps_equal_a_sort():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(0, 6, (9, 200)), np.sort(rng.permutation(1000)[:200])
    fits = rng.random((9, 200)) < 0.4
    one, two = negatives.Heaps(9, 4), negatives.Heaps(9, 4)
    every = np.arange(9)
    for a in range(0, 200, 30):
        to = one if a % 60 else two
        to.offer(every, score[:, a : a + 30], fits[:, a : a + 30].copy(), ids[a : a + 30])
    one.merge(every, two.score, two.id)
    for i in range(9):
        want = sorted((-s, j) for s, j, f in zip(score[i], ids, fits[i]) if f)[:4]
        assert [(-s, j) for s, j in zip(one.score[i], one.id[i])] == want


def test_equals_brute_force(spark):
    rows = made(400, 7)
    df = spark.createDataFrame(rows, SHAPE)
    assert mined(df, block=64) == brute(rows)
    assert mined(df.repartition(7), step=7, positives=2, negatives=4, low=10, high=60, chunk_bytes=500) == brute(rows, 7, 2, 4, 10, 60)


def test_ties_and_copies(spark):
    same = [(i, [1.0, 1.0], i % 2) for i in range(300)]
    near = [(300 + i, [0.75, 0.75], 2) for i in range(300)]
    rows = same + near
    assert mined(spark.createDataFrame(rows, SHAPE), block=50) == brute(rows) != []


def test_rows_that_take_no_part(spark):
    rows = made(120, 4)
    bad = [(200, None, 1), (250, [1.0, None, 0.0, 0.0], 1), (300, [float("nan")] * 4, 1), (350, [float("inf")] * 4, 1), (400, [9.0] * 4, None), (None, [9.0] * 4, 1)]
    assert mined(spark.createDataFrame(rows + bad, SHAPE)) == brute(rows)


def test_rows_repeated_under_one_id(spark):
    rows = made(120, 4)
    again = rows + rows[:60] + [(50, rows[50][1], rows[50][2] + 1), (50, [9.0] * 4, rows[50][2] + 2)]
    assert mined(spark.createDataFrame(again, SHAPE)) == brute(rows)


def test_lengths_do_not_meet(spark):
    rows = made(100, 3) + [(100 + i, v, y) for i, v, y in made(100, 5, seed=4)] + [(200 + i, [], i % 2) for i in range(60)]
    assert mined(spark.createDataFrame(rows, SHAPE)) == brute(rows)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [1.0], 1), (1, [0.5], 2)], [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.7], 2)]):
        assert mined(spark.createDataFrame(rows, SHAPE)) == brute(rows)


def test_very_large_components(spark):
    rows = made(100, 4, scale=3000.0)
    assert mined(spark.createDataFrame(rows, SHAPE)) == brute(rows)
    bound = negatives.largest(2) / 256
    beyond = [(0, [1e300, 1.0], 1), (1, [bound, 1.0], 1), (2, [1e300, -1e300], 2), (3, [bound * 0.7, 0.0], 2)]
    held = [(0, [bound, 1.0], 1), (1, [bound, 1.0], 1), (2, [bound, -bound], 2), (3, [bound * 0.7, 0.0], 2)]
    assert mined(spark.createDataFrame(beyond, SHAPE)) == brute(held)


def test_clashing_columns(spark):
    rows = made(120, 4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "key bigint, emb array<double>, kind int, rank int, score string")
    assert mined(df, id_col="key", vec_col="emb", label_col="kind") == brute(rows)
