import numpy as np
import pytest

from peerwatch.llm import whitening


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")


def random_rows(n, dim, seed=0):
    mixing = np.random.default_rng(seed).standard_normal((dim, dim)) / 4
    points = np.random.default_rng(seed + 1).standard_normal((n, dim)) @ mixing
    return [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]


def held(got, rows, most):
    """Exact whole numbers, and components against a dense solver, for rows of one length with ids of their own."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    far = {i: int(((n * v - sums) ** 2).sum()) for (i, _), v in zip(rows, x)}
    centred = np.array((n * x - sums), float) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    count = min(most, int((values > 1e-10 * values[0]).sum()))
    table = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(table) == n * count
    assert {c for _, c in table} == set(range(1, count + 1)) and all(r["n"] == n and int(r["deviation"]) == far[r["vec_id"]] for r in got)
    mine = np.array([[table[i, c + 1]["whitened"] for c in range(count)] for i, _ in rows])
    want = centred @ columns[:, :count] / np.sqrt(values[:count])
    want *= np.sign((want * mine).sum(axis=0))
    assert np.abs(mine - want).max() < 1e-6
    explained = [table[rows[0][0], c + 1]["explained"] for c in range(count)]
    assert np.allclose(explained, values[:count] / values.sum(), rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_equals_a_dense_solver(spark):
    rows = random_rows(300, 12)
    held(whitening.whiten(vectors(spark, rows).repartition(5)).collect(), rows, 32)


def test_query_equals_a_dense_solver(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = whitening.op11_whiten_jacobi(spark, sf_dir)
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["component"] == "int"
    held(out.collect(), rows, 32)


def test_fewer_rows_than_entries(spark):
    rows = random_rows(5, 9)
    held(whitening.whiten(vectors(spark, rows)).collect(), rows, 32)


def test_dependent_entries_lower_the_rank(spark):
    rows = [(i, [v[0], v[1], v[0], 7.0]) for i, v in random_rows(50, 2)]
    held(whitening.whiten(vectors(spark, rows, "double")).collect(), rows, 32)


def test_rows_that_take_no_part(spark):
    good = random_rows(40, 3)
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 0.0, 0.0]), (93, [float("inf"), 0.0, 0.0])]
    held(whitening.whiten(vectors(spark, good + bad)).collect(), good, 32)


def test_repeated_rows_and_rows_without_id_count(spark):
    rows = random_rows(10, 2)
    got = whitening.whiten(vectors(spark, rows + [rows[0], (None, [0.5, 0.25])])).collect()
    assert len(got) == 24 and {r["n"] for r in got} == {12} and sum(r["vec_id"] is None for r in got) == 2
    twice = [r for r in got if r["vec_id"] == 0 and r["component"] == 1]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_lengths_are_whitened_apart(spark):
    one, two = random_rows(30, 3), [(i + 100, v) for i, v in random_rows(20, 5, 7)]
    got = whitening.whiten(vectors(spark, one + two + [(999, [])])).collect()
    held([r for r in got if r["vec_id"] < 100], one, 32)
    held([r for r in got if r["vec_id"] >= 100], two, 32)


def test_tables_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(4)], [(1, []), (2, [])], [(1, None)]):
        out = whitening.whiten(vectors(spark, rows))
        assert out.collect() == []


def test_very_large_entries(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 3.0])]
    got = whitening.whiten(vectors(spark, rows, "double")).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2} and all(np.isfinite(r["whitened"]) for r in got)
    x = [2**61 + 1_000_000, -(2**61) + 1_000_000, 1_000_000]
    y = [1_000_064, 1_000_128, 1_000_192]
    far = (3 * x[0] - sum(x)) ** 2 + (3 * y[0] - sum(y)) ** 2
    assert {int(r["deviation"]) for r in got if r["vec_id"] == 0} == {far}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, v, i, "x") for i, v in random_rows(20, 3)], "key bigint, emb array<float>, component int, whitened string")
    got = whitening.whiten(df, "key", "emb", components=2).collect()
    assert len(got) == 40 and set(got[0].asDict()) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_cholesky_and_rotations():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (6, 6), (7, 4), (31, 31)):
        root = rng.standard_normal((d, rank))
        lower, order = whitening.pivoted_cholesky(root @ root.T)
        assert lower.shape == (d, rank) and np.allclose(lower @ lower.T, (root @ root.T)[np.ix_(order, order)])
        assert np.allclose(np.triu(lower[:rank], 1), 0)
        turned = whitening.one_sided_jacobi(lower)
        assert np.allclose(turned @ turned.T, lower @ lower.T)
        dots = turned.T @ turned
        assert np.abs(dots - np.diag(np.diag(dots))).max() < 1e-10
    graded = np.diag(10.0 ** -np.arange(0, 12))
    assert np.allclose(whitening.eigen(graded)[0], np.diag(graded), rtol=1e-12)
    with pytest.raises(RuntimeError):
        whitening.one_sided_jacobi(rng.standard_normal((5, 5)), sweeps=1)
