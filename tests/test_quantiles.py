import numpy as np
import pytest
from pyspark.sql import functions as F

from peerwatch.operators import quantiles as Q

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.975, 1.0]


def frame(spark, groups, parts=7):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double").repartition(parts)


def check(spark, groups, parts=7):
    got = {r["g"]: (r["n"], r["q"]) for r in Q.group_quantiles(frame(spark, groups, parts), ["v"], PROBS, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs)
        np.testing.assert_allclose(got[g][1], np.quantile(np.asarray(vs, float), PROBS), rtol=1e-12, atol=1e-12)


def test_small_groups_are_counted_exactly(spark):
    check(spark, {"one": [3], "two": [1, 2], "four": [4, 1, 3, 2], "same": [7] * 9})


@pytest.mark.parametrize("octave, cells", [(1, 2), (4, 16), (1024, 4096)])
def test_cells_close_in_on_large_groups(spark, monkeypatch, octave, cells):
    """Coarse cells take more passes and end at the same values."""
    monkeypatch.setattr(Q, "_RATIO", Q._RATIO.replace("1024", str(octave)))
    monkeypatch.setattr(Q, "_WIDTH", Q._WIDTH.replace("4096", str(cells)).replace("4095", str(cells - 1)))
    rng = np.random.default_rng(3)
    check(
        spark,
        {
            "smooth": rng.normal(size=4000),
            "tied": rng.integers(0, 5, size=3001),
            "hot": np.concatenate([np.zeros(3000), rng.exponential(size=1500)]),
            "skewed": rng.pareto(0.5, size=2503),
            "tiny": [1.0, 5.0],
            "wide": [-1.7e308, -1e300, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2.0), 1e300, 1.7e308],
            "signed": rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, size=500),
        },
    )


def test_hot_group_over_many_partitions(spark):
    rng = np.random.default_rng(4)
    check(spark, {"hot": rng.integers(0, 10_000, 20_000) / 7, "cold": rng.normal(size=11)}, parts=200)


def test_infinities_are_values_and_nan_is_none(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, nan, -inf, inf)], "v double")
    assert Q.quantile_values(df, "v", [0.0, 1 / 3, 2 / 3, 1.0]) == [-inf, 1.0, 2.0, inf]
    row = Q.group_quantiles(spark.createDataFrame([(1.0,), (2.0,), (nan,)], "v double"), ["v"], [0.5]).first()
    assert (row["n"], row["q"]) == (2, [1.5])


def test_null_groups_stand_for_themselves(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 9.0)], "g string, v double")
    assert {r["g"]: r["q"] for r in Q.group_quantiles(df, ["v"], [0.5], ["g"]).collect()} == {None: [2.0], "a": [9.0]}


def test_no_pass_gathers_a_column(spark, monkeypatch):
    """No window, and no exchange on the column alone: rows meet per cell."""
    plans = []
    real = Q._counted

    def watched(rows, keys, cell, *more):
        plan = rows.selectExpr(*keys, "v", cell).groupBy(*keys, "cell").count()._jdf.queryExecution().executedPlan().toString()
        plans.append(plan)
        return real(rows, keys, cell, *more)

    monkeypatch.setattr(Q, "_counted", watched)
    Q.quantile_values(spark.range(5000).selectExpr("sqrt(id) AS v"), "v", [0.3, 0.5])
    assert len(plans) > 1
    for plan in plans:
        assert "Window" not in plan and "partial_count" in plan and ", cell#" in plan[plan.index("hashpartitioning"):]


@pytest.mark.parametrize("groups", [4, 100_000])
def test_any_number_of_groups_takes_one_path(spark, monkeypatch, groups):
    """Medians per entity; what comes back to the driver meanwhile is one count per pass."""
    counts = []
    real = Q._stage_pass
    monkeypatch.setattr(Q, "_stage_pass", lambda cells: counts.append(real(cells)) or counts[-1])
    df = spark.range(400_000).selectExpr(f"pmod(id, {groups}) AS g", f"CAST(id DIV {groups} AS double) AS v")
    got = Q.quantile_columns(df, {"mid": ("v", 0.5)}, ["g"])
    last = 400_000 // groups - 1
    row = got.agg(F.count("g").alias("n"), F.min("mid").alias("lo"), F.max("mid").alias("hi")).first()
    assert (row["n"], row["lo"], row["hi"]) == (groups, last / 2, last / 2)
    assert all(isinstance(still, int) for _, still in counts) and counts[-1][1] == 0 and len(counts) == (2 if groups == 4 else 1)


def test_open_cells_of_many_groups(spark):
    """Values so close that the first cells hold several: a second pass over all groups at once."""
    df = spark.range(30_000).selectExpr("pmod(id, 3000) AS g", "1 + (id DIV 3000) * 1e-9 AS v")
    got = {r["g"]: r["q"][0] for r in Q.group_quantiles(df, ["v"], [0.5], ["g"]).collect()}
    assert len(got) == 3000 and all(abs(q - (1 + 4.5e-9)) < 1e-15 for q in got.values())


def test_groups_without_numbers(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0)], "g string, v double")
    found = {r["g0"]: r for r in Q.summarise(df, ["v"], ["g"], Q.around([0.5])).collect()}
    assert (found["a"]["rows"], found["a"]["n"], found["a"]["at"]) == (2, 0, {}) and found["b"]["at"] == {0: 2.0}
    assert Q.quantile_columns(df.limit(0), {"mid": ("v", 0.5)}).collect() == []


def test_nth_smallest(spark):
    df = spark.createDataFrame([(v,) for v in [5, 3, 3, 9, None]], "v long")
    assert [Q.nth_smallest(df, "v", n) for n in (1, 2, 3, 4, 9)] == [3, 3, 5, 9, 9]
    assert Q.nth_smallest(df.limit(0), "v", 1) is None


def test_nulls_do_not_count_and_columns_mix(spark):
    df = spark.createDataFrame([(1.0, 10), (None, 20), (3.0, 30)], "a double, b long")
    got = {r["variable"]: (r["n"], r["q"]) for r in Q.group_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {"a": (2, [2.0]), "b": (3, [20.0])}


def test_named_columns(spark):
    df = frame(spark, {"x": range(11), "y": range(21)})
    row = Q.quantile_columns(df, {"mid": ("v", 0.5), "high": ("v", 0.9)}, ["g"]).where(F.col("g") == "y").first()
    assert (row["mid"], row["high"]) == (10.0, 18.0)


def test_empty_column_gives_nan(spark):
    df = spark.createDataFrame([], "v double")
    assert np.isnan(Q.quantile_values(df, "v", [0.5])).all()
