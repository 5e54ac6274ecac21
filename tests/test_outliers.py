import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerwatch.operators import outliers


@pytest.fixture
def df(spark):
    rows = [(0, 1, v) for v in (0.1, 0.2, 0.3, 0.9)] + [(1, 1, 0.5)] * 3 + [(2, 1, 0.7)] + [(3, 1, 0.0)] * 2
    return spark.createDataFrame(rows, "peer_group int, total long, rate double")


def by_group(frame, column):
    out = {}
    for r in frame.collect():
        out.setdefault(r["peer_group"], []).append(r[column])
    return {g: sorted(v, key=lambda x: (x is None, x)) for g, v in out.items()}


def test_zero_deviation_policies(df):
    floor = by_group(outliers.zscore(df, "rate"), "z")
    assert floor[1] == [0.0] * 3 and floor[2] == [0.0] and floor[3] == [0.0] * 2
    x = np.array([0.1, 0.2, 0.3, 0.9])
    np.testing.assert_allclose(floor[0], (x - x.mean()) / x.std(ddof=1))
    population = by_group(outliers.zscore(df, "rate", ddof=0, zero_std="none"), "z")
    np.testing.assert_allclose(population[0], (x - x.mean()) / x.std())
    assert population[1] == [None] * 3 and population[2] == [None]
    filled = by_group(outliers.zscore(df, "rate", zero_std="null_to_zero"), "z")
    assert filled[1] == [0.0] * 3 and filled[2] == [0.0]
    with pytest.raises(ValueError):
        outliers.zscore(df, "rate", zero_std="other")


def test_peer_statistics_and_ratio(df):
    stats = {r["peer_group"]: r for r in outliers.peer_stats(df).collect()}
    assert stats[2]["rate_std"] == 1e-9 and stats[0]["rate_median"] == pytest.approx(0.25)
    assert stats[0]["rate_p90"] == pytest.approx(np.quantile([0.1, 0.2, 0.3, 0.9], 0.9))
    scored = outliers.score_against_peers(df)
    assert by_group(scored, "ratio")[3] == [None, None]
    assert by_group(scored, "gap_pp")[1] == pytest.approx([0.0] * 3)


def test_attach_does_not_change_the_row_count(df):
    assert outliers.score_against_peers(df).count() == df.count()


def test_limits_are_strict_and_null_is_no_alert(spark):
    frame = spark.createDataFrame([(2.0,), (2.1,), (-5.0,), (None,)], "z double")
    got = [tuple(r) for r in frame.select(outliers.exceeds("z", 2.0), outliers.exceeds("z", 2.0, "both")).collect()]
    assert got == [(False, False), (True, True), (False, True), (False, False)]


def test_mad_with_zero_spread_uses_the_floor(spark):
    rows = [(0, 7)] * 6 + [(0, 8)] + [(1, v) for v in (1, 2, 3, 4, 100)]
    frame = spark.createDataFrame(rows, "peer_group int, total long")
    mads = {r["peer_group"]: (r["value_median"], r["mad"]) for r in outliers.mad(frame, "total").collect()}
    assert mads == {0: (7.0, 0.0), 1: (3.0, 1.0)}
    scored = {(r["peer_group"], r["total"]): (r["robust_z"], r["flag_robust"]) for r in outliers.robust_zscore(frame).collect()}
    assert scored[(0, 8)] == (pytest.approx(674.5), True)
    assert scored[(1, 100)] == (pytest.approx(0.6745 * 97), True)
    assert scored[(0, 7)] == (0.0, False)
    marked = {r["peer_group"]: r["mad_zero"] for r in outliers.mad_diagnostics(frame, "total").collect()}
    assert marked == {0: True, 1: False}


def test_value_equal_to_the_percentile_is_not_flagged(spark):
    frame = spark.createDataFrame([(0, float(v)) for v in range(101)], "peer_group int, rate double")
    ruled = {r["rate"]: r["above"] for r in outliers.percentile_rule(frame).collect()}
    assert ruled[95.0] == [False, False, False] and ruled[96.0] == [True, False, False] and ruled[100.0] == [True] * 3
    limits = [r["limit_value"] for r in outliers.percentile_limits(frame, "rate").orderBy("percentile").collect()]
    assert limits == pytest.approx([95.0, 97.5, 99.0])


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 400).astype(float), rng.integers(0, 9, 400).astype(float)
    b = b + a
    want = np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    row = outliers.spearman(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(6), "a", "b").first()
    assert row["n"] == 400 and row["rho"] == pytest.approx(want, rel=1e-12)


def test_global_zscore_of_constant_base(spark):
    frame = spark.createDataFrame([(0.5,), (0.5,)], "rate double")
    assert [r["z_global"] for r in outliers.global_zscore(frame).collect()] == [0.0, 0.0]


def test_statistics_join_is_chosen_by_size(spark):
    from peerwatch.sources.staging import attach

    left = spark.range(300).withColumnRenamed("id", "g")
    stats = left.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(left, stats, ["g"])
    assert joined.count() == 300 and joined.where("n = 1").count() == 300
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
