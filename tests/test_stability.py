from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.operators import chartdata, stability


@pytest.fixture
def moves(spark):
    def month(y, m):
        return date(y, m, 1)

    rows = [
        (1, month(2020, 1), 0), (1, month(2020, 3), 1),  # a gap: nothing to compare
        (2, month(2019, 12), 2), (2, month(2020, 1), 2),  # across the year
        (3, month(2020, 1), 0), (3, month(2020, 2), 1), (3, month(2020, 3), 0), (3, month(2020, 4), 1),  # tie
        (4, month(2020, 5), 3),
        (5, None, 1),
    ]
    return stability.transitions(spark.createDataFrame(rows, "entity_id long, month date, peer_group int").repartition(3))


def test_only_consecutive_months_compare(moves):
    got = {(r["entity_id"], r["month"]): r for r in moves.collect()}
    assert len(got) == 9
    gap = got[(1, date(2020, 3, 1))]
    assert gap["distance"] == 2 and not gap["comparable"] and not gap["changed"] and not gap["stayed"]
    turn = got[(2, date(2020, 1, 1))]
    assert turn["distance"] == 1 and turn["stayed"] and not turn["changed"]


def test_entity_figures(moves):
    got = {r["entity_id"]: tuple(r)[1:] for r in stability.stability(moves).collect()}
    assert got[1] == (2, 0, 0, 0, None, 0, 2)
    assert got[2] == (2, 1, 0, 1, 100.0, 2, 1)
    assert got[3] == (4, 3, 3, 0, 0.0, 0, 2)
    assert got[4] == (1, 0, 0, 0, None, 3, 1)


def test_bands_summary_and_matrix(moves):
    stable = stability.stability(moves)
    bands = [(r["band"], r["entities_n"], r["entities_pct"]) for r in stability.persistence_bands(stable).collect()]
    assert [b[1] for b in bands] == [1, 0, 0, 1, 2] and bands[-1] == ("Total", 2, 100.0)
    summary = {r["indicator"]: r["value"] for r in stability.persistence_summary(stable).collect()}
    assert [summary[t] for t in labels.PERSISTENCE_ROWS] == [4, 2, 2, 1, 0, 0, 1, 1, 50, 50, 0, 100, 1.5, 1.5, 3]
    assert [tuple(r) for r in stability.transition_matrix(moves).collect()] == [(0, 1, 2), (1, 0, 1)]
    assert [r["entity_id"] for r in stability.least_stable(stable, 1).collect()] == [3]
    bins = chartdata.persistence_histogram(stable).collect()
    assert len(bins) == 20 and bins[0]["rows_n"] == 1 and bins[19]["rows_n"] == 1


def test_no_comparable_entity(spark, moves):
    none = stability.stability(moves.where("entity_id = 4"))
    assert [r["entities_n"] for r in stability.persistence_bands(none).collect()] == [0] * 5
    assert stability.least_stable(none).count() == 0


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(9).normal(size=2000)
    got = chartdata.histogram(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 50).collect()
    counts, edges = np.histogram(x, 50)
    assert [r["rows_n"] for r in got] == counts.tolist()
    np.testing.assert_allclose([r["bin_start"] for r in got], edges[:-1])


def test_histogram_of_constant_and_empty_columns(spark):
    same = chartdata.histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 10).collect()
    assert sum(r["rows_n"] for r in same) == 3 and same[0]["bin_start"] == 1.5
    none = chartdata.histogram(spark.createDataFrame([], "x double"), "x", 10).collect()
    assert [r["rows_n"] for r in none] == [0] * 10


def test_boxes_trim_and_clip(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [*range(11), 100]], "peer_group int, x double")
    box = chartdata.box_stats(df, "x").first()
    q = np.quantile([*range(11), 100], [0.25, 0.5, 0.75])
    assert (box["q1"], box["median"], box["q3"]) == pytest.approx(tuple(q))
    assert (box["whisker_low"], box["whisker_high"], box["outliers_n"]) == (0.0, 10.0, 1)
    assert chartdata.trim_upper(df, "x", 0.9).count() == 10
    assert chartdata.clip_upper(df, "x", 0.9).agg(F.max("clipped")).first()[0] == pytest.approx(9.9)


def test_limit_falls_back_to_the_maximum(spark):
    df = spark.createDataFrame([(0.0,)] * 99 + [(4.0,)], "x double")
    assert chartdata.upper_limit(df, "x", 0.5) == 4.0


def test_sample_is_repeatable(spark):
    df = spark.range(5000).select((F.col("id") % 70).alias("entity_id"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("month"))
    first = chartdata.sample_rows(df, 100).collect()
    again = chartdata.sample_rows(df.repartition(7), 100).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len(first) == 100
