import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.functions import special


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_rate_floors_the_denominator(spark):
    assert values(spark, [(0, 0), (1, 4)], "c long, t long", C.rate("c", "t")) == [(0.0,), (0.25,)]


def test_percent_rounds_half_to_even_and_survives_zero(spark):
    got = values(spark, [(1, 800), (3, 800), (1, 0)], "a long, b long", C.percent("a", "b"))
    assert got == [(0.12,), (0.38,), (None,)]


def test_direction(spark):
    got = values(spark, [(1.0,), (-0.5,), (0.0,)], "x double", C.direction("x"))
    assert [g[0] for g in got] == [labels.ABOVE, labels.BELOW, labels.AT_CENTRE]


def test_persistence_band_edges(spark):
    rows = [(99.0,), (95.0,), (80.0,), (79.99,), (None,)]
    got = [g[0] for g in values(spark, rows, "x double", C.persistence_band("x"))]
    assert got == [name for name, _ in labels.BANDS] + [None]


def test_band_keeps_cut_points_below(spark):
    got = values(spark, [(5,), (6,), (9,), (10,)], "x long", C.band("x", [5.0, 7.0, 9.0]))
    assert [g[0] for g in got] == [0, 1, 2, 3]


def test_lookup_of_unknown_key_is_null(spark):
    assert values(spark, [(1,), (9,)], "g int", C.lookup("g", labels.PEER_NAMES)) == [("Pequeno porte",), (None,)]


def test_hash_of_columns_equals_hash_of_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-(2**62), 2**62), rng.randrange(30000), rng.randrange(9)) for _ in range(200)]
    got = values(spark, rows, "a long, b long, c long", C.fold32(F.col("a"), F.col("b"), F.col("c"), F.lit(42)))
    assert [g[0] for g in got] == [C.fold32_int(a, b, c, 42) for a, b, c in rows]


def test_hash_is_uniform_and_seeds_are_independent():
    first = np.array([C.uniform(C.fold32_int(e, m, 1)) for e in range(60) for m in range(24000, 24060)])
    second = np.array([C.uniform(C.fold32_int(e, m, 2)) for e in range(60) for m in range(24000, 24060)])
    cells = np.histogram2d(first, second, bins=10, range=[(0, 1), (0, 1)])[0]
    expected = len(first) / 100
    assert ((cells - expected) ** 2 / expected).sum() < 160  # 99 degrees of freedom
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.06


@pytest.mark.parametrize("a, b, x, want", [(2, 3, 0.5, 0.6875), (0.5, 0.5, 0.25, 1 / 3), (5, 1, 0.9, 0.9**5)])
def test_incomplete_beta(a, b, x, want):
    assert special.incomplete_beta(a, b, x) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("t, n, want", [(2.0, 12, 0.07338803477), (1.0, 3, 0.5), (0.0, 30, 1.0), (2.776445105, 6, 0.05)])
def test_two_sided_p(t, n, want):
    assert special.two_sided_p(t, n) == pytest.approx(want, rel=1e-7)


def test_correlation_t_edges():
    assert special.correlation_t(1.0, 10) == math.inf
    assert special.two_sided_p(math.inf, 10) == 0.0
    assert special.correlation_t(0.5, 2) is None
    assert special.two_sided_p(None, 2) is None


def test_average_path():
    assert special.average_path(1) == 0.0
    assert special.average_path(2) == 1.0
    assert special.average_path(256) == pytest.approx(10.244770920, rel=1e-9)
