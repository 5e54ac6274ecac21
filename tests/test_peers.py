import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerwatch.operators import peer_metrics, peers


@pytest.fixture(scope="module")
def volumes():
    rng = np.random.default_rng(11)
    parts = [rng.normal(m, 0.3, n) for m, n in ((1, 400), (4, 300), (6, 200), (9, 100))]
    return np.round(np.concatenate(parts), 3)


def frame(spark, values, parts=4):
    pdf = pd.DataFrame({"entity_id": np.arange(len(values)), "log_total": values})
    return spark.createDataFrame(pdf).withColumn("month", F.lit("2020-01-01").cast("date")).repartition(parts)


def test_kmeans_properties(spark, volumes):
    df = frame(spark, volumes)
    model = peers.fit_peers(df)
    x = (volumes - volumes.mean()) / volumes.std()
    gaps = np.abs(x[:, None] - np.array(model.centres)[None, :])
    label = gaps.argmin(axis=1)
    # every centre is the mean of its members, up to the stopping tolerance
    np.testing.assert_allclose([x[label == g].mean() for g in range(4)], model.centres, atol=0.02)
    assert model.inertia == pytest.approx((gaps.min(axis=1) ** 2).sum(), rel=1e-9)
    rows = model.assign(df).toPandas().sort_values("entity_id")
    assert (rows["peer_group"].to_numpy() == label).all()
    assert model.inertia <= peers.fit_peers(df, n_init=1).inertia + 1e-9


def test_kmeans_does_not_depend_on_partitioning(spark, volumes):
    one, many = peers.fit_peers(frame(spark, volumes, 1)), peers.fit_peers(frame(spark, volumes, 9))
    np.testing.assert_allclose(one.centres, many.centres, rtol=1e-9)


def test_sweep_shares_fits_with_single_runs(spark, volumes):
    df = frame(spark, volumes)
    models = peers.fit_many(df, "log_total", [2, 4], n_init=4)
    assert models[2].inertia > models[4].inertia
    assert [len(models[k].centres) for k in (2, 4)] == [2, 4]


def test_fewer_values_than_groups_is_an_error(spark):
    with pytest.raises(ValueError, match="1 distinct values"):
        peers.fit_peers(frame(spark, np.full(50, 3.0)))
    with pytest.raises(ValueError, match="2 distinct values"):
        peers.fit_peers(frame(spark, np.array([1.0, 2.0] * 9)), k=3)
    assert peers.fit_peers(frame(spark, np.full(50, 3.0)), k=1).centres == [0.0]


def test_unsettled_restarts_are_an_error(spark, volumes):
    with pytest.raises(RuntimeError, match="not settled after 1"):
        peers.fit_peers(frame(spark, volumes), max_iterations=1)


def test_tied_starting_points_are_an_error(spark):
    with pytest.raises(ValueError, match="starting points"):
        peers.fit_lloyd(frame(spark, np.array([1.0] * 90 + [2.0, 3.0, 4.0, 5.0])))


def test_array_hash_equals_the_plain_one():
    from peerwatch.functions import columns as C

    values = np.array([0, 1, -1, 10**15, -(10**15), 2**62])
    assert C.fold32_array(values, 7, 42).tolist() == [C.fold32_int(int(v), 7, 42) for v in values]


def test_lloyd_improves_on_its_start(spark, volumes):
    df = frame(spark, volumes)
    costs = [peers.fit_lloyd(df, iterations=i).inertia for i in (0, 2, 8)]
    assert costs[0] >= costs[1] >= costs[2]


def test_relabel_orders_by_mean(spark, volumes):
    df = peers.quantile_bands(frame(spark, volumes), "log_total").withColumn("raw", (F.col("peer_group") * 3 + 1) % 4)
    again = peers.relabel_by_mean(df.withColumnRenamed("peer_group", "true_group"), "raw")
    assert again.where("true_group <> peer_group").count() == 0


def test_quality_against_brute_force(spark, volumes):
    x = volumes[::7]
    label = np.digitize(x, [2.5, 5, 7.5])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "peer_group": label})).repartition(5)
    row = peer_metrics.cluster_quality(df, "x").first()
    groups = [x[label == g] for g in range(4)]
    centres = np.array([g.mean() for g in groups])
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    spread = np.array([np.abs(g - g.mean()).mean() for g in groups])
    worst = [
        max((spread[i] + spread[j]) / abs(centres[i] - centres[j]) for j in range(4) if j != i) for i in range(4)
    ]
    assert row["inertia"] == pytest.approx(within)
    assert row["davies_bouldin"] == pytest.approx(np.mean(worst))
    assert row["calinski_harabasz"] == pytest.approx(between / 3 / (within / (len(x) - 4)))
    assert (row["smallest"], row["largest"]) == (min(map(len, groups)), max(map(len, groups)))


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=120), 1)
    label = np.digitize(x, [-0.5, 0.5])
    label[0] = 3  # a group of one row scores zero
    scores = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = np.abs(x[own] - x[i]).sum() / (own.sum() - 1)
        b = min(np.abs(x[label == g] - x[i]).mean() for g in range(4) if g != label[i])
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "peer_group": label}))
    assert peer_metrics.silhouette(df, "x", 4).first()[0] == pytest.approx(np.mean(scores))


def test_k_sweep_shape(spark, volumes):
    rows = peer_metrics.k_sweep(frame(spark, volumes), ks=(2, 3, 4), n_init=3).collect()
    assert [r["k"] for r in rows] == [2, 3, 4]
    assert rows[0]["inertia"] > rows[1]["inertia"] > rows[2]["inertia"]
    assert max(rows, key=lambda r: r["silhouette"])["k"] == 4
    assert all(r["smallest"] <= r["largest"] for r in rows)


def test_profile_rules(spark):
    rows = [(0, 1, 10, 0.5, 0.0), (1, 1, 40000, 0.1, 0.0), (2, 1, 10, 0.1, 0.95), (3, 1, 10, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "peer_group int, entity_id long, total long, rate double, missing double")
    named = {r["peer_group"]: r["profile"] for r in peer_metrics.cluster_rules(df, missing="missing").collect()}
    assert named == {
        0: "Alta taxa de cancelamento", 1: "Alto volume operacional",
        2: "Alta incidência de selos sem guia", 3: "Baixa incidência de selos sem guia",
    }
    bare = {r["peer_group"]: (r["profile"], r["missing_mean_pct"]) for r in peer_metrics.cluster_rules(df).collect()}
    assert bare[2] == ("Baixa incidência de selos sem guia", None)


def test_a_task_sends_its_sums_once(spark, volumes, monkeypatch):
    sent = []
    gather = peers._partials
    monkeypatch.setattr(peers, "_partials", lambda *a: sent.append(gather(*a)) or sent[-1])
    df = frame(spark, volumes)
    whole = peers.fit_many(df, "log_total", [2, 4], n_init=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        sent.clear()
        hist = peers.histogram(df, "log_total")
        tasks = hist.counts.rdd.getNumPartitions()
        small = peers.fit_many(df, "log_total", [2, 4], n_init=3, hist=hist)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert hist.distinct > 16 * 2 * tasks
    assert max(map(len, sent)) <= tasks * 3 * (2 + 4)
    for k in (2, 4):
        np.testing.assert_allclose(small[k].centres, whole[k].centres, rtol=1e-9)


def test_running_sums_against_all_values(spark, volumes, monkeypatch):
    """Any edge, on a value, between values, between blocks, and beyond all."""
    monkeypatch.setattr(peers, "BLOCK", 8)
    hist = peers.histogram(frame(spark, volumes), "log_total")
    x = (volumes - hist.mean) / hist.std
    edges = np.concatenate((np.sort(x)[::37], np.linspace(-4, 4, 50), [-np.inf, np.inf]))
    want = [(len(v), v.sum(), (v * v).sum()) for v in (x[x <= e + 1e-13] for e in edges)]
    np.testing.assert_allclose(hist.sums.upto(edges + 1e-13), want, rtol=1e-9, atol=1e-9)
    assert len(hist.sums.ids) > 50 and (np.diff(hist.sums.low) > 0).all()


def test_scatter_of_bands_against_all_values(spark, volumes):
    hist = peers.histogram(frame(spark, volumes), "log_total")
    x = (volumes - hist.mean) / hist.std
    cuts = {2: [0.1], 4: [-0.9, -0.9, 1.3]}  # two equal cuts leave a band empty
    for k, g, centre, n, apart, squares in peers.band_scatter(hist, cuts):
        v = x[np.searchsorted(cuts[k], x, side="left") == g]
        assert n == len(v) and centre == pytest.approx(v.mean())
        assert apart == pytest.approx(np.abs(v - v.mean()).sum()) and squares == pytest.approx(((v - v.mean()) ** 2).sum())
    assert len(peers.band_scatter(hist, cuts)) == 5


@pytest.mark.parametrize("distinct", [2_000, 200_000])
def test_values_read_do_not_grow_with_distinct_values(spark, monkeypatch, distinct):
    """An iteration opens at most a block per border; the bound is the same for a hundred times the values."""
    monkeypatch.setattr(peers, "BLOCK", 64)
    hist = peers.histogram(spark.range(distinct).selectExpr(f"sqrt(id / {distinct}) AS v"), "v")
    assert hist.distinct == distinct and len(hist.sums.ids) >= distinct // 64
    sizes = []
    real = peers.SortedCounts._open
    monkeypatch.setattr(peers.SortedCounts, "_open", lambda self, wanted: sizes.append(len(wanted)) or real(self, wanted))
    models = peers.fit_many(None, "v", [2, 4], n_init=3, hist=hist)
    borders = 3 * (2 + 4)
    assert len(sizes) > 5 and max(sizes) <= borders
    assert sum(len(x) for x, _ in hist.sums.held.values()) <= 64 * len(hist.sums.held) and max(map(len, (x for x, _ in hist.sums.held.values()))) <= 64
    assert models[4].inertia < models[2].inertia


def test_opened_blocks_are_bounded(spark, volumes, monkeypatch):
    monkeypatch.setattr(peers, "BLOCK", 4)
    monkeypatch.setattr(peers, "BLOCKS_HELD", 6)
    hist = peers.histogram(frame(spark, volumes), "log_total")
    model = peers.fit_many(None, "log_total", [4], n_init=3, hist=hist)[4]
    want = peers.fit_peers(frame(spark, volumes), n_init=3)
    np.testing.assert_allclose(model.centres, want.centres, rtol=1e-9)
    assert len(hist.sums.held) <= 3 * 4
