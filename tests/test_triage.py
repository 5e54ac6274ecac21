from datetime import date

import pytest
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.operators import chartdata, facts, outliers, sensitivity, triage

CASES = [
    # entity, z, forest, status, reason
    (1, 3.5, False, "ALERTA MODERADO", "Cancelamento muito acima do grupo"),
    (2, 3.5, True, "RISCO CRÍTICO", "Cancelamento muito acima do grupo + Anomalia multivariada"),
    (3, 2.5, True, "ALERTA MODERADO", "Cancelamento acima do grupo + Anomalia multivariada"),
    (4, 1.0, True, "ALERTA MULTIVARIADO", "Anomalia multivariada"),
    (5, -5.0, False, "NORMAL", "Sem motivo adicional"),
    (6, 2.0, False, "NORMAL", "Sem motivo adicional"),
    (7, -1.0, True, "ALERTA MULTIVARIADO", "Anomalia multivariada"),
]


@pytest.fixture
def classified(spark):
    rows = [(e, date(2020, 1 + e % 3, 1), e % 2, 10, 5, 0.5, 0.125, z, f, 0.1 if f else -0.1) for e, z, f, *_ in CASES]
    df = spark.createDataFrame(
        rows,
        "entity_id long, month date, peer_group int, total long, cancelled_n long, rate double, rate_mean double, "
        "z double, flag_forest boolean, if_intensity double",
    ).withColumn("if_label", F.when(F.col("flag_forest"), F.lit(-1)).otherwise(F.lit(1)))
    return triage.classify(outliers.flag_z(df))


def test_status_reason_and_priority(classified):
    got = {r["entity_id"]: r for r in classified.collect()}
    for e, z, forest, status, reason in CASES:
        assert (got[e]["status"], got[e]["reason"]) == (status, reason)
        assert got[e]["priority"] == max(z, 0.0) + int(forest)


def test_texts(classified):
    got = {r["entity_id"]: r for r in classified.collect()}
    assert got[2]["justification"] == (
        "Taxa de cancelamento de 50.0000%; média de 12.5000% no Cluster 0; Z-Score de 3.50; combinação entre volume "
        "operacional e cancelamento classificada como atípica pelo Isolation Forest."
    )
    assert got[4]["justification"].startswith("Combinação") and got[4]["justification"].endswith("Forest.")
    assert got[5]["justification"] == labels.JUSTIFY_NONE
    assert got[1]["explanation"] == labels.EXPLAIN_CRITICAL
    assert got[3]["explanation"] == labels.EXPLAIN_MODERATE + " | " + labels.EXPLAIN_FOREST
    assert got[6]["explanation"] == labels.EXPLAIN_NONE


def test_ranking_is_total(classified):
    rows = triage.rank_alerts(classified).orderBy("position").collect()
    assert [r["entity_id"] for r in rows] == [2, 3, 1, 4, 7]
    assert [r["position"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r["entity_id"] for r in triage.top_alerts(classified, 2).collect()] == [2, 3]


def test_distributions(classified):
    status = {r["status"]: tuple(r)[1:] for r in triage.status_distribution(classified).collect()}
    assert status == {
        "RISCO CRÍTICO": (1, 20.0, 14.29), "ALERTA MODERADO": (2, 40.0, 28.57), "ALERTA MULTIVARIADO": (2, 40.0, 28.57),
    }
    assert sum(r["alerts_n"] for r in triage.reason_distribution(classified).collect()) == 5
    clusters = [tuple(r) for r in triage.alerts_by_cluster(classified).collect()]
    assert clusters == [(0, 2, 3, 40.0, 66.67), (1, 3, 4, 60.0, 75.0)]
    titles = facts.present(triage.alerts_by_cluster(classified), labels.HEADINGS["alerts_by_cluster"]).columns
    assert titles == ["Cluster", "Alertas", "Registros do Cluster", "% dos Alertas", "Taxa de Alertas no Cluster (%)"]


def test_no_alerts_at_all(classified):
    calm = classified.where("status = 'NORMAL'")
    assert triage.status_distribution(calm).count() == 0
    assert triage.reason_distribution(calm).count() == 0
    assert triage.rank_alerts(calm).count() == 0
    assert [r["alerts_n"] for r in chartdata.status_counts(calm).collect()] == [0, 0, 0]


def test_chart_tables_of_alerts(classified):
    assert [r["alerts_n"] for r in chartdata.status_counts(classified).collect()] == [1, 2, 2]
    table = {r["peer_group"]: tuple(r)[1:] for r in chartdata.crosstab(classified).collect()}
    assert table == {0: (1, 0, 1), 1: (0, 2, 1)}
    assert chartdata.top_labelled(classified, 1).first()["case_label"] == "Serventia 2 | 03/2020"
    assert sum(r["alerts_n"] for r in chartdata.alerts_by_year(classified).collect()) == 5


def test_selectivity(classified):
    row = triage.selectivity(classified, F.col("z") > 0, F.col("status") == "RISCO CRÍTICO").first()
    assert tuple(row) == (7, 5, 1, 80.0)


def test_describe(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (6, 1.5)], "a long, b double")
    got = {r["statistic"]: (r["a"], r["b"]) for r in triage.describe(df, ["a", "b"]).collect()}
    assert got["count"] == (3.0, 2.0) and got["50%"] == (2.0, 1.0) and got["max"] == (6.0, 1.5)
    assert got["25%"] == (1.5, 0.75) and got["std"][0] == pytest.approx(2.6457513)


def test_contamination_invariants(spark):
    rows = [(i, i % 7 - 2.5, -(i % 97) / 100.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, z double, score double")
    for r in sensitivity.contamination_sweep(df).collect():
        assert r["hybrid_n"] == r["only_z_n"] + r["only_forest_n"] + r["both_n"]
        assert r["forest_n"] == r["only_forest_n"] + r["both_n"] and r["critical_n"] <= r["both_n"]
    swept = {r["contamination_pct"]: r for r in sensitivity.contamination_sweep(df).collect()}
    for r in sensitivity.contamination_overlap(df).collect():
        wide = swept[r["contamination_pct"]]
        assert r["forest_shared"] == swept[1]["forest_n"] and r["forest_shared"] + r["forest_new"] == wide["forest_n"]
        assert r["hybrid_shared"] + r["hybrid_new"] == wide["hybrid_n"]


def test_method_comparison_invariants(spark):
    rows = [(i, date(2020, 1, 1), i % 3, (i * 37) % 50 + (500 if i % 60 == 0 else 0)) for i in range(600)]
    df = outliers.compare_scores(spark.createDataFrame(rows, "entity_id long, month date, peer_group int, total long")).cache()
    overlap = [r["rows_n"] for r in sensitivity.method_overlap(df).collect()]
    assert sum(overlap) == 600 and overlap[0] > 0
    methods = [r["alerts_n"] for r in sensitivity.method_comparison(df).collect()]
    assert methods == [overlap[0] + overlap[1], overlap[0] + overlap[2]]
    groups = sensitivity.method_by_cluster(df).collect()
    assert sum(r["both_n"] for r in groups) == overlap[0] and sum(r["rows_n"] for r in groups) == 600
    top = sensitivity.top_by_abs(df, "z", "flag_robust", 5).collect()
    assert [r["position"] for r in top] == [1, 2, 3, 4, 5]
    report = {r["metric"]: r["value"] for r in sensitivity.spearman_report(df).collect()}
    assert 0 < report[labels.SPEARMAN_RHO] <= 1 and report[labels.SPEARMAN_P] < 1e-6


def test_percentile_counts_add_up(spark):
    rows = [(i % 3, (i * 7919 % 101) / 100.0) for i in range(900)]
    by_group = sensitivity.percentile_vs_z(spark.createDataFrame(rows, "peer_group int, rate double"))
    total = {r["percentile"]: r for r in sensitivity.percentile_vs_z_global(by_group).collect()}
    for p in labels.PERCENTILES:
        part = [r for r in by_group.collect() if r["percentile"] == p]
        assert total[p]["percentile_alerts"] == sum(r["percentile_alerts"] for r in part) > 0
        assert all(r["shared"] <= min(r["z_alerts"], r["percentile_alerts"]) for r in part)
        assert all(r["z_kept_pct"] == 0.0 for r in part if r["z_alerts"] == 0)
