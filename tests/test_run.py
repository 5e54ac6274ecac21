import glob
import os
import shutil
import tempfile
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from peerwatch import labels, schemas
from peerwatch.operators import audit, facts
from peerwatch.plans import catalog, triage_run
from peerwatch.sources import datasets, manifest, staging


def local(path):
    return path.removeprefix("file:")


class Lost(Exception):
    """The driver is gone."""


def once(spark, sf_dir, out, **options):
    return triage_run.execute(spark, datasets.shipping(spark, sf_dir), out, datasets.SHIPPING_START, datasets.SHIPPING_END, **options)


@pytest.fixture(scope="module")
def finished(spark, sf_dir):
    """A run that was lost after `group`, and then went on; with what it did the second time."""
    out = tempfile.mkdtemp(prefix="peerwatch-run-")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(triage_run, "score", raising(Lost))
        with pytest.raises(Lost):
            once(spark, sf_dir, out)
    before = {name: modified(f"{out}/stages/{name}") for name in ("monthly_all", "monthly", "features")}
    steps = sorted(os.listdir(f"{out}/manifest"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(facts, "monthly_fact", raising(AssertionError))
        patch.setattr(triage_run, "extract", raising(AssertionError))
        patch.setattr(triage_run, "group", raising(AssertionError))
        reports = once(spark, sf_dir, out, resume=True)
    return out, steps, before, reports


def raising(error):
    def never(*args, **options):
        raise error

    return never


def modified(path):
    return max(os.path.getmtime(f) for f in glob.glob(f"{path}/*"))


def test_whole_run_writes_stages_and_reports(spark, finished):
    scratch, _, _, names = finished
    assert len(names) == len(set(names)) > 40
    for name in names:
        assert glob.glob(f"{scratch}/reports/{name}/*.csv"), name
    scored = spark.read.parquet(f"{scratch}/stages/scored")
    alerts = spark.read.parquet(f"{scratch}/stages/alerts")
    assert alerts.count() == scored.where("status <> 'NORMAL'").count() > 0
    assert scored.agg({"month": "min"}).first()[0] >= date(1996, 1, 1)
    kept = spark.read.parquet(f"{scratch}/stages/monthly").count()
    removed = spark.read.parquet(f"{scratch}/stages/removed").count()
    assert kept + removed == spark.read.parquet(f"{scratch}/stages/monthly_all").count()
    top = spark.read.option("header", True).csv(f"{scratch}/reports/top_alerts")
    assert top.columns[:4] == ["Posição", "Serventia", "Mês", "Cluster"]
    for name, titles in (("cluster_rules", "cluster_rules"), ("top_alerts_full", "top_alerts_full"), ("peer_stats", "peer_stats")):
        report = spark.read.option("header", True).csv(f"{scratch}/reports/{name}")
        assert report.columns == list(labels.HEADINGS[titles].values()) and report.count() > 0
    assert len(labels.HEADINGS["top_alerts_full"]) == 15
    assert spark.read.option("header", True).csv(f"{scratch}/reports/selectivity").columns == [
        "base_n", "global_n", "contextual_n", "reduction_pct"
    ]
    held = local(staging.folder(spark))
    assert not os.path.exists(held) or not any(n.startswith("run-") for n in os.listdir(held))


def test_a_lost_run_goes_on_after_its_last_step(spark, finished):
    out, steps, before, reports = finished
    assert steps == ["extract", "group"]
    assert {name: modified(f"{out}/stages/{name}") for name in before} == before
    assert len(reports) == len(set(reports)) > 40 and all(glob.glob(f"{out}/reports/{name}/*.csv") for name in reports)
    held = manifest.Manifest(spark, f"{out}/manifest")
    entries = [held.entry(step) for step in triage_run.STEPS]
    assert len({e.mark for e in entries}) == 5 and sum((e.reports for e in entries), []) == reports
    assert "priority:double" in entries[2].tables["scored"] and held.entry("other") is None


def test_a_finished_run_has_nothing_to_do(spark, sf_dir, finished):
    out, _, _, reports = finished
    with pytest.MonkeyPatch.context() as patch:
        for step in triage_run.STEPS:
            patch.setattr(triage_run, step, raising(AssertionError))
        assert once(spark, sf_dir, out, resume=True) == reports


def test_other_parameters_and_sources_run_anew(spark, sf_dir, finished, scratch):
    out, *_ = finished
    ran = []

    def noted(step):
        def make(run, *args):
            ran.append(step)
            raise Lost

        return make

    with pytest.MonkeyPatch.context() as patch:
        for step in triage_run.STEPS:
            patch.setattr(triage_run, step, noted(step))
        for options in ({"contamination": 0.02}, {"k": 3}, {"source": "another"}):
            with pytest.raises(Lost):
                once(spark, sf_dir, out, resume=True, **options)
        plain = spark.createDataFrame([(1, None, True)], schemas.TRANSACTIONS)  # no files: never taken for the same
        with pytest.raises(Lost):
            triage_run.execute(spark, plain, out, datasets.SHIPPING_START, datasets.SHIPPING_END, resume=True)
    assert ran == ["score", "group", "extract", "extract"]


def test_a_run_starts_at_a_staged_table(spark, finished, scratch):
    out, *_ = finished
    shutil.copytree(f"{out}/stages/features", f"{scratch}/stages/features")
    names = triage_run.execute(spark, None, scratch, first="score")
    assert {"peer_stats", "top_alerts", "persistence_bands", "alerts_by_year", "scatter"} <= set(names)
    assert not {"quality_report", "k_sweep", "flag_series", "monthly_series"} & set(names)  # the monthly table is not there
    one, two = (spark.read.parquet(f"{at}/stages/scored") for at in (out, scratch))
    assert sorted(map(str, one.select("entity_id", "month", "status").collect())) == sorted(map(str, two.select("entity_id", "month", "status").collect()))


def test_charts_of_whatever_is_there(spark, finished, scratch):
    out, *_ = finished
    assert triage_run.execute(spark, None, scratch, first="charts") == []
    shutil.copytree(f"{out}/stages/stability", f"{scratch}/stages/stability")
    assert triage_run.execute(spark, None, scratch, first="charts") == ["persistence_histogram"]


def test_staged_tables_are_checked_on_load(spark, finished, scratch):
    out, *_ = finished
    features = spark.read.parquet(f"{out}/stages/features")
    for wrong, message in (
        (features.drop("log_total"), "missing columns: log_total"),
        (features.withColumn("peer_group", F.col("peer_group").cast("string")), "peer_group is string, not int"),
        (features.withColumn("rate", F.lit(float("inf"))), r"infinite \("),
        (features.unionByName(features.limit(1)), r"duplicate_keys \(1\)"),
    ):
        wrong.write.mode("overwrite").parquet(f"{scratch}/stages/features")
        with pytest.raises(ValueError, match=message):
            triage_run.execute(spark, None, scratch, first="score")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        triage_run.execute(spark, None, scratch, first="group")


def test_marks_follow_the_files(spark, scratch):
    spark.range(5).write.parquet(f"{scratch}/t")
    read = lambda: manifest.source_mark(spark.read.parquet(f"{scratch}/t"))
    first = read()
    assert first == read() and manifest.source_mark(spark.range(3)) is None
    assert manifest.source_mark(spark.read.parquet(f"{scratch}/t").selectExpr("id AS other")) != first
    spark.range(1).write.mode("append").parquet(f"{scratch}/t")
    assert read() != first


def test_run_takes_dates_that_are_not(spark, sf_dir, scratch):
    raw = triage_run.extract(
        triage_run.Run(spark, scratch), datasets.shipping_with_bad_dates(spark, sf_dir), datasets.SHIPPING_START, datasets.SHIPPING_END
    )
    assert raw.where("month IS NULL").count() == 0
    reasons = {r["Motivo"]: int(r["Quantidade"]) for r in spark.read.option("header", True).csv(f"{scratch}/reports/removal_reasons").collect()}
    assert set(reasons) == {"Datas inválidas", "Antes de 1996", "Após junho de 2001"} and reasons["Datas inválidas"] > 0


def test_default_period_has_the_published_reasons():
    assert audit.reason_titles(labels.PERIOD_START, labels.PERIOD_END) == ("Datas inválidas", "Antes de 2016", "Após julho de 2025")
    assert audit.reason_titles(date(2016, 3, 1), "2020-12-01")[1:] == ("Antes de março de 2016", "Após dezembro de 2020")


def test_runs_own_what_they_stage(spark, sf_dir):
    with staging.run_folder(spark) as path:
        for name in ("features", "standardise", "zscore_peer"):
            assert catalog.QUERIES[name](spark, sf_dir).count() > 0
        assert sum(n.startswith("features-") for n in os.listdir(local(path))) == 1
    assert not os.path.exists(local(path))


def test_a_checkpoint_folder_set_by_the_program_comes_first():
    def session(chosen):
        folder = SimpleNamespace(isDefined=lambda: chosen is not None, get=lambda: chosen)
        java = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder))
        return SimpleNamespace(sparkContext=SimpleNamespace(_jsc=java), conf=SimpleNamespace(get=lambda key, default: "default/"))

    assert staging.shared_root(session("file:/own/")) == "file:/own"
    assert staging.shared_root(session(None)) == "default"
