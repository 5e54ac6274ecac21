from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import months
from peerwatch import labels, schemas
from peerwatch.operators import audit, facts

START, END = date(2016, 1, 1), date(2025, 7, 1)


@pytest.fixture
def raw(spark):
    return months(spark, [
        (1, "2015-12", 5, 1), (1, "2016-01", 5, 2), (1, "2025-07", 8, 0), (1, "2025-08", 1, 1),
        (2, "2014-03", 3, 0), (2, "2014-04", 3, 0), (3, None, 2, 2), (3, "2020-05", 4, 1), (None, "2020-05", 1, 0),
    ])


def test_monthly_fact_counts_three_states(spark):
    rows = [(7, "2020-03-05 10:00:00", True), (7, "2020-03-09 00:00:00", False), (7, "2020-03-31 23:59:59", None)]
    df = spark.createDataFrame(rows, "entity_id long, event_ts string, cancelled boolean")
    got = facts.monthly_fact(df.withColumn("event_ts", F.to_timestamp("event_ts"))).collect()
    assert [tuple(r) for r in got] == [(7, date(2020, 3, 1), 3, 1, 1, 1)]


def test_bad_dates_and_numbers_become_null(spark):
    df = spark.createDataFrame([("2020-01-02", "1.5"), ("n/a", "x")], "d string, n string")
    got = facts.coerce_numeric(facts.coerce_date(df, "d"), ["n"]).collect()
    assert [tuple(r) for r in got] == [(date(2020, 1, 2), 1.5), (None, None)]


def test_cut_keeps_both_ends(raw):
    kept = facts.period_cut(raw, START, END)
    assert {r["month"] for r in kept.collect()} == {date(2016, 1, 1), date(2025, 7, 1), date(2020, 5, 1)}


def test_cut_on_the_transaction_time_equals_the_month_cut(spark):
    rows = [(1, t, True) for t in ("2015-12-31 23:59:59", "2016-01-01 00:00:00", "2025-07-31 23:59:59", "2025-08-01 00:00:00")]
    df = spark.createDataFrame(rows, "entity_id long, event_ts string, cancelled boolean")
    df = df.withColumn("event_ts", F.to_timestamp("event_ts"))
    early = facts.monthly_fact(facts.within_months(df, START, END))
    late = facts.period_cut(facts.monthly_fact(df), START, END)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect()))


def test_kept_and_removed_partition_the_table(raw):
    removed = audit.removed_rows(raw, START, END)
    assert removed.count() + facts.period_cut(raw, START, END).count() == raw.count()
    union = raw.where("month IS NULL").unionByName(raw.where(F.col("month") < START)).unionByName(raw.where(F.col("month") > END))
    assert sorted(map(str, removed.drop("reason").collect())) == sorted(map(str, union.collect()))


def test_reasons_keep_zero_rows(spark, raw):
    counts = {r["reason"]: r["rows_n"] for r in audit.removal_reasons(raw, START, END).collect()}
    assert counts == dict(zip(audit.reason_titles(START, END), (1, 3, 1)))
    none = audit.removal_reasons(raw.where("entity_id = 99"), START, END).collect()
    assert [r["rows_n"] for r in none] == [0, 0, 0]


def test_before_after_matches_the_join_form(raw):
    fast = audit.before_after(raw, START, END).collect()
    joined = audit.before_after_joined(raw, facts.period_cut(raw, START, END), F.col("entity_id"), "entity_id").collect()
    assert sorted(map(tuple, fast)) == sorted(map(tuple, joined))
    assert {r["entity_id"]: r["removed_pct"] for r in fast} == {1: 50.0, 2: 100.0, 3: 50.0}


def test_excluded_entities_and_their_years(raw):
    by_entity = audit.before_after(raw, START, END)
    assert [r["entity_id"] for r in audit.excluded_entities(by_entity).collect()] == [2]
    years = audit.excluded_entity_years(raw, START, END).collect()
    assert [tuple(r) for r in years] == [(2, 2014, 2)]
    stats = [r["value"] for r in audit.removal_stats(by_entity).orderBy("position").collect()]
    assert stats == [3.0, 2.0, 1.0, 50.0, 50.0, 0.0, 50.0, 50.0]


def test_null_and_duplicate_census(raw):
    nulls = {r["column_name"]: r["nulls_n"] for r in audit.null_counts(raw).collect()}
    assert nulls["entity_id"] == 1 and nulls["month"] == 1 and nulls["total"] == 0
    assert audit.duplicate_keys(raw.union(raw.limit(2)), schemas.KEY).first()["duplicates_n"] == 2


def test_validation_names_every_failed_gate(spark, raw):
    with pytest.raises(ValueError, match=r"missing_columns \(1\).*nulls \(2\)"):
        audit.validate(raw, [*schemas.KEY, "rate"], ["total"], schemas.KEY)
    clean = raw.dropna().withColumn("peer_group", F.lit(0))
    with pytest.raises(ValueError, match=r"small_groups \(1\)"):
        audit.validate(clean, schemas.KEY, ["total"], schemas.KEY, "peer_group")
    with pytest.raises(ValueError, match=r"empty \(1\)"):
        audit.validate(clean.where("total < 0"), schemas.KEY, ["total"], schemas.KEY)
    with pytest.raises(ValueError, match=r"infinite \(7\)"):
        audit.validate(clean.withColumn("rate", F.lit(float("inf"))), schemas.KEY, ["rate"], schemas.KEY)
    assert audit.validate(clean, schemas.KEY, ["total"], schemas.KEY, "peer_group", min_rows=1) is clean


def gated(spark, df, path, *args, **options):
    gate = audit.Gate(*args, **options)
    gate.watch(df).write.mode("overwrite").parquet(path)
    return gate.verify(spark.read.parquet(path))


def test_gates_on_a_write_name_every_failed_one(spark, raw, scratch):
    clean = raw.dropna().withColumn("peer_group", F.lit(0))
    for df, args, options, message in (
        (raw, ([*schemas.KEY, "rate"], ["total"], schemas.KEY), {}, r"missing_columns \(1\), nulls \(2\)"),
        (clean, (schemas.KEY, ["total"], schemas.KEY, "peer_group"), {}, r"small_groups \(1\)"),
        (clean.where("total < 0"), (schemas.KEY, ["total"], schemas.KEY), {}, r"empty \(1\)"),
        (clean.withColumn("rate", F.lit(float("inf"))), (schemas.KEY, ["rate"], schemas.KEY), {}, r"infinite \(7\)"),
        (clean.union(clean.limit(2)), (schemas.KEY, [], schemas.KEY), {}, r"duplicate_keys \(2\)"),
        (clean.union(clean.withColumn("peer_group", F.lit(1))), (schemas.KEY, [], schemas.KEY, "peer_group"), {"min_rows": 1}, r"duplicate_keys \(7\)"),
    ):
        with pytest.raises(ValueError, match=message):
            gated(spark, df, f"{scratch}/t", *args, **options)
    kept = gated(spark, clean, f"{scratch}/t", schemas.KEY, ["total"], schemas.KEY, "peer_group", min_rows=1)
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean.collect()))


def test_gates_on_a_write_take_fewer_jobs(spark, raw, scratch):
    """The counts of nulls, infinities and rows add no job to the write; keys and groups are counted over their columns alone."""
    raw.dropna().withColumn("peer_group", F.lit(0)).write.parquet(f"{scratch}/in")
    clean = spark.read.parquet(f"{scratch}/in")
    args = ([*schemas.KEY, "total"], ["total"], schemas.KEY, "peer_group", 1)

    def jobs(name, make):
        spark.sparkContext.setJobGroup(name, name)
        try:
            make()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    plain = jobs("plain", lambda: clean.write.parquet(f"{scratch}/plain"))
    gate = audit.Gate(*args)
    assert jobs("watched", lambda: gate.watch(clean).write.parquet(f"{scratch}/watched")) == plain
    verified = jobs("verified", lambda: gate.verify(spark.read.parquet(f"{scratch}/watched")))
    apart = jobs("apart", lambda: audit.validate(clean, *args))
    assert verified < apart


def test_duplicates_count_across_groups(spark):
    df = months(spark, [(1, "2020-01", 1, 0), (1, "2020-01", 1, 0)]).withColumn("peer_group", F.monotonically_increasing_id())
    report = {r["rule"]: r["violations"] for r in audit.validation_report(df, schemas.KEY, [], schemas.KEY, "peer_group").collect()}
    assert report["duplicate_keys"] == 1 and report["small_groups"] == 2


def test_general_statistics(raw):
    values = [r["value"] for r in audit.general_stats(raw, START, END).orderBy("position").collect()]
    assert values == [9.0, 4.0, 5.0, 55.56]
    report = audit.quality_report(raw, START, END).first()
    assert (report["rows_kept"], report["rows_removed"], report["first_month"]) == (4, 5, date(2016, 1, 1))
