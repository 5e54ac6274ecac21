import pytest
from pyspark.sql import functions as F

from conftest import months
from peerwatch import schemas
from peerwatch.operators import facts
from peerwatch.sources import datasets, staging, tables


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc"])
def test_round_trip(spark, scratch, fmt):
    df = months(spark, [(1, "2020-01", 5, 2), (2, None, 1, 0)])
    tables.write_stage(df, f"{scratch}/{fmt}", fmt)
    back = tables.read_stage(spark, f"{scratch}/{fmt}", schemas.MONTHLY_FACT, fmt)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_csv_text_that_does_not_parse_is_null(spark, scratch):
    rows = spark.createDataFrame([("1", "x", "5", "1", "1", "0")], schemas.MONTHLY_FACT.fieldNames())
    tables.write_report(rows, f"{scratch}/bad")
    assert tables.read_stage(spark, f"{scratch}/bad", schemas.MONTHLY_FACT, "csv").first()["month"] is None


def test_missing_columns_and_optional_tables(spark, scratch):
    tables.write_stage(months(spark, [(1, "2020-01", 5, 2)]).drop("total"), f"{scratch}/short")
    with pytest.raises(ValueError, match="missing columns: total"):
        tables.read_stage(spark, f"{scratch}/short", schemas.MONTHLY_FACT)
    assert tables.read_stage(spark, f"{scratch}/absent", schemas.MONTHLY_FACT, optional=True) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_stage(spark, f"{scratch}/absent", schemas.MONTHLY_FACT)


def test_database_reads_must_be_split(spark):
    with pytest.raises(ValueError, match="partitionColumn"):
        tables.read_source(spark, "jdbc:postgresql://host/db", dbtable="t")


def test_files_are_sources(spark, sf_dir):
    assert tables.read_source(spark, f"{sf_dir}/orders.parquet").count() > 0


def test_stage_cuts_lineage(spark):
    staged = staging.stage(spark.range(10).withColumn("x", F.rand()))
    assert staged.collect() == staged.collect()
    assert "Scan parquet" in staged._jdf.queryExecution().executedPlan().toString() or "FileScan" in (
        staged._jdf.queryExecution().executedPlan().toString()
    )


def test_cut_reaches_the_scan_with_few_columns(spark, sf_dir):
    plan = facts.features(datasets.shipping_kept(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_peer_join_does_not_shuffle_rows(spark, sf_dir):
    """Statistics are grouped and broadcast; the rows stay where they are."""
    from peerwatch.plans import catalog

    plan = catalog.scored(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    tree = plan[: plan.index("\n\n")] if "\n\n" in plan else plan
    rows = next(i for i, line in enumerate(tree.splitlines()) if "features-" in line or "not_cancelled_n" in line and "FileScan" in line)
    lines = tree.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, level = [], depth(lines[rows])
    for line in reversed(lines[:rows]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
    assert any("BroadcastHashJoin" in line for line in above) and not any("Exchange" in line for line in above)


def test_statistics_that_hold_a_key_twice_raise(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 20.0), (None, 5.0)], "g int, v double")
    single = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "g int, name string")
    assert sorted((r["v"], r["name"]) for r in staging.attach(rows, single, ["g"]).collect()) == [(5.0, None), (10.0, "a"), (20.0, "b")]
    for twice in ([(1, "a"), (1, "a")], [(1, "a"), (1, "b"), (2, "c")], [(2, "b"), (1, "a"), (1, None)]):
        stats = spark.createDataFrame(twice, "g int, name string")
        with pytest.raises(Exception, match="several rows of statistics for one key"):
            staging.attach(rows, stats, ["g"]).collect()
        with pytest.raises(Exception, match="several rows of statistics for one key"):
            staging.attach(rows, stats, ["g"]).agg(F.sum("v"), F.count("name")).collect()


def test_stability_shares_the_entity_shuffle(spark, sf_dir):
    from peerwatch.operators import stability
    from peerwatch.plans import catalog

    plan = stability.stability(catalog.moves(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
