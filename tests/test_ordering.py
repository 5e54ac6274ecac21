import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from peerwatch.functions import columns
from peerwatch.operators import ordering


def test_positions_follow_the_total_order_with_hot_ties(spark):
    rng = np.random.default_rng(5)
    scores = np.where(rng.random(3000) < 0.4, 1.0, rng.random(3000) * 3)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "score": scores})).repartition(6)
    got = ordering.number_rows(df, [F.desc("score"), F.asc("id")]).toPandas().sort_values("position")
    want = pd.DataFrame({"id": np.arange(3000), "score": scores}).sort_values(["score", "id"], ascending=[False, True])
    assert got["position"].tolist() == list(range(1, 3001))
    assert got["id"].tolist() == want["id"].tolist()


def ranked(spark, values, weights=None, parts=5):
    weighed = weights if weights is not None else np.ones(len(values), int)
    rows = list(zip(range(len(values)), values.tolist(), weighed.tolist()))  # from pandas, NaN would become NULL
    df = spark.createDataFrame(rows, "id long, v double, w long").repartition(parts)
    return {r["id"]: r["r"] for r in ordering.average_ranks(df, "v", "r", "w" if weights is not None else None).collect()}


def test_average_ranks_match_pandas(spark):
    values = np.random.default_rng(6).integers(0, 40, 500).astype(float)
    assert ranked(spark, values) == dict(enumerate(pd.Series(values).rank()))


def test_ranks_of_hot_ties_over_many_partitions(spark):
    """Values that fill several partitions, small Arrow batches, weights, infinities and NaN."""
    rng = np.random.default_rng(7)
    values = np.concatenate([np.full(1500, 2.0), np.full(700, 5.0), rng.normal(3, 2, 800), [np.inf, -np.inf, np.nan, np.nan, -0.0, 0.0]])
    weights = rng.integers(1, 5, len(values))
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        plain, weighted = ranked(spark, values), ranked(spark, values, weights)
        df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(values)), "v": values}))
        held = ordering.average_ranks(df, "v", "r").where("v = 2").select(F.input_file_name()).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = np.where(np.isnan(values), 1e308, np.where(np.isposinf(values), 1e307, values))
    assert plain == dict(enumerate(pd.Series(key).rank())) and held >= 4
    every = pd.Series(np.repeat(key, weights)).rank().to_numpy()
    assert weighted == dict(enumerate(every[np.cumsum(weights) - 1]))


def test_ranks_of_few_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "id long, v double")
    assert [tuple(r) for r in ordering.average_ranks(df, "v", "r").collect()] == [(4.0, 2, 1.0)]
    assert ordering.average_ranks(df.limit(0), "v", "r").collect() == []


def keyed(spark, n):
    return spark.range(n).select((F.col("id") % 50).alias("entity_id"), F.col("id").alias("month"))


def drawn(df, n):
    keys = [F.col("entity_id"), F.col("month")]
    return {r["month"] for r in ordering.hashed_sample(df, n, keys, ["entity_id", "month"]).collect()}


def test_sample_is_the_smallest_hashes_at_every_size(spark):
    for size in (30, 1000, 6000):
        df = keyed(spark, size)
        smallest = df.withColumn("h", columns.fold32(F.col("entity_id"), F.col("month"), F.lit(42))).orderBy("h", "entity_id", "month")
        whole = {r["month"] for r in smallest.limit(20).collect()}
        assert drawn(df, 20) == drawn(df.repartition(9), 20) == whole and len(whole) == 20


def test_rows_without_a_key_are_left_out_at_every_size(spark):
    for size in (10, 1000, 3000):
        nulls = spark.range(5).select(F.lit(None).cast("bigint").alias("entity_id"), (-F.col("id") - 1).alias("month"))
        got = drawn(keyed(spark, size).unionByName(nulls), 20)
        assert len(got) == min(20, size) and min(got) >= 0


def test_top_rows(spark):
    rows = ordering.top_rows(keyed(spark, 100), [F.desc("month")], 3).collect()
    assert [(r["position"], r["month"]) for r in rows] == [(1, 99), (2, 98), (3, 97)]
