"""The given tables seen as transactions of the analysis."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerwatch.operators import facts

SHIPPING_START, SHIPPING_END = date(1996, 1, 1), date(2001, 6, 1)
ORDERS_START, ORDERS_END = date(1996, 1, 1), date(1996, 12, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions of a supplier: R cancelled, N not, A unknown."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        F.col("l_shipdate").alias("event_ts"),
        F.when(flag == "R", F.lit(True)).when(flag == "N", F.lit(False)).alias("cancelled"),
    )


def shipping_with_bad_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with time as text, some of it not a date."""
    flag = F.col("l_returnflag")
    bad = (F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        F.when(bad, F.lit("n/a")).otherwise(F.col("l_shipdate").cast("string")).alias("event_ts"),
        F.when(flag == "R", F.lit(True)).when(flag == "N", F.lit(False)).alias("cancelled"),
    )


def ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions of a customer: F cancelled, O not, P unknown."""
    flag = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderdate").alias("event_ts"),
        F.when(flag == "F", F.lit(True)).when(flag == "O", F.lit(False)).alias("cancelled"),
    )


def shipping_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every monthly row, before the period cut."""
    return facts.monthly_fact(shipping(spark, sf_dir))


def shipping_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows inside the period; the cut reaches the scan."""
    kept = facts.within_months(shipping(spark, sf_dir), SHIPPING_START, SHIPPING_END)
    return facts.monthly_fact(kept)


def ordering_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.monthly_fact(ordering(spark, sf_dir))
