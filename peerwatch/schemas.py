"""Explicit schemas of the tables handed from one step to the next."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("entity_id", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("cancelled", T.BooleanType()),
])

MONTHLY_FACT = T.StructType([
    T.StructField("entity_id", T.LongType()),
    T.StructField("month", T.DateType()),
    T.StructField("total", T.LongType()),
    T.StructField("cancelled_n", T.LongType()),
    T.StructField("not_cancelled_n", T.LongType()),
    T.StructField("null_flag_n", T.LongType()),
])

FEATURES = T.StructType(MONTHLY_FACT.fields + [
    T.StructField("rate", T.DoubleType()),
    T.StructField("log_total", T.DoubleType()),
    T.StructField("peer_group", T.IntegerType()),
])

SCORED = T.StructType(FEATURES.fields + [
    T.StructField("rate_mean", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("if_decision", T.DoubleType()),
    T.StructField("if_label", T.IntegerType()),
    T.StructField("flag_z_moderate", T.BooleanType()),
    T.StructField("flag_z_critical", T.BooleanType()),
    T.StructField("flag_forest", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("justification", T.StringType()),
    T.StructField("priority", T.DoubleType()),
])

STABILITY = T.StructType([
    T.StructField("entity_id", T.LongType()),
    T.StructField("months_n", T.LongType()),
    T.StructField("comparisons_n", T.LongType()),
    T.StructField("changes_n", T.LongType()),
    T.StructField("stays_n", T.LongType()),
    T.StructField("persistence", T.DoubleType()),
    T.StructField("main_group", T.IntegerType()),
    T.StructField("groups_n", T.LongType()),
])

KEY = ["entity_id", "month"]
