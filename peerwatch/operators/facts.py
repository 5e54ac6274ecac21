"""From transactions to the monthly fact and its features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerwatch.functions import columns as C


def monthly_fact(
    df: DataFrame, entity: str = "entity_id", ts: str = "event_ts", flag: str = "cancelled", grain: str = "month"
) -> DataFrame:
    """Counts per entity and month, split by the three states of the flag.

    Only counts cross the shuffle: rows are combined before it, so an entity
    with a large share of the transactions sends one row per month and task.
    """
    state = F.col(flag)
    return df.groupBy(
        F.col(entity).alias("entity_id"), F.trunc(F.col(ts).cast("date"), grain).alias("month")
    ).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state).alias("cancelled_n"),
        F.count_if(~state).alias("not_cancelled_n"),
        F.count_if(state.isNull()).alias("null_flag_n"),
    )


def coerce_date(df: DataFrame, column: str) -> DataFrame:
    """Text to date; what does not parse becomes NULL.  Dates and timestamps stay as they are."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, F.col(column).try_cast("timestamp").cast("date"))


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Text to double; what does not parse, and NaN, becomes NULL."""
    return df.withColumns({name: F.nullif(F.col(name).try_cast("double"), F.lit(float("nan"))) for name in names})


def period_cut(df: DataFrame, start, end, column: str = "month") -> DataFrame:
    """Rows inside the period, both ends included; NULL months drop out."""
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def within_months(df: DataFrame, start, end, ts: str = "event_ts") -> DataFrame:
    """The same cut on the transaction time, in a form the Parquet scan can use."""
    kind = df.schema[ts].dataType
    return df.where(
        (F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.add_months(F.lit(end), 1).cast(kind))
    )


def features(df: DataFrame) -> DataFrame:
    """Cancellation rate and log volume."""
    return df.withColumns({"rate": C.rate("cancelled_n", "total"), "log_total": C.log_volume("total")})


def calendar(df: DataFrame, column: str = "month") -> DataFrame:
    return df.withColumns({
        "year": F.year(column),
        "month_idx": C.month_index(column),
        "month_label": C.month_label(column),
    })


def moments(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, in one pass."""
    row = df.agg(
        *[F.avg(name).alias(f"{name}_mean") for name in names],
        *[F.stddev_pop(name).alias(f"{name}_std") for name in names],
    ).first()
    return {name: (row[f"{name}_mean"], row[f"{name}_std"]) for name in names}


def standardise(df: DataFrame, names: list[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population std; a constant column keeps scale one."""
    known = moments(df, names)
    return df.withColumns({
        f"{name}{suffix}": (F.col(name) - F.lit(mean)) / F.lit(std if std else 1.0)
        for name, (mean, std) in known.items()
    })


def label_groups(df: DataFrame, mapping: dict, column: str = "peer_group", out: str = "peer_name") -> DataFrame:
    return df.withColumn(out, C.lookup(column, mapping))


def present(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    """Published column names in published order."""
    return df.select(*[F.col(name).alias(title) for name, title in headings.items()])


def in_order(df: DataFrame, schema) -> DataFrame:
    """The columns of a declared schema, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
