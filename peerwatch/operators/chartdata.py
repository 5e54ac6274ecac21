"""The tables behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.operators import triage
from peerwatch.operators.ordering import hashed_sample, top_rows
from peerwatch.operators.quantiles import group_quantiles, quantile_values
from peerwatch.sources.staging import attach


def _fill_bins(df: DataFrame, index: Column, lo: float, width: float, bins: int) -> DataFrame:
    """Counts per bin with empty bins kept; `bins` rows."""
    counts = df.groupBy(index.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return edges.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("rows_n"),
    ).orderBy("bin")


def histogram(df: DataFrame, column: str, bins: int = labels.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if lo is None:
        lo = hi = 0.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    return _fill_bins(df.where(F.col(column).isNotNull()), index, lo, width, bins)


def persistence_histogram(stable: DataFrame, width: int = 5) -> DataFrame:
    """Persistence in fixed steps from 0 to 100, the last bin closed."""
    bins = 100 // width
    index = F.least(F.floor(F.col("persistence") / float(width)), F.lit(bins - 1))
    return _fill_bins(stable.where(F.col("persistence").isNotNull()), index, 0.0, float(width), bins)


def box_stats(df: DataFrame, column: str, group: str = "peer_group") -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and outliers outside, per group."""
    q = group_quantiles(df, [column], [0.25, 0.5, 0.75], [group]).select(
        group, F.col("n").alias("rows_n"), *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    value = F.col(column)
    inside = value.between(F.col("q1") - reach, F.col("q3") + reach)
    keys = [group, "rows_n", "q1", "q2", "q3"]
    return (
        attach(df.select(group, column), q, [group])
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers_n"),
        )
        .withColumnRenamed("q2", "median")
        .orderBy(group)
    )


def upper_limit(df: DataFrame, column: str, p: float) -> float:
    """The percentile, or the maximum when the percentile is not positive."""
    limit = quantile_values(df, column, [p])[0]
    if limit is None or not limit > 0:
        limit = df.agg(F.max(column).cast("double")).first()[0]
    return limit


def trim_upper(df: DataFrame, column: str, p: float = labels.TRIM_PERCENTILE) -> DataFrame:
    return df.where(F.col(column) <= F.lit(upper_limit(df, column, p)))


def clip_upper(df: DataFrame, column: str, p: float = labels.CLIP_PERCENTILE, out: str = "clipped") -> DataFrame:
    return df.withColumn(out, F.least(F.col(column), F.lit(upper_limit(df, column, p))))


def sample_rows(df: DataFrame, n: int = labels.SCATTER_ROWS, seed: int = labels.SEED) -> DataFrame:
    """At most n rows for a scatter plot; rows without entity or month are left out."""
    return hashed_sample(df, n, [F.col("entity_id"), C.month_index("month")], ["entity_id", "month"], seed)


def flag_series(diagnostics: DataFrame, lo: int = labels.SERIES_YEARS[0], hi: int = labels.SERIES_YEARS[1]) -> DataFrame:
    return diagnostics.where(F.col("year").between(lo, hi)).select("year", "null_flag_pct").orderBy("year")


def monthly_series(df: DataFrame) -> DataFrame:
    return df.where(F.col("month").isNotNull()).groupBy("month").agg(F.sum("total").alias("total")).orderBy("month")


def status_counts(classified: DataFrame) -> DataFrame:
    """Alerts per status in order of severity, statuses without alerts kept."""
    counts = classified.agg(*[F.count_if(F.col("status") == s).alias(f"c{i}") for i, s in enumerate(labels.ALERT_STATUSES)])
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("status"), F.col(f"c{i}").alias("alerts_n"))
        for i, s in enumerate(labels.ALERT_STATUSES)
    ])
    return counts.select(F.explode(rows).alias("r")).select("r.*").orderBy("position")


def top_labelled(classified: DataFrame, n: int = labels.TOP_CASES) -> DataFrame:
    """The first n alerts with a composed label."""
    head = top_rows(triage.alerts(classified), triage.alert_order(), n)
    label = F.format_string(labels.CASE_LABEL, F.col("entity_id").cast("string"), C.month_label("month"))
    return head.select(
        "position", label.alias("case_label"), F.bround("priority", 6).alias("priority"), "status"
    ).orderBy("position")


def crosstab(classified: DataFrame, group: str = "peer_group") -> DataFrame:
    """Alerts per group and status as columns, zero-filled."""
    return (
        triage.alerts(classified)
        .groupBy(group)
        .pivot("status", list(labels.ALERT_STATUSES))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .orderBy(group)
    )


def alerts_by_year(classified: DataFrame) -> DataFrame:
    return (
        triage.alerts(classified)
        .groupBy(F.year("month").alias("year"), "status")
        .agg(F.count(F.lit(1)).alias("alerts_n"))
        .orderBy("year", "status")
    )
