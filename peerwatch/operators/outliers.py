"""Scores of a row against its own peer group.

Group statistics are aggregated once and joined back; a window over the group
would put a whole peer group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.operators.ordering import average_ranks
from peerwatch.operators.quantiles import around, at_share, deviation, group_quantiles, quantile_columns, summarise
from peerwatch.sources.staging import attach, stage


def peer_stats(
    df: DataFrame, group: str = "peer_group", rate: str = "rate", total: str = "total",
    std_floor: float = labels.RATE_STD_FLOOR,
) -> DataFrame:
    """Size, mean, median, deviation and 90th percentile per peer group, from one pass of counts over both columns."""
    found = summarise(df, [rate, total], [group], around([0.5, 0.9]), moments=True)
    spread = f"greatest(coalesce({deviation()}, 0D), {float(std_floor)!r}D)"
    stats = [
        ("rate_mean", 0, "mean"), ("rate_median", 0, at_share(0.5)), ("rate_std", 0, spread), ("rate_p90", 0, at_share(0.9)),
        ("total_mean", 1, "mean"), ("total_median", 1, at_share(0.5)),
    ]
    return found.groupBy(F.col("g0").alias(group)).agg(
        F.expr("max(rows) AS group_n"), *[F.expr(f"max({value}) FILTER (WHERE variable = {i}) AS {name}") for name, i, value in stats]
    )


def peer_gap(df: DataFrame, rate: str = "rate", mean: str = "rate_mean") -> DataFrame:
    """Gap to the peer mean in percentage points and ratio to it (NULL for a mean of zero)."""
    x, m = F.col(rate), F.col(mean)
    return df.withColumns({"gap_pp": (x - m) * 100, "ratio": F.when(m > 0, x / m)})


def score_against_peers(
    df: DataFrame, group: str = "peer_group", std_floor: float = labels.RATE_STD_FLOOR
) -> DataFrame:
    """Rows with their peer statistics, z-score, gap and ratio."""
    joined = attach(df, peer_stats(df, group, std_floor=std_floor), [group])
    z = (F.col("rate") - F.col("rate_mean")) / F.col("rate_std")
    return peer_gap(joined.withColumn("z", z))


def zscore(
    df: DataFrame, value: str, group: str = "peer_group", ddof: int = 1, zero_std: str = "floor",
    floor: float = labels.RATE_STD_FLOOR, out: str = "z",
) -> DataFrame:
    """z-score inside the group.

    `zero_std` says what a constant group gives: "floor" uses a minimum
    deviation, "null_to_zero" scores 0, "none" leaves NULL.
    """
    deviation = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    stats = df.groupBy(group).agg(F.avg(value).alias("_mean"), deviation.alias("_std"))
    gap = F.col(value) - F.col("_mean")
    if zero_std == "floor":
        score = gap / F.greatest(F.coalesce(F.col("_std"), F.lit(0.0)), F.lit(floor))
    elif zero_std == "null_to_zero":
        score = F.coalesce(F.try_divide(gap, F.col("_std")), F.lit(0.0))
    elif zero_std == "none":
        score = F.try_divide(gap, F.col("_std"))
    else:
        raise ValueError(f"unknown zero_std: {zero_std}")
    return attach(df, stats, [group]).withColumn(out, score).drop("_mean", "_std")


def exceeds(z: str | Column, limit: float, side: str = "upper") -> Column:
    """Strictly beyond the limit, one-sided or on the absolute value; NULL counts as no."""
    value = C.col(z)
    value = F.abs(value) if side == "both" else value
    return F.coalesce(value > limit, F.lit(False))


def flag_z(df: DataFrame, z: str = "z", moderate=labels.Z_MODERATE, critical=labels.Z_CRITICAL) -> DataFrame:
    return df.withColumns({"flag_z_moderate": exceeds(z, moderate), "flag_z_critical": exceeds(z, critical)})


def mad(df: DataFrame, value: str, group: str = "peer_group") -> DataFrame:
    """Median and median absolute deviation per group."""
    medians = quantile_columns(df, {"value_median": (value, 0.5)}, [group])
    gaps = attach(df.select(group, value), medians, [group]).withColumn(
        "gap", F.abs(F.col(value) - F.col("value_median"))
    )
    # The median is constant inside a group, so it travels along as a key.
    return quantile_columns(gaps, {"mad": ("gap", 0.5)}, [group, "value_median"])


def mad_diagnostics(df: DataFrame, value: str = "rate", group: str = "peer_group") -> DataFrame:
    """Median, MAD, range and share of zeros per group; groups with MAD zero are marked."""
    spread = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows_n"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        (F.avg((F.col(value) == 0).cast("int")) * 100).alias("zero_pct"),
    )
    return spread.join(mad(df, value, group), group).select(
        group, "rows_n", "value_median", "mad", "value_min", "value_max", "zero_pct", (F.col("mad") == 0).alias("mad_zero")
    ).orderBy(group)


def robust_zscore(
    df: DataFrame, value: str = "total", group: str = "peer_group", floor: float = labels.MAD_FLOOR,
    factor: float = labels.MAD_FACTOR, limit: float = labels.ROBUST_Z_LIMIT,
) -> DataFrame:
    """Modified z-score from median and MAD, two-sided flag."""
    scored = attach(df, mad(df, value, group), [group]).withColumn(
        "robust_z",
        F.lit(factor) * (F.col(value) - F.col("value_median")) / F.greatest(F.coalesce("mad", F.lit(0.0)), F.lit(floor)),
    )
    return scored.withColumn("flag_robust", exceeds("robust_z", limit, "both"))


def compare_scores(df: DataFrame, value: str = "total", group: str = "peer_group") -> DataFrame:
    """Classical and robust two-sided scores of the volume, with flags and directions."""
    classic = zscore(df, value, group, ddof=1, zero_std="floor", floor=labels.TOTAL_STD_FLOOR)
    both = robust_zscore(classic.withColumn("flag_classic", exceeds("z", labels.Z_MODERATE, "both")), value, group)
    return both.withColumns({"direction_classic": C.direction("z"), "direction_robust": C.direction("robust_z")})


def percentile_limits(df: DataFrame, value: str, group: str = "peer_group", probs=labels.PERCENTILES) -> DataFrame:
    """(group, percentile, limit_value)."""
    q = group_quantiles(df, [value], list(probs), [group])
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"), F.col("q"))
    return q.select(group, F.explode(pairs).alias("e")).select(
        group, F.col("e.p").alias("percentile"), F.col("e.q").alias("limit_value")
    )


def percentile_rule(
    df: DataFrame, value: str = "rate", group: str = "peer_group", probs=labels.PERCENTILES
) -> DataFrame:
    """Rows with `limits` and `above`, one entry per percentile in the order of `probs`."""
    q = group_quantiles(df, [value], list(probs), [group]).select(group, F.col("q").alias("limits"))
    return attach(df, q, [group]).withColumn("above", F.transform("limits", lambda limit: F.col(value) > limit))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and rho from average ranks.

    Equal pairs are counted first.  The pairs are then sorted by one column and by
    the other, each time over ranges that split ties, and take their ranks where
    they lie.  The mean rank is (n + 1) / 2 exactly.
    """
    pairs = stage(
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
        .agg(F.count(F.lit(1)).alias("w")),
        "pairs",
    )
    ranked = average_ranks(average_ranks(pairs, "a", "ra", "w").drop("a"), "b", "rb", "w")
    mean = (pairs.agg(F.sum("w")).scalar() + 1) / 2.0
    centred = ranked.select("w", (F.col("ra") - mean).alias("x"), (F.col("rb") - mean).alias("y"))
    sums = centred.agg(
        F.sum("w").alias("n"),
        F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"),
    )
    return sums.select("n", F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def global_zscore(df: DataFrame, value: str = "rate", out: str = "z_global") -> DataFrame:
    """z-score against the whole base, the rule peer groups are compared with."""
    mean, std = df.agg(F.avg(value), F.stddev_samp(value)).first()
    if not std:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, (F.col(value) - F.lit(mean)) / F.lit(std))
