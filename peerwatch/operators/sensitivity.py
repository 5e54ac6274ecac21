"""How results move with the rule, the threshold and the method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.functions.special import correlation_t, two_sided_p
from peerwatch.operators import outliers
from peerwatch.operators.ordering import top_rows
from peerwatch.operators.quantiles import quantile_values


def _kept_share(shared: str, whole: str) -> Column:
    """Percentage kept, zero when there is nothing to keep."""
    return F.coalesce(C.percent(shared, whole, None), F.lit(0.0))


def percentile_vs_z(
    df: DataFrame, value: str = "rate", group: str = "peer_group", probs=labels.PERCENTILES
) -> DataFrame:
    """Per group and percentile: limit, alerts of both rules, alerts in common.

    All percentiles are counted in the same aggregation, as array positions.
    """
    scored = outliers.zscore(df, value, group, ddof=0, zero_std="none", out="z_pop")
    ruled = outliers.percentile_rule(scored, value, group, probs).withColumn("by_z", outliers.exceeds("z_pop", labels.Z_MODERATE))
    counts = ruled.groupBy(group).agg(
        F.count_if("by_z").alias("z_alerts"),
        F.first("limits").alias("limits"),
        *[F.count_if(F.col("above")[i]).alias(f"p{i}") for i in range(len(probs))],
        *[F.count_if(F.col("above")[i] & F.col("by_z")).alias(f"s{i}") for i in range(len(probs))],
    )
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("percentile"),
            F.col("limits")[i].alias("limit_value"),
            F.col(f"p{i}").alias("percentile_alerts"),
            F.col(f"s{i}").alias("shared"),
        )
        for i, p in enumerate(probs)
    ])
    return (
        counts.select(group, "z_alerts", F.explode(rows).alias("r"))
        .select(group, "r.percentile", "r.limit_value", "z_alerts", "r.percentile_alerts", "r.shared")
        .withColumn("z_kept_pct", _kept_share("shared", "z_alerts"))
        .orderBy(group, "percentile")
    )


def percentile_vs_z_global(by_group: DataFrame) -> DataFrame:
    """The same over all groups, from the group counts."""
    return (
        by_group.groupBy("percentile")
        .agg(*[F.sum(c).alias(c) for c in ("z_alerts", "percentile_alerts", "shared")])
        .withColumn("z_kept_pct", _kept_share("shared", "z_alerts"))
        .orderBy("percentile")
    )


def _contamination_flags(scored: DataFrame, cs, column: str = "score") -> DataFrame:
    """One flag column per contamination, from a single fit."""
    limits = quantile_values(scored, column, list(cs))
    return scored.withColumns({f"if{i}": F.col(column) < F.lit(v) for i, v in enumerate(limits)})


def contamination_sweep(scored: DataFrame, cs=labels.CONTAMINATIONS) -> DataFrame:
    """Forest, hybrid, critical and exclusive alerts at each contamination, in one pass.

    `scored` holds `score` and `z`.
    """
    flagged = _contamination_flags(scored, cs).withColumns({
        "by_z": outliers.exceeds("z", labels.Z_MODERATE), "by_z3": outliers.exceeds("z", labels.Z_CRITICAL),
    })
    by_z, by_z3 = F.col("by_z"), F.col("by_z3")
    aggs = [F.count(F.lit(1)).alias("base_n")]
    for i in range(len(cs)):
        forest = F.col(f"if{i}")
        for name, rule in (
            ("forest", forest),
            ("hybrid", by_z | forest),
            ("critical", by_z3 & forest),
            ("both", by_z & forest),
            ("only_forest", ~by_z & forest),
            ("only_z", by_z & ~forest),
        ):
            aggs.append(F.count_if(rule).alias(f"{name}{i}"))
    counts = flagged.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(round(c * 100)).alias("contamination_pct"),
            *[F.col(f"{n}{i}").alias(f"{n}_n") for n in ("forest", "hybrid", "critical", "both", "only_forest", "only_z")],
        )
        for i, c in enumerate(cs)
    ])
    return counts.select("base_n", F.explode(rows).alias("r")).select("base_n", "r.*").select(
        "contamination_pct",
        "forest_n",
        C.percent("forest_n", "base_n").alias("forest_pct"),
        "hybrid_n",
        C.percent("hybrid_n", "base_n").alias("hybrid_pct"),
        "critical_n",
        C.percent("critical_n", "base_n", 4).alias("critical_pct"),
        "both_n",
        "only_forest_n",
        "only_z_n",
    ).orderBy("contamination_pct")


def contamination_overlap(
    scored: DataFrame, base: float = labels.CONTAMINATIONS[0], others=labels.CONTAMINATIONS[1:]
) -> DataFrame:
    """Alerts shared with the base contamination and new ones, per other contamination."""
    flagged = _contamination_flags(scored, [base, *others]).withColumn("by_z", outliers.exceeds("z", labels.Z_MODERATE))
    by_z, first = F.col("by_z"), F.col("if0")
    aggs = []
    for i in range(1, len(others) + 1):
        forest = F.col(f"if{i}")
        aggs += [
            F.count_if(forest & first).alias(f"fs{i}"),
            F.count_if(forest & ~first).alias(f"fn{i}"),
            F.count_if((forest | by_z) & (first | by_z)).alias(f"hs{i}"),
            F.count_if((forest | by_z) & ~(first | by_z)).alias(f"hn{i}"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(round(c * 100)).alias("contamination_pct"),
            F.col(f"fs{i}").alias("forest_shared"),
            F.col(f"fn{i}").alias("forest_new"),
            F.col(f"hs{i}").alias("hybrid_shared"),
            F.col(f"hn{i}").alias("hybrid_new"),
        )
        for i, c in enumerate(others, 1)
    ])
    return flagged.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").orderBy("contamination_pct")


def _overlap_counts() -> list[Column]:
    classic, robust = F.col("flag_classic"), F.col("flag_robust")
    return [
        F.count(F.lit(1)).alias("rows_n"),
        F.count_if(classic).alias("classic_n"),
        F.count_if(robust).alias("robust_n"),
        F.count_if(classic & robust).alias("both_n"),
        F.count_if(classic & ~robust).alias("only_classic_n"),
        F.count_if(~classic & robust).alias("only_robust_n"),
        F.count_if(~classic & ~robust).alias("neither_n"),
    ]


def method_comparison(compared: DataFrame) -> DataFrame:
    """Alerts of the classical and the robust score with their share of the base."""
    counts = compared.agg(*_overlap_counts())
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("method"), F.lit(limit).alias("limit_text"), F.col(n).alias("alerts_n")
        )
        for i, (name, limit, n) in enumerate((
            (labels.METHOD_CLASSIC, labels.LIMIT_CLASSIC, "classic_n"),
            (labels.METHOD_ROBUST, labels.LIMIT_ROBUST, "robust_n"),
        ), 1)
    ])
    return counts.select("rows_n", F.explode(rows).alias("r")).select(
        "r.position", "r.method", "r.limit_text", "r.alerts_n", C.percent("r.alerts_n", "rows_n").alias("base_pct")
    ).orderBy("position")


def method_overlap(compared: DataFrame) -> DataFrame:
    """Rows flagged by both methods, by one only, and by none."""
    counts = compared.agg(*_overlap_counts()).withColumnRenamed("rows_n", "base_n")
    titles = (labels.OVERLAP_BOTH, labels.OVERLAP_CLASSIC, labels.OVERLAP_ROBUST, labels.OVERLAP_NONE)
    names = ("both_n", "only_classic_n", "only_robust_n", "neither_n")
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(t).alias("situation"), F.col(n).alias("rows_n"))
        for i, (t, n) in enumerate(zip(titles, names), 1)
    ])
    return counts.select("base_n", F.explode(rows).alias("r")).select(
        "r.position", "r.situation", "r.rows_n", C.percent("r.rows_n", "base_n").alias("base_pct")
    ).orderBy("position")


def method_by_cluster(compared: DataFrame, group: str = "peer_group") -> DataFrame:
    return (
        compared.groupBy(group)
        .agg(*_overlap_counts())
        .drop("neither_n")
        .withColumns({
            "classic_pct": C.percent("classic_n", "rows_n"), "robust_pct": C.percent("robust_n", "rows_n"),
        })
        .orderBy(group)
    )


def spearman_report(compared: DataFrame, a: str = "z", b: str = "robust_z") -> DataFrame:
    """Rank correlation of the two scores and its two-sided p-value."""
    row = outliers.spearman(compared, a, b).first()
    p = two_sided_p(correlation_t(row["rho"], row["n"]), row["n"])
    rho = None if row["rho"] is None else round(row["rho"], 4)
    return compared.sparkSession.createDataFrame(
        [(labels.SPEARMAN_RHO, rho), (labels.SPEARMAN_P, p)], "metric string, value double"
    )


def top_by_abs(
    compared: DataFrame, column: str, other_flag: str, n: int = labels.TOP_CASES
) -> DataFrame:
    """The n rows farthest from their group, each with the other method's verdict."""
    order = [F.desc("_size"), F.asc("entity_id"), F.asc("month")]
    head = top_rows(compared.withColumn("_size", F.abs(column)), order, n)
    return head.select(
        "position",
        "entity_id",
        "month",
        C.month_label("month").alias("month_label"),
        "peer_group",
        "total",
        F.bround("z", 2).alias("z"),
        F.bround("robust_z", 2).alias("robust_z"),
        F.col(other_flag).alias("other_flag"),
    ).orderBy("position")


