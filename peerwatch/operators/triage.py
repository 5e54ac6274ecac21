"""From flags to status, texts, priority and ranked alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.operators import ordering
from peerwatch.operators.quantiles import group_quantiles


def alert_order() -> list[Column]:
    """Priority, then intensity, both falling; the key settles the rest."""
    return [F.desc("priority"), F.desc("if_intensity"), F.asc("entity_id"), F.asc("month")]


def status() -> Column:
    return (
        F.when(F.col("flag_z_critical") & F.col("flag_forest"), F.lit(labels.STATUS_CRITICAL))
        .when(F.col("flag_z_moderate"), F.lit(labels.STATUS_MODERATE))
        .when(F.col("flag_forest"), F.lit(labels.STATUS_MULTIVARIATE))
        .otherwise(F.lit(labels.STATUS_NORMAL))
    )


def _joined(separator: str, parts: list[Column], default: str) -> Column:
    text = F.concat_ws(separator, *parts)
    return F.when(text == "", F.lit(default)).otherwise(text)


def _level(critical: str, moderate: str) -> Column:
    return F.when(F.col("flag_z_critical"), F.lit(critical)).when(F.col("flag_z_moderate"), F.lit(moderate))


def reason_category() -> Column:
    forest = F.when(F.col("flag_forest"), F.lit(labels.REASON_FOREST))
    return _joined(" + ", [_level(labels.REASON_CRITICAL, labels.REASON_MODERATE), forest], labels.REASON_NONE)


def explanation() -> Column:
    forest = F.when(F.col("flag_forest"), F.lit(labels.EXPLAIN_FOREST))
    return _joined(" | ", [_level(labels.EXPLAIN_CRITICAL, labels.EXPLAIN_MODERATE), forest], labels.EXPLAIN_NONE)


def _evidence(group: str = "peer_group") -> Column:
    """The numbers behind the alert, rounded half to even before formatting; empty without evidence."""
    high = F.col("flag_z_moderate")
    return F.concat_ws(
        "; ",
        F.when(high, F.format_string(labels.JUSTIFY_RATE, F.bround(F.col("rate") * 100, 4))),
        F.when(high, F.format_string(labels.JUSTIFY_MEAN, F.bround(F.col("rate_mean") * 100, 4), F.col(group))),
        F.when(high, F.format_string(labels.JUSTIFY_Z, F.bround("z", 2))),
        F.when(F.col("flag_forest"), F.lit(labels.JUSTIFY_FOREST)),
    )


def justification(group: str = "peer_group") -> Column:
    """One sentence: capital first letter, final full stop."""
    text = _evidence(group)
    rest = F.substr(text, F.lit(2))
    sentence = F.concat(F.upper(F.substring(text, 1, 1)), rest, F.lit("."))
    return F.when(text == "", F.lit(labels.JUSTIFY_NONE)).otherwise(sentence)


def priority() -> Column:
    """Positive part of z plus one for a forest alert."""
    return F.greatest(F.col("z"), F.lit(0.0)) + F.col("flag_forest").cast("int")


def classify(df: DataFrame) -> DataFrame:
    """Status, reason, explanation, justification and priority from z and the flags."""
    return df.withColumns({
        "status": status(),
        "reason": reason_category(),
        "explanation": explanation(),
        "justification": justification(),
        "priority": priority(),
    })


def alerts(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status") != labels.STATUS_NORMAL)


def rank_alerts(classified: DataFrame) -> DataFrame:
    """All alerts with their global position."""
    return ordering.number_rows(alerts(classified), alert_order())


def top_alerts(classified: DataFrame, n: int = labels.TOP_CASES) -> DataFrame:
    """The first n alerts, in report form."""
    head = ordering.top_rows(alerts(classified), alert_order(), n)
    return head.select(
        "position",
        "entity_id",
        "month",
        C.month_label("month").alias("month_label"),
        "peer_group",
        "total",
        "cancelled_n",
        F.bround("rate", 6).alias("rate"),
        F.bround("rate_mean", 6).alias("rate_mean"),
        F.bround("z", 2).alias("z"),
        "if_label",
        F.bround("if_intensity", 6).alias("if_intensity"),
        F.bround("priority", 2).alias("priority"),
        "status",
        "reason",
        "justification",
    ).orderBy("position")


def status_distribution(classified: DataFrame) -> DataFrame:
    """Alerts per status with their share of alerts and of the base; one pass."""
    whole = Window.partitionBy()
    counts = classified.groupBy("status").agg(F.count(F.lit(1)).alias("alerts_n"))
    is_alert = F.col("status") != labels.STATUS_NORMAL
    sized = counts.select(
        "*",
        F.sum("alerts_n").over(whole).alias("base_n"),
        F.sum(F.when(is_alert, F.col("alerts_n"))).over(whole).alias("all_n"),
    )
    return sized.where(is_alert).select(
        "status",
        "alerts_n",
        C.percent("alerts_n", "all_n").alias("alerts_pct"),
        C.percent("alerts_n", "base_n").alias("base_pct"),
    ).orderBy(F.desc("alerts_n"), "status")


def reason_distribution(classified: DataFrame) -> DataFrame:
    counts = alerts(classified).groupBy("reason").agg(F.count(F.lit(1)).alias("alerts_n"))
    whole = F.sum("alerts_n").over(Window.partitionBy())
    return counts.select("*", C.percent("alerts_n", whole).alias("alerts_pct")).orderBy(F.desc("alerts_n"), "reason")


def alerts_by_cluster(classified: DataFrame, group: str = "peer_group") -> DataFrame:
    """Alerts of each group that has any, against its size; one pass."""
    counts = classified.groupBy(group).agg(
        F.count_if(F.col("status") != labels.STATUS_NORMAL).alias("alerts_n"), F.count(F.lit(1)).alias("rows_n")
    )
    whole = F.sum("alerts_n").over(Window.partitionBy())
    return counts.where(F.col("alerts_n") > 0).select(
        group,
        "alerts_n",
        "rows_n",
        C.percent("alerts_n", whole).alias("alerts_pct"),
        C.percent("alerts_n", "rows_n").alias("alert_rate_pct"),
    ).orderBy(group)


def peer_stats_report(stats: DataFrame) -> DataFrame:
    """Peer statistics with the rate columns also in percent."""
    names = ("rate_mean", "rate_median", "rate_std", "rate_p90")
    return stats.withColumns({f"{name}_pct": F.col(name) * 100 for name in names})


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum; one row per statistic."""
    flat = df.agg(*[
        agg.alias(f"{name}_{stat}")
        for name in columns
        for stat, agg in (
            ("count", F.count(name).cast("double")),
            ("mean", F.avg(name)),
            ("std", F.stddev_samp(name)),
            ("min", F.min(name).cast("double")),
            ("max", F.max(name).cast("double")),
        )
    ]).first()
    quartiles = {r["variable"]: r["q"] for r in group_quantiles(df, columns, [0.25, 0.5, 0.75]).collect()}
    order = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")

    def value(name: str, stat: str):
        if stat.endswith("%"):
            return quartiles.get(name, [None] * 3)[("25%", "50%", "75%").index(stat)]
        return flat[f"{name}_{stat}"]

    rows = [(i + 1, stat, *[value(name, stat) for name in columns]) for i, stat in enumerate(order)]
    schema = "position int, statistic string, " + ", ".join(f"`{name}` double" for name in columns)
    return df.sparkSession.createDataFrame(rows, schema)


def selectivity(df: DataFrame, global_rule: Column, contextual_rule: Column) -> DataFrame:
    """Alerts of a rule over the whole base against those of the peer-group rule."""
    counts = df.agg(
        F.count(F.lit(1)).alias("base_n"),
        F.count_if(global_rule).alias("global_n"),
        F.count_if(contextual_rule).alias("contextual_n"),
    )
    return counts.withColumn("reduction_pct", C.percent(F.col("global_n") - F.col("contextual_n"), "global_n"))
