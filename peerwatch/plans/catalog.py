"""Named queries over the given tables: one per operator of the analysis.

Each takes (spark, folder of Parquet tables) and returns a DataFrame.  Doubles
are rounded to six decimals so that two engines, which sum in different orders,
agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerwatch import labels, schemas
from peerwatch.operators import (
    audit,
    chartdata,
    facts,
    isolation,
    outliers,
    peer_metrics,
    peers,
    sensitivity,
    stability,
    triage,
)
from peerwatch.sources import datasets as D
from peerwatch.sources import tables
from peerwatch.sources.staging import folder, stage_once

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

START, END = D.SHIPPING_START, D.SHIPPING_END


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({name: F.bround(F.col(f"`{name}`"), digits) for name in doubles})


# Frames the queries share -------------------------------------------------


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept months with features, written once per folder of tables."""
    return stage_once(spark, ("features", sf_dir), lambda: facts.features(D.shipping_kept(spark, sf_dir)), "features")


def once(name: str):
    """The frame is written once per folder of tables and session, and read by every query that uses it."""

    def wrap(make: Query) -> Query:
        return lambda spark, sf_dir: stage_once(spark, (name, sf_dir), lambda: make(spark, sf_dir), name)

    return wrap


@once("base")
def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept months with features, and peer groups cut at the volume quartiles."""
    return peers.quantile_bands(featured(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.score_against_peers(base(spark, sf_dir))


scored_once = once("peer_scores")(scored)


@once("forest_scores")
def forest_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer scores and forest score of every row."""
    rows = scored_once(spark, sf_dir)
    return isolation.score(rows, isolation.fit(rows))


@once("classified")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.classify(outliers.flag_z(isolation.apply_threshold(forest_scored(spark, sf_dir))))


def study_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest score and the z of the contamination study, where a constant group scores 0."""
    scores = forest_scored(spark, sf_dir).select("entity_id", "month", "peer_group", "log_total", "rate", "score")
    return outliers.zscore(scores, "rate", zero_std="null_to_zero")


@once("compared")
def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.compare_scores(base(spark, sf_dir))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.transitions(base(spark, sf_dir))


def bad_date_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.monthly_fact(facts.coerce_date(D.shipping_with_bad_dates(spark, sf_dir), "event_ts"))


def on_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.standardise(base(spark, sf_dir), ["log_total"])


# Sources and sinks ----------------------------------------------------------


@query
def monthly_fact(spark, sf_dir):
    return D.shipping_months(spark, sf_dir)


@query
def stage_roundtrip(spark, sf_dir):
    """The monthly fact through a Parquet stage and a CSV table with declared types."""
    root = f"{folder(spark)}/roundtrip-{uuid.uuid4().hex}"
    tables.write_stage(D.shipping_months(spark, sf_dir), f"{root}/parquet")
    first = tables.read_stage(spark, f"{root}/parquet", schemas.MONTHLY_FACT)
    tables.write_stage(first, f"{root}/csv", "csv")
    return tables.read_stage(spark, f"{root}/csv", schemas.MONTHLY_FACT, "csv")


# Quality, filters and audit ---------------------------------------------------


@query
def coerce_dates(spark, sf_dir):
    return bad_date_months(spark, sf_dir)


@query
def coerce_numeric(spark, sf_dir):
    text = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"),
        F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
    )
    return rounded(
        facts.coerce_numeric(text, ["quantity"])
        .groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("rows_n"),
            F.count_if(F.col("quantity").isNull()).alias("invalid_n"),
            F.sum("quantity").alias("quantity"),
        )
    )


@query
def period_cut(spark, sf_dir):
    return facts.period_cut(D.shipping_months(spark, sf_dir), START, END)


@query
def removed_rows(spark, sf_dir):
    return audit.removed_rows(bad_date_months(spark, sf_dir), START, END)


@query
def removal_reasons(spark, sf_dir):
    return audit.removal_reasons(bad_date_months(spark, sf_dir), START, END)


@query
def before_after_by_year(spark, sf_dir):
    return audit.before_after_by_year(D.shipping_months(spark, sf_dir), START, END)


@query
def before_after_by_entity(spark, sf_dir):
    return audit.before_after_by_entity(D.ordering_months(spark, sf_dir), D.ORDERS_START, D.ORDERS_END)


@query
def before_after_joined(spark, sf_dir):
    """The comparison by outer join of the raw and the cleaned table."""
    raw = D.ordering_months(spark, sf_dir)
    clean = facts.period_cut(raw, D.ORDERS_START, D.ORDERS_END)
    return audit.before_after_joined(raw, clean, F.year("month"), "year")


@query
def null_counts(spark, sf_dir):
    return audit.null_counts(bad_date_months(spark, sf_dir))


@query
def duplicate_keys(spark, sf_dir):
    return audit.duplicate_keys(D.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def validation_report(spark, sf_dir):
    return audit.validation_report(
        base(spark, sf_dir),
        ["entity_id", "month", "total", "cancelled_n", "rate", "log_total", "peer_group", "missing_share"],
        ["total", "cancelled_n", "rate", "log_total"],
        schemas.KEY,
        "peer_group",
    )


@query
def quality_report(spark, sf_dir):
    return audit.quality_report(bad_date_months(spark, sf_dir), START, END)


@query
def flag_diagnostics(spark, sf_dir):
    return audit.flag_diagnostics(D.shipping_kept(spark, sf_dir))


@query
def general_stats(spark, sf_dir):
    return audit.general_stats(D.shipping_months(spark, sf_dir), START, END)


@query
def period_bounds(spark, sf_dir):
    return audit.period_of(D.shipping_kept(spark, sf_dir))


@query
def removal_stats(spark, sf_dir):
    return audit.removal_stats(audit.before_after(D.ordering_months(spark, sf_dir), D.ORDERS_START, D.ORDERS_END))


@query
def excluded_entities(spark, sf_dir):
    return audit.excluded_entities(audit.before_after(D.ordering_months(spark, sf_dir), D.ORDERS_START, D.ORDERS_END))


@query
def excluded_entity_years(spark, sf_dir):
    return audit.excluded_entity_years(D.ordering_months(spark, sf_dir), D.ORDERS_START, D.ORDERS_END)


# Features -----------------------------------------------------------------------


@query
def features(spark, sf_dir):
    return rounded(facts.features(D.shipping_kept(spark, sf_dir)))


@query
def standardise(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return rounded(
        facts.standardise(rows, ["log_total", "rate"]).select("entity_id", "month", "log_total_std", "rate_std")
    )


@query
def calendar_parts(spark, sf_dir):
    return facts.calendar(D.shipping_months(spark, sf_dir)).select(
        "entity_id", "month", "year", "month_idx", "month_label"
    )


@query
def peer_gap(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("entity_id", "month", "peer_group", "gap_pp", "ratio"))


@query
def label_groups(spark, sf_dir):
    named = facts.label_groups(base(spark, sf_dir), labels.PEER_NAMES)
    return named.select("entity_id", "month", "peer_group", "peer_name")


# Peer groups ----------------------------------------------------------------------


def _group_ranges(df: DataFrame) -> DataFrame:
    return rounded(
        df.groupBy("peer_group").agg(
            F.count(F.lit(1)).alias("rows_n"),
            F.min("total").alias("total_min"),
            F.max("total").alias("total_max"),
            F.avg("log_total").alias("centre"),
        )
    )


@query
def peer_kmeans(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return _group_ranges(peers.fit_peers(rows).assign(rows))


@query
def peer_lloyd(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return _group_ranges(peers.fit_lloyd(rows, "log_total", iterations=5).assign(rows))


@query
def relabel_groups(spark, sf_dir):
    """Group numbers shuffled first, then put back in order of volume."""
    mixed = base(spark, sf_dir).withColumn("raw_group", (F.col("peer_group") * 3 + 2) % 4).drop("peer_group")
    return peers.relabel_by_mean(mixed, "raw_group").select("entity_id", "month", "raw_group", "peer_group")


@query
def k_sweep(spark, sf_dir):
    return peer_metrics.k_sweep(featured(spark, sf_dir))


@query
def cluster_inertia(spark, sf_dir):
    return rounded(peer_metrics.cluster_quality(on_log_scale(spark, sf_dir), "log_total_std").select("n", "inertia"))


@query
def silhouette(spark, sf_dir):
    return rounded(peer_metrics.silhouette(on_log_scale(spark, sf_dir), "log_total_std", 4))


@query
def davies_bouldin(spark, sf_dir):
    return rounded(peer_metrics.cluster_quality(on_log_scale(spark, sf_dir), "log_total_std").select("davies_bouldin"))


@query
def calinski_harabasz(spark, sf_dir):
    return rounded(
        peer_metrics.cluster_quality(on_log_scale(spark, sf_dir), "log_total_std").select("calinski_harabasz"), 4
    )


@query
def cluster_sizes(spark, sf_dir):
    return peer_metrics.cluster_sizes(base(spark, sf_dir))


@query
def cluster_profile(spark, sf_dir):
    return peer_metrics.characterise(base(spark, sf_dir))


@query
def cluster_by_year(spark, sf_dir):
    return peer_metrics.cluster_by_year(base(spark, sf_dir))


@query
def cluster_rules(spark, sf_dir):
    """The share of unknown flags stands for the optional missing share."""
    rows = base(spark, sf_dir).withColumn("missing_share", F.col("null_flag_n") / F.greatest("total", F.lit(1)))
    return peer_metrics.cluster_rules(rows, missing="missing_share")


# Scores ----------------------------------------------------------------------------


@query
def peer_stats(spark, sf_dir):
    return rounded(outliers.peer_stats(base(spark, sf_dir)))


@query
def zscore_peer(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("entity_id", "month", "peer_group", "rate", "rate_mean", "rate_std", "z"))


@query
def zscore_pop(spark, sf_dir):
    rows = outliers.zscore(base(spark, sf_dir), "rate", ddof=0, zero_std="none", out="z_pop")
    return rounded(rows.select("entity_id", "month", "peer_group", "z_pop"))


@query
def z_flags(spark, sf_dir):
    rows = outliers.flag_z(scored(spark, sf_dir))
    both = rows.withColumn("flag_two_sided", outliers.exceeds("z", labels.Z_MODERATE, "both"))
    return both.select("entity_id", "month", "flag_z_moderate", "flag_z_critical", "flag_two_sided")


@query
def mad_by_group(spark, sf_dir):
    return rounded(outliers.mad(base(spark, sf_dir), "total"))


@query
def mad_diagnostics(spark, sf_dir):
    return rounded(outliers.mad_diagnostics(base(spark, sf_dir)))


@query
def robust_zscore(spark, sf_dir):
    rows = outliers.robust_zscore(base(spark, sf_dir))
    return rounded(rows.select("entity_id", "month", "peer_group", "total", "robust_z", "flag_robust"))


@query
def direction(spark, sf_dir):
    return compared(spark, sf_dir).select("entity_id", "month", "direction_classic", "direction_robust")


@query
def percentile_rule(spark, sf_dir):
    rows = outliers.percentile_rule(base(spark, sf_dir))
    return rounded(rows.select(
        "entity_id",
        "month",
        *[F.col("limits")[i].alias(f"limit_{i}") for i in range(3)],
        *[F.col("above")[i].alias(f"above_{i}") for i in range(3)],
    ))


@query
def event_robust_zscore(spark, sf_dir):
    """The same score on another table: event values against their event type."""
    rows = outliers.robust_zscore(D.table(spark, sf_dir, "events"), "value", "event_type")
    return rounded(rows.select("event_id", "event_type", "robust_z", "flag_robust"))


@query
def event_limits(spark, sf_dir):
    return rounded(outliers.percentile_limits(D.table(spark, sf_dir, "events"), "value", "event_type"))


# Isolation forest --------------------------------------------------------------------


@query
def iforest_fit(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return rounded(isolation.fit(rows).nodes)


@query
def iforest_score(spark, sf_dir):
    rows = featured(spark, sf_dir).select(
        "entity_id", "month", "log_total", "rate"
    )
    return rounded(isolation.score(rows, isolation.fit(rows)).select("entity_id", "month", "score"))


#: A small forest (tree, node, feature, threshold, n) over log volume and rate, 8 rows a tree, 8 leaves in all.
SMALL_FOREST = (
    (0, 1, 0, 2.0, 8), (0, 2, 1, 0.3, 3), (0, 3, 0, 2.5, 5), (0, 4, -1, None, 1), (0, 5, -1, None, 2),
    (0, 6, 1, 0.5, 4), (0, 7, -1, None, 1), (0, 12, -1, None, 3), (0, 13, -1, None, 1),
    (1, 1, 1, 0.4, 8), (1, 2, -1, None, 5), (1, 3, 0, 1.5, 3), (1, 6, -1, None, 1), (1, 7, -1, None, 2),
)


@query
def iforest_boxes(spark, sf_dir):
    """A given small forest, its leaves as boxes, over all kept months."""
    rows = featured(spark, sf_dir).select("entity_id", "month", "log_total", "rate")
    forest = isolation.given_forest(spark, SMALL_FOREST, ("log_total", "rate"), trees=2, psi=8)
    return rounded(isolation.score_by_boxes(rows, forest).select("entity_id", "month", "score"))


@query
def iforest_score_boxes(spark, sf_dir):
    """The fitted forest by boxes: what `iforest_score` gives by its arrays."""
    rows = featured(spark, sf_dir).select("entity_id", "month", "log_total", "rate")
    return rounded(isolation.score_by_boxes(rows, isolation.fit(rows)).select("entity_id", "month", "score"))


@query
def iforest_threshold(spark, sf_dir):
    rows = isolation.apply_threshold(forest_scored(spark, sf_dir))
    return rounded(rows.select("entity_id", "month", "if_decision", "if_label", "if_intensity", "flag_forest"))


@query
def selectivity(spark, sf_dir):
    """Rate above mean + 2 deviations of the whole base, against the status of the analysis."""
    rows = outliers.global_zscore(classified(spark, sf_dir))
    return triage.selectivity(
        rows, F.col("z_global") > labels.Z_MODERATE, F.col("status") != labels.STATUS_NORMAL
    )


# Triage ---------------------------------------------------------------------------------


@query
def triage_status(spark, sf_dir):
    return classified(spark, sf_dir).select("entity_id", "month", "status")


@query
def reason_category(spark, sf_dir):
    return classified(spark, sf_dir).select("entity_id", "month", "reason")


@query
def explanation(spark, sf_dir):
    return classified(spark, sf_dir).select("entity_id", "month", "explanation")


@query
def justification(spark, sf_dir):
    return classified(spark, sf_dir).select("entity_id", "month", "justification")


@query
def priority_score(spark, sf_dir):
    return rounded(classified(spark, sf_dir).select("entity_id", "month", "priority"))


@query
def ranked_alerts(spark, sf_dir):
    rows = triage.rank_alerts(classified(spark, sf_dir))
    return rounded(rows.select("position", "entity_id", "month", "status", "priority", "if_intensity"))


@query
def status_distribution(spark, sf_dir):
    return triage.status_distribution(classified(spark, sf_dir))


@query
def reason_distribution(spark, sf_dir):
    return triage.reason_distribution(classified(spark, sf_dir))


@query
def top_alerts(spark, sf_dir):
    return triage.top_alerts(classified(spark, sf_dir))


@query
def peer_stats_report(spark, sf_dir):
    return rounded(triage.peer_stats_report(outliers.peer_stats(base(spark, sf_dir))))


@query
def peer_stats_published(spark, sf_dir):
    """The same under its published headings."""
    return facts.present(peer_stats_report(spark, sf_dir), labels.HEADINGS["peer_stats"])


@query
def top_alerts_full(spark, sf_dir):
    """The top cases with all columns, under their published headings."""
    return facts.present(triage.top_alerts(classified(spark, sf_dir)), labels.HEADINGS["top_alerts_full"])


@query
def alerts_by_cluster(spark, sf_dir):
    return triage.alerts_by_cluster(classified(spark, sf_dir))


@query
def alerts_by_cluster_report(spark, sf_dir):
    """The same under its published headings."""
    rows = triage.alerts_by_cluster(classified(spark, sf_dir))
    return facts.present(rows, labels.HEADINGS["alerts_by_cluster"])


@query
def describe_columns(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return rounded(triage.describe(rows, ["total", "log_total", "rate"]))


# Sensitivity -------------------------------------------------------------------------------


@query
def percentile_vs_z(spark, sf_dir):
    return rounded(sensitivity.percentile_vs_z(base(spark, sf_dir)))


@query
def percentile_vs_z_global(spark, sf_dir):
    return rounded(sensitivity.percentile_vs_z_global(sensitivity.percentile_vs_z(base(spark, sf_dir))))


@query
def contamination_sweep(spark, sf_dir):
    return sensitivity.contamination_sweep(study_scored(spark, sf_dir))


@query
def contamination_overlap(spark, sf_dir):
    return sensitivity.contamination_overlap(study_scored(spark, sf_dir))


@query
def method_comparison(spark, sf_dir):
    return sensitivity.method_comparison(compared(spark, sf_dir))


@query
def method_overlap(spark, sf_dir):
    return sensitivity.method_overlap(compared(spark, sf_dir))


@query
def method_by_cluster(spark, sf_dir):
    return sensitivity.method_by_cluster(compared(spark, sf_dir))


@query
def spearman(spark, sf_dir):
    return rounded(outliers.spearman(compared(spark, sf_dir), "z", "robust_z"))


@query
def spearman_report(spark, sf_dir):
    return rounded(sensitivity.spearman_report(compared(spark, sf_dir)))


@query
def top_abs_z(spark, sf_dir):
    return sensitivity.top_by_abs(compared(spark, sf_dir), "z", "flag_robust")


@query
def top_abs_robust(spark, sf_dir):
    return sensitivity.top_by_abs(compared(spark, sf_dir), "robust_z", "flag_classic")


# Temporal stability ----------------------------------------------------------------------------


@query
def peer_transitions(spark, sf_dir):
    return moves(spark, sf_dir)


@query
def entity_stability(spark, sf_dir):
    return rounded(stability.stability(moves(spark, sf_dir)))


@query
def persistence_bands(spark, sf_dir):
    return stability.persistence_bands(stability.stability(moves(spark, sf_dir)))


@query
def persistence_summary(spark, sf_dir):
    return stability.persistence_summary(stability.stability(moves(spark, sf_dir)))


@query
def transition_matrix(spark, sf_dir):
    return stability.transition_matrix(moves(spark, sf_dir))


@query
def least_stable(spark, sf_dir):
    return rounded(stability.least_stable(stability.stability(moves(spark, sf_dir))))


# Chart data ---------------------------------------------------------------------------------------


@query
def histogram(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return rounded(chartdata.histogram(rows, "log_total"))


@query
def persistence_histogram(spark, sf_dir):
    return chartdata.persistence_histogram(stability.stability(moves(spark, sf_dir)))


@query
def box_stats(spark, sf_dir):
    return rounded(chartdata.box_stats(base(spark, sf_dir), "log_total"))


@query
def trim_p99(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return rounded(chartdata.trim_upper(rows, "rate").select("entity_id", "month", "rate"))


@query
def clip_p995(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return rounded(chartdata.clip_upper(rows, "rate").select("entity_id", "month", "rate", "clipped"))


@query
def sample_rows(spark, sf_dir):
    rows = featured(spark, sf_dir)
    return rounded(chartdata.sample_rows(rows.select("entity_id", "month", "log_total", "rate")))


@query
def flag_series(spark, sf_dir):
    return chartdata.flag_series(audit.flag_diagnostics(D.shipping_kept(spark, sf_dir)), 1997, 2000)


@query
def monthly_series(spark, sf_dir):
    return chartdata.monthly_series(D.shipping_kept(spark, sf_dir))


@query
def status_counts(spark, sf_dir):
    return chartdata.status_counts(classified(spark, sf_dir))


@query
def top_labelled(spark, sf_dir):
    return chartdata.top_labelled(classified(spark, sf_dir))


@query
def alerts_crosstab(spark, sf_dir):
    return chartdata.crosstab(classified(spark, sf_dir))


@query
def alerts_by_year(spark, sf_dir):
    return chartdata.alerts_by_year(classified(spark, sf_dir))
