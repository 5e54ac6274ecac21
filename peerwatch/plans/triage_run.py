"""The whole analysis as one staged run.

    python -m peerwatch.plans.triage_run SOURCE OUT [--format parquet] [--resume] [--from STEP]

The steps are extract, group, score, study and charts. Each reads the Parquet
tables that the steps before wrote under OUT/stages, and leaves an entry under
OUT/manifest when all it writes is there. With --resume, steps go on being
skipped as long as their entry was made from the same source, bounds and
parameters: a lost driver costs the step it was in. With --from, the run starts at
a step, from tables already staged; their columns and types are checked first.
Reports go to OUT/reports as CSV under their published headings: one file for
reports of fixed size, partitioned for those with a row per entity.
"""

from __future__ import annotations

import argparse
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

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
from peerwatch.sources import manifest, tables
from peerwatch.sources.manifest import Manifest
from peerwatch.sources.staging import run_folder

STEPS = ("extract", "group", "score", "study", "charts")
#: The table a step starts from, the one it leaves to the next, and what staged tables must hold.
NEEDS = {"group": "monthly", "score": "features", "study": "scored"}
LEAVES = {"extract": "monthly", "group": "features", "score": "scored"}
STAGES = {
    "monthly": schemas.MONTHLY_FACT, "features": schemas.FEATURES, "scored": schemas.SCORED, "stability": schemas.STABILITY,
}
SCORED_FROM = ["total", "cancelled_n", "rate", "log_total"]
PER_ENTITY = {"before_after_by_entity", "excluded_entities", "excluded_entity_years", "entity_stability"}


class Run:
    """Where a run keeps its stages and reports, and what the step at hand has written."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self.manifest = Manifest(spark, f"{self.out}/manifest")
        self.written: list[str] = []
        self.staged: dict[str, str] = {}

    def stage(self, name: str, df: DataFrame, gate: audit.Gate | None = None) -> DataFrame:
        """Write a stage and go on from it; a gate counts while it is written and raises afterwards."""
        path = f"{self.out}/stages/{name}"
        tables.write_stage(gate.watch(df) if gate else df, path)
        self.staged[name] = df.schema.simpleString()
        held = self.spark.read.schema(df.schema).parquet(path)
        return gate.verify(held) if gate else held

    def load(self, name: str, optional: bool = False) -> DataFrame | None:
        """A table staged by an earlier step, with its declared columns and types; None if it is optional and was never written."""
        path, schema = f"{self.out}/stages/{name}", STAGES[name]
        if optional and tables.read_stage(self.spark, path, T.StructType([]), optional=True) is None:
            return None
        return tables.require_types(self.spark.read.parquet(path), schema)

    def report(self, name: str, df: DataFrame, headings: str | None = None) -> None:
        titles = labels.HEADINGS.get(headings or name)
        shown = facts.present(df, titles) if titles else df
        path = f"{self.out}/reports/{name}"
        if name in PER_ENTITY:
            tables.write_stage(shown, path, "csv")
        else:
            tables.write_report(shown, path)
        self.written.append(name)


def extract(run: Run, transactions: DataFrame, start: date, end: date) -> DataFrame:
    """Monthly fact, its audit, and the kept rows."""
    tables.require_columns(transactions, schemas.TRANSACTIONS.fieldNames())
    raw = run.stage("monthly_all", facts.monthly_fact(facts.coerce_date(transactions, "event_ts")))
    run.stage("removed", audit.removed_rows(raw, start, end))
    run.report("removal_reasons", audit.removal_reasons(raw, start, end))
    run.report("before_after_by_year", audit.before_after_by_year(raw, start, end))
    run.report("before_after_by_entity", audit.before_after_by_entity(raw, start, end))
    run.report("general_stats", audit.general_stats(raw, start, end))
    run.report("quality_report", audit.quality_report(raw, start, end))
    run.report("null_counts", audit.null_counts(raw))
    by_entity = audit.before_after(raw, start, end)
    run.report("removal_stats", audit.removal_stats(by_entity))
    run.report("excluded_entities", audit.excluded_entities(by_entity), "before_after_by_entity")
    run.report("excluded_entity_years", audit.excluded_entity_years(raw, start, end))
    counts = ["total", "cancelled_n"]
    clean = run.stage(
        "monthly", facts.period_cut(raw, start, end).where(F.col("entity_id").isNotNull()),
        audit.Gate([*schemas.KEY, *counts], counts, schemas.KEY),
    )
    run.report("flag_diagnostics", audit.flag_diagnostics(clean))
    run.report("period_bounds", audit.period_of(clean))
    return clean


def group(run: Run, clean: DataFrame, k: int = labels.PEER_COUNT) -> DataFrame:
    """Features and peer groups."""
    featured = facts.features(clean)
    tried, models = peer_metrics.sweep(featured, ks=sorted({*labels.PEER_COUNTS_TRIED, k}))
    run.report("k_sweep", tried)
    assigned = models[k].assign(featured, "raw_group")
    grouped = run.stage(
        "features", facts.in_order(peers.relabel_by_mean(assigned, "raw_group"), schemas.FEATURES),
        audit.Gate([*schemas.KEY, *SCORED_FROM, "peer_group"], SCORED_FROM, schemas.KEY, "peer_group"),
    )
    run.report("cluster_profile", peer_metrics.characterise(grouped))
    run.report("cluster_rules", peer_metrics.cluster_rules(grouped))
    run.report("cluster_by_year", peer_metrics.cluster_by_year(grouped))
    run.report("cluster_sizes", peer_metrics.cluster_sizes(grouped))
    run.report("feature_statistics", triage.describe(grouped, ["total", "log_total", "rate"]))
    return grouped


def score(run: Run, grouped: DataFrame, contamination: float = labels.CONTAMINATION) -> DataFrame:
    """z-scores, forest, status and ranked alerts."""
    stats = outliers.peer_stats(grouped)
    run.report("peer_stats", triage.peer_stats_report(stats))
    rows = outliers.score_against_peers(grouped)
    forest = isolation.fit(rows)
    run.stage("forest", forest.nodes)
    scores = run.stage("scores", isolation.score(rows, forest))
    classified = run.stage(
        "scored", triage.classify(outliers.flag_z(isolation.apply_threshold(scores, contamination)))
    )
    run.stage("alerts", triage.rank_alerts(classified))
    run.report("status_distribution", triage.status_distribution(classified))
    run.report("reason_distribution", triage.reason_distribution(classified))
    top = triage.top_alerts(classified)
    run.report("top_alerts", top)
    run.report("top_alerts_full", top)
    wide = outliers.global_zscore(classified)
    run.report("selectivity", triage.selectivity(
        wide, F.col("z_global") > labels.Z_MODERATE, F.col("status") != labels.STATUS_NORMAL
    ))
    run.report("alerts_by_cluster", triage.alerts_by_cluster(classified))
    run.report("score_statistics", triage.describe(classified, ["total", "cancelled_n", "rate", "z", "if_decision", "priority"]))
    return classified


def study(run: Run, classified: DataFrame) -> None:
    """Sensitivity of the rules and stability of the groups."""
    run.report("mad_diagnostics", outliers.mad_diagnostics(classified))
    by_group = sensitivity.percentile_vs_z(classified)
    run.report("percentile_vs_z", by_group)
    run.report("percentile_vs_z_global", sensitivity.percentile_vs_z_global(by_group))
    # This study scores a constant group 0.
    scores = classified.select("entity_id", "month", "peer_group", "rate", "score")
    rescored = outliers.zscore(scores, "rate", zero_std="null_to_zero")
    run.report("contamination_sweep", sensitivity.contamination_sweep(rescored))
    run.report("contamination_overlap", sensitivity.contamination_overlap(rescored))
    plain = classified.select("entity_id", "month", "peer_group", "total")
    compared = run.stage("compared", outliers.compare_scores(plain))
    run.report("method_comparison", sensitivity.method_comparison(compared))
    run.report("method_overlap", sensitivity.method_overlap(compared))
    run.report("method_by_cluster", sensitivity.method_by_cluster(compared))
    run.report("spearman_report", sensitivity.spearman_report(compared))
    run.report("top_abs_z", sensitivity.top_by_abs(compared, "z", "flag_robust"))
    run.report("top_abs_robust", sensitivity.top_by_abs(compared, "robust_z", "flag_classic"))
    moves = run.stage("moves", stability.transitions(classified))
    stable = run.stage("stability", stability.stability(moves))
    run.report("entity_stability", stable)
    run.report("persistence_bands", stability.persistence_bands(stable))
    run.report("persistence_summary", stability.persistence_summary(stable))
    run.report("transition_matrix", stability.transition_matrix(moves))
    run.report("least_stable", stability.least_stable(stable), "entity_stability")


def charts(run: Run) -> None:
    """Tables behind the figures, from whatever earlier steps have staged; a table that is not there skips its charts only."""
    clean = run.load("monthly", optional=True)
    if clean is not None:
        run.report("flag_series", chartdata.flag_series(audit.flag_diagnostics(clean)))
        run.report("monthly_series", chartdata.monthly_series(clean))
    grouped = run.load("features", optional=True)
    if grouped is not None:
        run.report("log_total_histogram", chartdata.histogram(grouped, "log_total"))
        run.report("log_total_boxes", chartdata.box_stats(grouped, "log_total"))
        percent = grouped.withColumn("rate_pct", F.col("rate") * 100)
        run.report("rate_histogram", chartdata.histogram(chartdata.trim_upper(percent, "rate_pct"), "rate_pct"))
        scatter = chartdata.sample_rows(percent.select("entity_id", "month", "peer_group", "log_total", "rate_pct"))
        run.report("scatter", chartdata.clip_upper(run.stage("scatter", scatter), "rate_pct"))
    classified = run.load("scored", optional=True)
    if classified is not None:
        run.report("status_counts", chartdata.status_counts(classified))
        run.report("top_labelled", chartdata.top_labelled(classified))
        run.report("alerts_crosstab", chartdata.crosstab(facts.label_groups(classified, labels.PEER_NAMES), "peer_name"))
        run.report("alerts_by_year", chartdata.alerts_by_year(classified))
    stable = run.load("stability", optional=True)
    if stable is not None:
        run.report("persistence_histogram", chartdata.persistence_histogram(stable))


def execute(
    spark: SparkSession, transactions: DataFrame | None, out: str, start: date = labels.PERIOD_START,
    end: date = labels.PERIOD_END, k: int = labels.PEER_COUNT, contamination: float = labels.CONTAMINATION,
    first: str = STEPS[0], resume: bool = False, source: str | None = None,
) -> list[str]:
    """Run the steps; returns the names of all reports there are, those of skipped steps included.

    `first` starts at a step: the table it needs must be staged, and
    `transactions` is not looked at. A staged table that no entry vouches for
    passes the gates before it is used. With `resume`, steps whose entry has
    the wanted mark are skipped. The mark of the source is `source`, or made from its
    files; a source with neither is always read anew.
    """
    run = Run(spark, out)
    at = STEPS.index(first)
    parameters = {"extract": (start, end), "group": (k,), "score": (contamination, labels.TREES, labels.SEED), "study": (), "charts": ()}
    makes = {
        "extract": lambda given: extract(run, transactions, start, end),
        "group": lambda given: group(run, given, k),
        "score": lambda given: score(run, given, contamination),
        "study": lambda given: study(run, given),
        "charts": lambda given: charts(run),
    }
    reports: list[str] = []
    with run_folder(spark):
        if at == 0:
            mark = source or manifest.source_mark(transactions)
            mark = mark or f"unknown {uuid.uuid4()}"
            given = None
        else:
            entry = run.manifest.entry(STEPS[at - 1])
            mark = entry.mark if entry else f"unknown {uuid.uuid4()}"
            given = _given(run, STEPS[at], entry)
        for step in STEPS[at:]:
            mark = manifest.mark(step, mark, *parameters[step])
            entry = run.manifest.entry(step) if resume else None
            left = run.load(LEAVES[step], optional=True) if entry and step in LEAVES else given
            if entry and entry.mark == mark and (left is not None or step not in LEAVES):
                given, reports = left, reports + entry.reports
                continue
            resume = False
            run.written, run.staged = [], {}
            made = makes[step](given)
            given = made if made is not None else given
            run.manifest.finish(manifest.Entry(step, mark, run.staged, run.written))
            reports += run.written
    return reports


def _given(run: Run, step: str, entry: manifest.Entry | None) -> DataFrame | None:
    """The staged table that a step starts from."""
    if step not in NEEDS:
        return None
    table = run.load(NEEDS[step])
    if entry is None:
        grouped = "peer_group" in table.columns
        numeric = SCORED_FROM if grouped else ["total", "cancelled_n"]
        audit.validate(
            table, [*schemas.KEY, *numeric, *(["peer_group"] if grouped else [])], numeric, schemas.KEY, "peer_group" if grouped else None
        )
    return table


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("source", help="table with entity_id, event_ts, cancelled: a path or a jdbc: address")
    parser.add_argument("out", help="folder every executor can reach")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="reader option")
    parser.add_argument("--start", type=date.fromisoformat, default=labels.PERIOD_START)
    parser.add_argument("--end", type=date.fromisoformat, default=labels.PERIOD_END)
    parser.add_argument("--groups", type=int, default=labels.PEER_COUNT)
    parser.add_argument("--contamination", type=float, default=labels.CONTAMINATION)
    parser.add_argument("--from", dest="first", choices=STEPS, default=STEPS[0], help="start at this step, from tables already staged")
    parser.add_argument("--resume", action="store_true", help="skip the steps that are finished and still valid")
    args = parser.parse_args()
    from peerwatch.session import SETTINGS

    builder = SparkSession.builder.appName("peerwatch")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    options = dict(pair.split("=", 1) for pair in args.option)
    source = tables.read_source(spark, args.source, args.format, **options) if args.first == STEPS[0] else None
    for name in execute(
        spark, source, args.out, args.start, args.end, args.groups, args.contamination, args.first, args.resume
    ):
        print(name)


if __name__ == "__main__":
    main()
