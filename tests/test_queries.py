"""Named queries against their SQL statements on the smallest tables.

All of them with PEERWATCH_ALL=1; otherwise one of each family.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from peerwatch.plans import catalog, oracles
from peerwatch.sources.staging import run_folder
from oracle_check import compare, connect

FAMILIES = [
    "monthly_fact", "stage_roundtrip", "coerce_numeric", "removed_rows", "before_after_by_entity", "validation_report",
    "excluded_entity_years", "standardise", "peer_lloyd", "peer_kmeans", "k_sweep", "silhouette", "cluster_profile", "peer_stats", "mad_diagnostics",
    "percentile_vs_z", "peer_stats_published", "top_alerts_full", "iforest_fit", "justification", "ranked_alerts", "contamination_sweep", "spearman", "entity_stability",
    "histogram", "box_stats", "alerts_crosstab",
]
KNOWN = catalog.QUERIES
NAMES = sorted(KNOWN) if os.environ.get("PEERWATCH_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, con, name):
    got = queries()[name](spark, sf_dir).toArrow()
    assert compare(got, con.sql(oracle_sql()[name]).to_arrow_table()) == []


def test_every_statement_has_a_query():
    assert set(oracles.oracle_sql()) == set(KNOWN)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name, most", [("zscore_peer", 14), ("ranked_alerts", 34), ("k_sweep", 30)])
def test_queries_take_few_jobs(spark, sf_dir, name, most):
    """From the raw table; adaptive execution counts every shuffle as a job.

    A pass of quantiles is two shuffles and a write, as its cells stay a table; gathered on the driver it was one job less each time.
    """
    with run_folder(spark):
        spark.sparkContext.setJobGroup(f"count-{name}", name)
        try:
            queries()[name](spark, sf_dir).toArrow()
        finally:
            spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"count-{name}")) <= most
