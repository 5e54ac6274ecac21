"""Stability of peer groups over time.

Windows and aggregates run per entity on the monthly table, where an entity has
one row per month, so no partition grows with the number of transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.operators.audit import unstack


def transitions(df: DataFrame, group: str = "peer_group") -> DataFrame:
    """Previous group and month, distance in months, and whether the group changed.

    Only directly consecutive months are compared.
    """
    before = Window.partitionBy("entity_id").orderBy("month")
    lagged = df.where(F.col("entity_id").isNotNull() & F.col("month").isNotNull()).select(
        "entity_id", "month", group, F.lag(group).over(before).alias("prev_group"), F.lag("month").over(before).alias("prev_month")
    )
    valid = F.col("prev_group").isNotNull() & F.coalesce(F.col("distance") == 1, F.lit(False))
    return (
        lagged.withColumn("distance", C.month_index("month") - C.month_index("prev_month"))
        .withColumn("comparable", valid)
        .withColumns({
            "changed": F.col("comparable") & (F.col(group) != F.coalesce("prev_group", group)),
            "stayed": F.col("comparable") & (F.col(group) == F.coalesce("prev_group", F.lit(-1))),
        })
    )


def stability(moves: DataFrame, group: str = "peer_group") -> DataFrame:
    """Per entity: months, comparisons, changes, persistence, main group (ties: smallest) and groups visited.

    Shares the entity partitioning of `transitions`, so it adds no shuffle.
    """
    return (
        moves.groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("months_n"),
            F.count_if("comparable").alias("comparisons_n"),
            F.count_if("changed").alias("changes_n"),
            F.count_if("stayed").alias("stays_n"),
            F.mode(group, True).alias("main_group"),
            F.size(F.collect_set(group)).cast("bigint").alias("groups_n"),
        )
        .withColumn("persistence", C.percent("stays_n", "comparisons_n", None))
        .select(
            "entity_id", "months_n", "comparisons_n", "changes_n", "stays_n", "persistence", "main_group", "groups_n"
        )
    )


def persistence_bands(stable: DataFrame) -> DataFrame:
    """Entities per band in fixed order, zero-filled, with a total row."""
    band = C.persistence_band("persistence")
    names = [name for name, _ in labels.BANDS]
    counts = stable.where(F.col("persistence").isNotNull()).agg(
        *[F.count_if(band == name).alias(f"b{i}") for i, name in enumerate(names)], F.count(F.lit(1)).alias("all_n")
    )
    lines = [(name, f"b{i}") for i, name in enumerate(names)] + [(labels.TOTAL_ROW, "all_n")]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("band"), F.col(n).alias("entities_n"))
        for i, (name, n) in enumerate(lines, 1)
    ])
    share = F.when(F.col("r.band") == labels.TOTAL_ROW, F.lit(100.0)).otherwise(C.percent("r.entities_n", "all_n"))
    return counts.select("all_n", F.explode(rows).alias("r")).select(
        "r.position", "r.band", "r.entities_n", share.alias("entities_pct")
    ).orderBy("position")


def persistence_summary(stable: DataFrame) -> DataFrame:
    """Fifteen indicators.

    Persistence is a ratio of month counts and changes are month counts, so the
    exact medians see few distinct values however many entities there are.
    """
    compared = F.col("persistence").isNotNull()
    changes = F.when(compared, F.col("changes_n"))
    row = stable.agg(
        F.count(F.lit(1)).cast("double").alias("v0"),
        F.count_if(compared).cast("double").alias("v1"),
        F.count_if(~compared).cast("double").alias("v2"),
        F.count_if(changes == 0).cast("double").alias("v3"),
        F.count_if(changes == 1).cast("double").alias("v4"),
        F.count_if(changes == 2).cast("double").alias("v5"),
        F.count_if(changes >= 3).cast("double").alias("v6"),
        F.count_if(changes > 0).cast("double").alias("v7"),
        F.bround(F.avg("persistence"), 2).alias("v8"),
        F.bround(F.median("persistence"), 2).alias("v9"),
        F.bround(F.min("persistence"), 2).alias("v10"),
        F.bround(F.max("persistence"), 2).alias("v11"),
        F.bround(F.avg(changes), 2).alias("v12"),
        F.bround(F.median(changes), 2).alias("v13"),
        F.max(changes).cast("double").alias("v14"),
    )
    return unstack(row, row.columns, labels.PERSISTENCE_ROWS)


def transition_matrix(moves: DataFrame, group: str = "peer_group") -> DataFrame:
    return (
        moves.where("changed")
        .groupBy(F.col("prev_group").alias("origin"), F.col(group).alias("destination"))
        .agg(F.count(F.lit(1)).alias("rows_n"))
        .orderBy(F.desc("rows_n"), "origin", "destination")
    )


def least_stable(stable: DataFrame, n: int = labels.TOP_CASES) -> DataFrame:
    """The n entities with the lowest persistence; more changes first among equals."""
    return (
        stable.where(F.col("persistence").isNotNull())
        .orderBy("persistence", F.desc("changes_n"), "entity_id")
        .limit(n)
    )
