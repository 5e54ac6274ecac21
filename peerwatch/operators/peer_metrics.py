"""Quality, size and profile of peer groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.operators.ordering import ranged
from peerwatch.operators.peers import PeerModel, band_scatter, fit_many, histogram
from peerwatch.operators.quantiles import quantile_columns
from peerwatch.sources.staging import attach, local_table


SCATTER = T.StructType([
    T.StructField("k", T.IntegerType()), T.StructField("peer_group", T.IntegerType()), T.StructField("centre", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("abs_dev", T.DoubleType()), T.StructField("sq_dev", T.DoubleType()),
])


def cluster_scatter(
    df: DataFrame, x: str, group: str = "peer_group", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Per group: rows, centre, summed absolute and squared distance to the centre."""
    keys = [*by, group]
    w = F.col(weight) if weight else F.lit(1)
    centres = df.groupBy(*keys).agg((F.sum(F.col(x) * w) / F.sum(w)).alias("centre"))
    gap = F.col(x) - F.col("centre")
    return (
        attach(df.select(*keys, x, *([weight] if weight else [])), centres, keys)
        .groupBy(*keys, "centre")
        .agg(F.sum(w).alias("n"), F.sum(F.abs(gap) * w).alias("abs_dev"), F.sum(gap * gap * w).alias("sq_dev"))
    )


def cluster_quality(
    df: DataFrame, x: str, group: str = "peer_group", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Inertia, Davies-Bouldin, Calinski-Harabasz and group sizes; one row per `by`."""
    return scatter_quality(cluster_scatter(df, x, group, by, weight), by)


def scatter_quality(scatter: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from the groups' centres and deviations; the pairwise part runs over an array of the k centres."""
    gathered = scatter.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k_found"),
        F.sum("n").alias("n"),
        F.sum("sq_dev").alias("inertia"),
        (F.sum(F.col("centre") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.array_sort(
            F.collect_list(F.struct("centre", "n", (F.col("abs_dev") / F.col("n")).alias("dev")))
        ).alias("g"),
    )

    def worst(one: Column) -> Column:
        others = F.filter("g", lambda o: o["centre"] != one["centre"])
        return F.array_max(
            F.transform(others, lambda o: (one["dev"] + o["dev"]) / F.abs(one["centre"] - o["centre"]))
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    between = total(
        F.transform("g", lambda o: o["n"] * (o["centre"] - F.col("mean")) * (o["centre"] - F.col("mean")))
    )
    ratio = F.try_divide(between * (F.col("n") - F.col("k_found")), F.col("inertia") * (F.col("k_found") - 1))
    return gathered.select(
        *by,
        "k_found",
        "n",
        "inertia",
        (total(F.transform("g", worst)) / F.col("k_found")).alias("davies_bouldin"),
        F.when(F.col("inertia") == 0, F.lit(1.0)).otherwise(ratio).alias("calinski_harabasz"),
        "smallest",
        "largest",
    )


def silhouette(
    rows: DataFrame, x: str, k: int, group: str = "peer_group", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Mean Euclidean silhouette of all rows, exact in one dimension.

    Distances from a value to a whole group follow from the group's running
    count and sum along the sorted values, so no pairs are formed.  Distinct
    values are dealt by ranges; running sums are those of the earlier ranges plus
    those inside the range, so no column of values meets in one task.  Equal
    values may fall either side of a border: their distance is zero.
    """
    if weight:  # value counts already
        counts = rows.select(*by, F.col(x).alias("x"), F.col(group).alias("g"), F.col(weight).alias("n"))
    else:
        counts = rows.groupBy(*by, F.col(x).alias("x"), F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    placed = ranged(counts, [*map(F.col, by), F.col("x"), F.col("g")])
    value = F.col("x")

    def in_group(g: int, what: Column) -> Column:
        return F.when(F.col("g") == g, what).otherwise(0)

    parts = placed.groupBy("_part", *by).agg(
        *[F.sum(in_group(g, F.col("n"))).alias(f"pn{g}") for g in range(k)],
        *[F.sum(in_group(g, value * F.col("n"))).alias(f"ps{g}") for g in range(k)],
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)  # one row per range
    names = [f"{c}{g}" for c in ("n", "s") for g in range(k)]
    borders = parts.select(
        "_part", *by,
        *[F.coalesce(F.sum(f"p{name}").over(earlier), F.lit(0)).alias(f"b{name}") for name in names],
        *[F.sum(f"p{name}").over(whole).alias(f"t{name}") for name in names],
    )
    inside = Window.partitionBy("_part", *by).orderBy("x", "g").rowsBetween(Window.unboundedPreceding, 0)
    wide = placed.join(borders, ["_part", *by]).select(
        *by, "x", "g", "n", *[f"t{name}" for name in names],
        *[(F.col(f"bn{g}") + F.sum(in_group(g, F.col("n"))).over(inside)).alias(f"cn{g}") for g in range(k)],
        *[(F.col(f"bs{g}") + F.sum(in_group(g, value * F.col("n"))).over(inside)).alias(f"cs{g}") for g in range(k)],
    )

    def distance(g: int) -> Column:
        below, below_sum = F.col(f"cn{g}"), F.col(f"cs{g}")
        return value * below - below_sum + (F.col(f"ts{g}") - below_sum) - value * (F.col(f"tn{g}") - below)

    own = F.coalesce(*[F.when(F.col("g") == g, distance(g) / F.nullif(F.col(f"tn{g}") - 1, F.lit(0))) for g in range(k)])
    other = F.array_min(F.array(*[
        F.when((F.col("g") != g) & (F.col(f"tn{g}") > 0), distance(g) / F.col(f"tn{g}")) for g in range(k)
    ]))
    scored = wide.select(*by, "n", own.alias("a"), other.alias("b"))
    one = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return scored.groupBy(*by).agg((F.sum(one * F.col("n")) / F.sum("n")).alias("silhouette"))


def k_sweep(
    df: DataFrame, column: str = "log_total", ks=labels.PEER_COUNTS_TRIED, n_init: int = labels.KMEANS_RESTARTS,
    seed: int = labels.SEED,
) -> DataFrame:
    """Quality of each group count."""
    return sweep(df, column, ks, n_init, seed)[0]


def sweep(
    df: DataFrame, column: str = "log_total", ks=labels.PEER_COUNTS_TRIED, n_init: int = labels.KMEANS_RESTARTS,
    seed: int = labels.SEED,
) -> tuple[DataFrame, dict[int, PeerModel]]:
    """Quality of each group count, and the models.

    All counts share one table of value counts, one fit loop, and one pass each
    for the indices and the silhouettes.
    """
    ks = list(ks)
    hist = histogram(df, column)
    models = fit_many(df, column, ks, n_init, seed, hist=hist)
    choices = F.array(*[F.struct(F.lit(k).alias("k"), C.band("x", models[k].cuts()).alias("peer_group")) for k in ks])
    assigned = hist.counts.select("x", "w", F.explode(choices).alias("c")).select("x", "w", "c.k", "c.peer_group")
    cuts = {k: models[k].cuts() for k in ks}
    quality = scatter_quality(local_table(df.sparkSession, band_scatter(hist, cuts), SCATTER), ["k"])
    silhouettes = silhouette(assigned, "x", max(ks), by=["k"], weight="w")
    return quality.join(silhouettes, "k").select(
        "k",
        F.bround("inertia", 2).alias("inertia"),
        F.bround("silhouette", 4).alias("silhouette"),
        F.bround("davies_bouldin", 4).alias("davies_bouldin"),
        F.bround("calinski_harabasz", 2).alias("calinski_harabasz"),
        "smallest",
        "largest",
    ).orderBy("k"), models


def cluster_sizes(df: DataFrame, group: str = "peer_group") -> DataFrame:
    """Rows per group with the smallest and largest size."""
    whole = Window.partitionBy()
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows_n"))
    return counts.select(
        group, "rows_n", F.min("rows_n").over(whole).alias("smallest"), F.max("rows_n").over(whole).alias("largest")
    ).orderBy(group)


def characterise(df: DataFrame, group: str = "peer_group") -> DataFrame:
    """Rows, entities, volume and rate of each group, with its share of the base."""
    medians = quantile_columns(df, {"total_median": ("total", 0.5), "rate_median": ("rate", 0.5)}, [group])
    profile = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows_n"),
        F.countDistinct("entity_id").alias("entities_n"),
        F.min("total").alias("total_min"),
        F.avg("total").alias("total_mean"),
        F.max("total").alias("total_max"),
        F.avg("rate").alias("rate_mean"),
    )
    base = F.sum("rows_n").over(Window.partitionBy())
    return profile.join(medians, group).select(
        group,
        "rows_n",
        "entities_n",
        "total_min",
        F.bround("total_mean", 2).alias("total_mean"),
        F.bround("total_median", 2).alias("total_median"),
        "total_max",
        F.bround(F.col("rate_mean") * 100, 4).alias("rate_mean_pct"),
        F.bround(F.col("rate_median") * 100, 4).alias("rate_median_pct"),
        C.percent("rows_n", base).alias("base_pct"),
    ).orderBy(group)


def cluster_by_year(df: DataFrame, group: str = "peer_group") -> DataFrame:
    return (
        df.groupBy(F.year("month").alias("year"), group)
        .agg(F.count(F.lit(1)).alias("rows_n"))
        .orderBy("year", group)
    )


def cluster_rules(
    df: DataFrame, group: str = "peer_group", missing: str | None = None, rate_limit: float = labels.PROFILE_RATE,
    total_limit: float = labels.PROFILE_TOTAL, missing_limit: float = labels.PROFILE_MISSING,
) -> DataFrame:
    """Rule-based profile per group; first match wins.

    Without a column for the missing share its rule is skipped and its mean is NULL.
    """
    share = F.avg(missing) if missing else F.lit(None).cast("double")
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows_n"),
        F.countDistinct("entity_id").alias("entities_n"),
        F.avg("total").alias("total_avg"),
        F.avg("rate").alias("rate_avg"),
        share.alias("missing_avg"),
    )
    profile = (
        F.when(F.col("rate_avg") >= rate_limit, F.lit(labels.PROFILE_HIGH_RATE))
        .when(F.col("total_avg") >= total_limit, F.lit(labels.PROFILE_HIGH_VOLUME))
        .when(F.col("missing_avg") >= missing_limit, F.lit(labels.PROFILE_HIGH_MISSING))
        .otherwise(F.lit(labels.PROFILE_LOW_MISSING))
    )
    base = F.sum("rows_n").over(Window.partitionBy())
    return stats.select(
        group,
        "rows_n",
        C.percent("rows_n", base).alias("base_pct"),
        "entities_n",
        F.bround("total_avg", 0).cast("bigint").alias("total_mean"),
        F.bround(F.col("rate_avg") * 100, 2).alias("rate_mean_pct"),
        F.bround(F.col("missing_avg") * 100, 2).alias("missing_mean_pct"),
        profile.alias("profile"),
    ).orderBy(group)
