"""Quality audit of the monthly fact.

`raw` is the monthly fact before the period cut.  Before and after are counted
together in one pass over it: a row is kept when its month lies in the period.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from peerwatch import labels
from peerwatch.functions import columns as C


def kept(start, end, month: str = "month") -> Column:
    """True inside the period, False outside or without a month."""
    return F.coalesce(F.col(month).between(F.lit(start), F.lit(end)), F.lit(False))


def reason_titles(start, end) -> tuple[str, str, str]:
    """Invalid, before and after, worded from the bounds; a period that begins in January is named by its year."""
    start, end = (d if isinstance(d, date) else date.fromisoformat(str(d)) for d in (start, end))
    before = labels.REMOVED_BEFORE if start.month == 1 else labels.REMOVED_BEFORE_MONTH
    return (
        labels.REMOVED_INVALID,
        before.format(month=labels.MONTHS[start.month - 1], year=start.year),
        labels.REMOVED_AFTER.format(month=labels.MONTHS[end.month - 1], year=end.year),
    )


def removal_reason(start, end, month: str = "month") -> Column:
    value = F.col(month)
    invalid, before, after = reason_titles(start, end)
    return (
        F.when(value.isNull(), F.lit(invalid))
        .when(value < F.lit(start), F.lit(before))
        .when(value > F.lit(end), F.lit(after))
    )


def unstack(row: DataFrame, names: list[str], titles, key: str = "indicator", value: str = "value") -> DataFrame:
    """One row with several columns to one row per column, in the given order."""
    pairs = F.array(*[F.struct(F.lit(t).alias(key), F.col(n).alias(value)) for n, t in zip(names, titles)])
    return row.select(F.posexplode(pairs)).select((F.col("pos") + 1).alias("position"), f"col.{key}", f"col.{value}")


def removed_rows(raw: DataFrame, start, end) -> DataFrame:
    """Rows the cut removes, each with its reason."""
    return raw.withColumn("reason", removal_reason(start, end)).where(F.col("reason").isNotNull())


def removal_reasons(raw: DataFrame, start, end) -> DataFrame:
    """Count per reason in fixed order; reasons without rows stay with zero."""
    titles = reason_titles(start, end)
    reason = removal_reason(start, end)
    counts = raw.agg(*[F.count_if(reason == title).alias(f"c{i}") for i, title in enumerate(titles)])
    return unstack(counts, ["c0", "c1", "c2"], titles, "reason", "rows_n")


def before_after(raw: DataFrame, start, end, key: Column | str = "entity_id", name: str | None = None) -> DataFrame:
    """Rows before and after the cut per key; rows without a key are left out."""
    column = C.col(key)
    name = name or key
    counts = (
        raw.where(column.isNotNull())
        .groupBy(column.alias(name))
        .agg(F.count(F.lit(1)).alias("before_n"), F.count_if(kept(start, end)).alias("after_n"))
    )
    removed = F.col("before_n") - F.col("after_n")
    return counts.withColumns({"removed_n": removed, "removed_pct": C.percent(removed, "before_n")})


def before_after_by_year(raw: DataFrame, start, end) -> DataFrame:
    return before_after(raw, start, end, F.year("month"), "year").orderBy("year")


def before_after_by_entity(raw: DataFrame, start, end) -> DataFrame:
    return before_after(raw, start, end).orderBy(F.desc("removed_n"), "entity_id")


def before_after_joined(raw: DataFrame, clean: DataFrame, key: Column, name: str, how: str = "outer") -> DataFrame:
    """The same comparison when the cleaned table was made elsewhere (outer or left join)."""

    def counted(df: DataFrame, out: str) -> DataFrame:
        return df.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias(out))

    joined = counted(raw, "before_n").join(counted(clean, "after_n"), name, how).na.fill(0, ["before_n", "after_n"])
    removed = F.col("before_n") - F.col("after_n")
    return joined.withColumns({"removed_n": removed, "removed_pct": C.percent(removed, "before_n")})


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, in column order."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in df.columns])
    return unstack(counts, df.columns, df.columns, "column_name", "nulls_n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_n"), F.count(F.lit(1)).alias("keys_n")
    )


def validation_report(
    df: DataFrame, required: list[str], numeric: list[str], keys: list[str], group: str | None = None,
    min_rows: int = labels.MIN_PEER_ROWS,
) -> DataFrame:
    """One row per gate: rule, violations, passed.

    One aggregation by key and group serves the duplicate and null gates; the
    group sizes follow from it.
    """
    missing = [name for name in required if name not in df.columns]
    present = [name for name in required if name in df.columns]
    usable = [name for name in numeric if name in df.columns]
    nulls = sum((F.count_if(F.col(n).isNull()) for n in present), F.lit(0))
    infinite = sum((F.count_if(_infinite(n)) for n in usable), F.lit(0))
    by = [k for k in keys if k in df.columns] + ([group] if group else [])
    per_key = df.groupBy(*dict.fromkeys(by)).agg(
        F.count(F.lit(1)).alias("n"), nulls.alias("nulls"), infinite.alias("infinite")
    )
    if group:
        # A key may span groups: count keys first, then group sizes, from the same short table.
        sizes = per_key.groupBy(group).agg(F.sum("n").alias("size"))
        small = sizes.agg(F.count_if(F.col("size") < min_rows).alias("small"))
        per_key = per_key.groupBy(*[k for k in keys if k in df.columns]).agg(
            F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("infinite").alias("infinite")
        )
    totals = per_key.agg(
        F.lit(len(missing)).cast("bigint").alias("missing_columns"),
        (F.count(F.lit(1)) == 0).cast("bigint").alias("empty"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum("infinite"), F.lit(0)).alias("infinite"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )
    rules = ["missing_columns", "empty", "nulls", "infinite", "duplicate_keys"]
    if group:
        totals = totals.withColumn("small_groups", small.scalar())
        rules.append("small_groups")
    return unstack(totals, rules, rules, "rule", "violations").withColumn("passed", F.col("violations") == 0)


def validate(df: DataFrame, required, numeric, keys, group=None, min_rows: int = labels.MIN_PEER_ROWS) -> DataFrame:
    """The input itself when every gate passes, else an error naming the failed ones."""
    report = validation_report(df, list(required), list(numeric), list(keys), group, min_rows)
    _raise_failed((row.rule, row.violations) for row in report.collect())
    return df


class Gate:
    """The same gates around the write of a stage.

    Nulls, infinite values and rows are counted while the stage is written
    (`watch`); only the uniqueness of keys and the sizes of groups take an
    aggregation of their own, over the key columns of what was written (`verify`).
    """

    def __init__(self, required, numeric, keys, group: str | None = None, min_rows: int = labels.MIN_PEER_ROWS):
        self.required, self.numeric, self.keys = list(required), list(numeric), list(keys)
        self.group, self.min_rows = group, min_rows
        self.seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        """The table to write."""
        self.missing = [name for name in self.required if name not in df.columns]
        present = [name for name in self.required if name in df.columns]
        usable = [name for name in self.numeric if name in df.columns]
        nulls = sum((F.count_if(F.col(n).isNull()) for n in present), F.lit(0))
        infinite = sum((F.count_if(_infinite(n)) for n in usable), F.lit(0))
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"), infinite.alias("infinite"))

    def verify(self, written: DataFrame) -> DataFrame:
        """The table as written when every gate passes, else an error naming the failed ones."""
        counts = self.seen.get
        found = {
            "missing_columns": len(self.missing), "empty": int(not counts["rows"]), "nulls": counts["nulls"], "infinite": counts["infinite"]
        }
        keys = [k for k in self.keys if k in written.columns]
        distinct = written.groupBy(*keys).agg(F.lit(1).alias("one"))
        checks = distinct.agg((F.lit(counts["rows"]) - F.count("one")).alias("duplicate_keys"))
        if self.group:
            sizes = written.groupBy(self.group).agg(F.count(F.lit(1)).alias("size"))
            checks = checks.withColumn("small_groups", sizes.agg(F.count_if(F.col("size") < self.min_rows)).scalar())
        found |= checks.first().asDict()
        _raise_failed(found.items())
        return written


def _infinite(column: str) -> Column:
    return F.col(column).cast("double").isin(float("inf"), float("-inf"))


def _raise_failed(found) -> None:
    failed = [f"{rule} ({violations})" for rule, violations in found if violations]
    if failed:
        raise ValueError("validation failed: " + ", ".join(failed))


def quality_report(raw: DataFrame, start, end) -> DataFrame:
    """One row: rows in, kept and removed by reason, kept period, flag states kept."""
    inside = kept(start, end)
    reason = removal_reason(start, end)
    invalid, before, after = reason_titles(start, end)
    return raw.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(inside).alias("rows_kept"),
        F.count_if(~inside).alias("rows_removed"),
        F.count_if(reason == invalid).alias("invalid_n"),
        F.count_if(reason == before).alias("before_n"),
        F.count_if(reason == after).alias("after_n"),
        F.min(F.when(inside, F.col("month"))).alias("first_month"),
        F.max(F.when(inside, F.col("month"))).alias("last_month"),
        F.sum(F.when(inside, F.col("null_flag_n"))).alias("null_flag_n"),
        F.sum(F.when(inside, F.col("not_cancelled_n"))).alias("not_cancelled_n"),
        F.sum(F.when(inside, F.col("cancelled_n"))).alias("cancelled_n"),
    )


def flag_diagnostics(clean: DataFrame) -> DataFrame:
    """Flag states per year and the share of unknown flags."""
    names = ["total", "cancelled_n", "not_cancelled_n", "null_flag_n"]
    return (
        clean.groupBy(F.year("month").alias("year"))
        .agg(*[F.sum(name).alias(name) for name in names])
        .withColumn("null_flag_pct", C.percent("null_flag_n", "total"))
        .orderBy("year")
    )


def general_stats(raw: DataFrame, start, end) -> DataFrame:
    inside = kept(start, end)
    counts = raw.agg(F.count(F.lit(1)).alias("a"), F.count_if(inside).alias("b"), F.count_if(~inside).alias("c"))
    counts = counts.select(
        *[F.col(n).cast("double").alias(n) for n in "abc"], C.percent("c", "a").alias("d")
    )
    return unstack(counts, ["a", "b", "c", "d"], labels.GENERAL_ROWS)


def period_of(clean: DataFrame) -> DataFrame:
    ends = clean.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    return unstack(ends, ["lo", "hi"], labels.PERIOD_ROWS)


def removal_stats(by_entity: DataFrame) -> DataFrame:
    """How the cut falls on the entities still present.

    The shares carry two decimals, so the median sees at most 10 001 values.
    """
    present = F.col("after_n") > 0
    share = F.when(present, F.col("removed_pct"))
    row = by_entity.agg(
        F.count(F.lit(1)).cast("double").alias("raw"),
        F.count_if(present).cast("double").alias("clean"),
        F.count_if(~present).cast("double").alias("gone"),
        F.bround(F.avg(share), 2).alias("mean"),
        F.bround(F.median(share), 2).alias("median"),
        F.bround(F.stddev_samp(share), 2).alias("std"),
        F.min(share).alias("lo"),
        F.max(share).alias("hi"),
    )
    return unstack(row, row.columns, labels.REMOVAL_ROWS)


def excluded_entities(by_entity: DataFrame) -> DataFrame:
    return by_entity.where(F.col("after_n") == 0)


def excluded_entity_years(raw: DataFrame, start, end) -> DataFrame:
    """Years with rows of the entities the cut removes entirely.

    The window sees one row per year of an entity, however many rows it has.
    """
    per_year = (
        raw.where(F.col("entity_id").isNotNull())
        .groupBy("entity_id", F.year("month").alias("year"))
        .agg(F.count(F.lit(1)).alias("rows_n"), F.count_if(kept(start, end)).alias("kept_n"))
    )
    left = F.sum("kept_n").over(Window.partitionBy("entity_id"))
    return (
        per_year.withColumn("left_n", left)
        .where((F.col("left_n") == 0) & F.col("year").isNotNull())
        .select("entity_id", "year", "rows_n")
        .orderBy("entity_id", "year")
    )
