"""Exact interpolated quantiles of any number of groups of any size.

Rows are counted in cells of the value range, with the least and greatest value
of each cell; the cells that hold a wanted rank are looked into again until
each holds a single value.  Every pass is one aggregation that combines rows
before the shuffle, whatever the size of a group, and no group is sorted or
gathered: what is sorted within a group are its cells.  The first pass uses
cells of equal ratio, later ones equal width between the values really there,
so one to three passes are usual.

Cells stay a table throughout, written once per pass, and rows find the open
ones by a join.  Only the number of open cells reaches the driver, so four peer
groups and a hundred thousand entities take the same path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from peerwatch.sources.staging import stage

#: Cells per doubling of the value in the first pass; cells of an opened one afterwards.
PER_OCTAVE = 1024
CELLS = 4096

_RATIO = f"""CASE WHEN v IS NULL OR isnan(v) THEN NULL WHEN v = 0 THEN 0 ELSE CAST(signum(v) AS BIGINT)
    * (1000000 + floor(least(log2(abs(v)), 2000D) * {PER_OCTAVE})) END AS cell"""
# Halves, so that the width of a range of very large numbers is finite.
_WIDTH = f"least(floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * {CELLS}), {CELLS - 1}) AS cell"


#: SQL for the array of ranks (counted from 0) to look up among `numbers_n` numbers.
Ranks = str


def _long(df: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows (g0, g1, ..., variable, v)."""
    pairs = ", ".join(f"struct({i} AS variable, CAST(`{name}` AS double) AS v)" for i, name in enumerate(values))
    keys = [f"`{name}` AS g{i}" for i, name in enumerate(by)]
    return df.selectExpr(*keys, f"inline(array({pairs}))")


def _counted(rows: DataFrame, keys: Sequence[str], cell: str, *more: Column) -> DataFrame:
    """Per key the cells: rows with lo, hi, n and what `more` adds; NULL bounds for what is no number."""
    return rows.selectExpr("*", cell).groupBy(*keys, "cell").agg(
        F.expr("count(1) AS n"), F.expr("min(v) FILTER (WHERE NOT isnan(v)) AS lo"), F.expr("max(v) FILTER (WHERE NOT isnan(v)) AS hi"), *more
    )


def _over(within: Sequence[str], upto: str = "UNBOUNDED FOLLOWING") -> str:
    """A window over the cells of what `within` names, a bounded number whatever the rows; all share one sort."""
    return f"OVER (PARTITION BY {', '.join(within)} ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"


_NUMBERS = "CASE WHEN lo IS NOT NULL THEN n ELSE 0 END"
#: Wanted ranks inside a cell.
_HITS = f"CASE WHEN lo IS NOT NULL THEN filter(wanted, r -> r >= upto - {_NUMBERS} AND r < upto) ELSE slice(wanted, 1, 0) END AS hits"


_SETTLED = "flatten(collect_list(CASE WHEN lo = hi THEN transform(hits, r -> struct(r, lo)) END)) AS settled"
_STILL = "collect_list(CASE WHEN size(hits) > 0 AND lo < hi THEN struct(lo, hi, below, hits) END) AS open"


def _stage_pass(groups: DataFrame) -> tuple[DataFrame, int]:
    """The groups with their settled ranks and open cells, written, and how many cells are open; the count rides on the write."""
    seen = Observation()
    held = stage(groups.observe(seen, F.expr("coalesce(sum(size(open)), 0) AS open")), "cells")
    return held, seen.get["open"]


def summarise(df: DataFrame, values: Sequence[str], by: Sequence[str], ranks: Ranks, moments: bool = False) -> DataFrame:
    """(g0, g1, ..., variable, rows, n, mean, squares, at) per group and column.

    Rows, numbers among them, the values at the wanted ranks as a map and, with
    `moments`, mean and sum of squared deviations.  NULL groups stand for themselves.
    """
    long = _long(df, values, by)
    keys = [f"g{i}" for i in range(len(by))] + ["variable"]
    whole = _over(keys)
    cells = _counted(long, keys, _RATIO, *([F.expr("avg(v) AS m"), F.expr("var_pop(v) AS s")] if moments else []))
    counts = [f"sum(n) {whole} AS rows_n", f"sum({_NUMBERS}) {whole} AS numbers_n", f"sum({_NUMBERS}) {_over(keys, 'CURRENT ROW')} AS upto"]
    placed = cells.selectExpr("*", *counts)
    facts = {"rows_n": "rows", "numbers_n": "n"}
    if moments:
        facts |= {"mean": "mean", "squares": "squares"}
        placed = placed.selectExpr("*", f"sum({_NUMBERS} * m) {whole} / nullif(numbers_n, 0) AS mean")
        placed = placed.selectExpr("*", f"sum({_NUMBERS} * (s + (m - mean) * (m - mean))) {whole} AS squares")
    found = placed.selectExpr("*", f"{ranks} AS wanted").selectExpr(*keys, *facts, "lo", "hi", f"upto - {_NUMBERS} AS below", _HITS)
    # The cells of a group lie together already, so this adds no shuffle.
    now, still = _stage_pass(found.groupBy(*keys).agg(*[F.expr(f"max({f}) AS {name}") for f, name in facts.items()], F.expr(_SETTLED), F.expr(_STILL)))
    names = list(facts.values())
    passes = [now.select(*keys, *names, "settled")]
    while still:
        spans = now.selectExpr(*[f"{k} AS k_{k}" for k in keys], "inline(open)").selectExpr(
            *[f"k_{k}" for k in keys], "lo AS low", "hi AS high", "below AS under", "hits AS sought"
        )
        same = " AND ".join(f"{k} <=> k_{k}" for k in keys)
        # No hint: the open cells are few and their written size decides. A row lies in one of them at most.
        inside = long.join(spans, F.expr(f"{same} AND v BETWEEN low AND high")).selectExpr(*keys, "v", "under", "low AS lo", "high AS hi", "sought")
        finer = _counted(inside, [*keys, "under"], _WIDTH, F.expr("any_value(sought) AS wanted"))
        found = finer.selectExpr("*", f"under + sum({_NUMBERS}) {_over([*keys, 'under'], 'CURRENT ROW')} AS upto").selectExpr(
            *keys, "lo", "hi", f"upto - {_NUMBERS} AS below", _HITS
        )
        now, still = _stage_pass(found.groupBy(*keys).agg(F.expr(_SETTLED), F.expr(_STILL)))
        passes.append(now.select(*keys, "settled"))
    if len(passes) == 1:
        return passes[0].selectExpr(*keys, *names, "map_from_entries(settled) AS at")
    each = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), passes)
    return each.groupBy(*keys).agg(*[F.expr(f"max({f}) AS {f}") for f in names], F.expr("map_from_entries(flatten(collect_list(settled))) AS at"))


def around(probs: Sequence[float]) -> Ranks:
    """Ranks that interpolate the probabilities."""
    places = [f"CAST({f}((numbers_n - 1) * {float(p)!r}D) AS BIGINT)" for p in probs for f in ("floor", "ceil")]
    return f"array_distinct(array({', '.join(places)}))"


def at_share(p: float) -> str:
    """SQL for the interpolated quantile of a group of `summarise`; NULL without numbers."""
    place = f"((n - 1) * {float(p)!r}D)"
    lo, hi = (f"try_element_at(at, CAST({f}({place}) AS BIGINT))" for f in ("floor", "ceil"))
    return f"CASE WHEN {lo} = {hi} THEN {lo} ELSE {lo} + ({hi} - {lo}) * ({place} - floor({place})) END"


def deviation() -> str:
    """SQL for the sample deviation of a group of `summarise`; NULL below two numbers."""
    return "CASE WHEN n > 1 THEN sqrt(squares / (n - 1)) END"


def named(values: Sequence[str]) -> Column:
    """Name of the column that a row of `summarise` is about."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("variable") + 1)


def keyed(by: Sequence[str]) -> list[Column]:
    """The group columns of `summarise` under their own names."""
    return [F.col(f"g{i}").alias(name) for i, name in enumerate(by)]


def group_quantiles(df: DataFrame, values: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., variable, n, q): the linear-interpolation quantiles of each column.

    `q` is an array in the order of `probs`; NULL and NaN do not count.
    """
    found = summarise(df, values, by, around(probs)).where("n > 0")
    shares = F.expr(f"array({', '.join(map(at_share, probs))}) AS q")
    return found.select(*keyed(by), named(values).alias("variable"), "n", shares)


def quantile_columns(df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with named quantiles: {"rate_median": ("rate", 0.5), ...}; groups without any number are left out."""
    values = sorted({name for name, _ in wanted.values()})
    found = summarise(df, values, by, around(sorted({p for _, p in wanted.values()}))).where("n > 0")
    wide = found.groupBy(*[f"g{i}" for i in range(len(by))]).agg(F.expr("count(1) AS held"), *[
        F.expr(f"max({at_share(p)}) FILTER (WHERE variable = {values.index(name)}) AS `{out}`") for out, (name, p) in wanted.items()
    ])
    return wide.where("held > 0").select(*keyed(by), *wanted)


def quantile_values(df: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Quantiles of one whole column as plain numbers (NaN for an empty column)."""
    row = group_quantiles(df, [column], probs).first()
    return list(row["q"]) if row else [math.nan] * len(probs)


def nth_smallest(df: DataFrame, column: str, n: int) -> float | None:
    """The n-th smallest value of a column, counted from 1; the greatest where there are fewer."""
    found = summarise(df, [column], (), f"array(least({int(n)}L, numbers_n) - 1)")
    row = found.select(F.map_values("at").alias("v")).first()
    return row["v"][0] if row and row["v"] else None
