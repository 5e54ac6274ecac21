"""Peer groups: one-dimensional K-Means and fixed bands.

K-Means works on the counts of distinct values, a table far shorter than the
fact, sorted once and cut into blocks.  The sums of a group are differences of
running sums at its two borders, so an iteration looks into the blocks that
hold a border, whatever the number of values: the running sums up to each block
are a bounded index, the blocks themselves a written table.  All restarts, and
all group counts of a sweep, advance together and share the opened blocks; an
iteration that meets no new block needs no job.  Seeding is a pass over the
value counts per group; it draws by a hash of the value, so the result does not
depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import peerwatch
from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.operators.quantiles import quantile_values
from peerwatch.sources.staging import attach, stage

MAX_ITERATIONS = 300
TOLERANCE = 1e-4
#: Distinct values of a block, as long as no more than MOST_BLOCKS blocks result; opened blocks that are held.
BLOCK, MOST_BLOCKS, BLOCKS_HELD = 1024, 1 << 16, 1024


@dataclass
class PeerModel:
    """Ascending centres on the standardised scale, with the scale itself."""

    column: str
    mean: float
    std: float
    centres: list[float]
    inertia: float

    def cuts(self) -> list[float]:
        """Midpoints between neighbouring centres, on the standardised scale."""
        return [(a + b) / 2.0 for a, b in zip(self.centres, self.centres[1:])]

    def assign(self, df: DataFrame, out: str = "peer_group") -> DataFrame:
        scaled = (F.col(self.column) - F.lit(self.mean)) / F.lit(self.std)
        return df.withColumn(out, C.band(scaled, self.cuts()))


@dataclass
class SortedCounts:
    """Running sums of counts, values and squares over the sorted distinct values.

    `blocks` is a written table (id, xs, ws) of value ranges; `low` and `before`
    are each block's least value and the sums over all earlier blocks.
    """

    blocks: DataFrame
    ids: np.ndarray
    low: np.ndarray
    before: np.ndarray
    held: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def upto(self, edges) -> np.ndarray:
        """(edges, 3): count, sum and sum of squares of the values that are at most each edge."""
        edges = np.asarray(edges, float)
        at = np.searchsorted(self.low, edges, side="right") - 1
        out = np.zeros((len(edges), 3))
        inside = np.unique(at[at >= 0])
        self._open(self.ids[inside].tolist())
        for block in inside.tolist():
            xs, sums = self.held[int(self.ids[block])]
            which = at == block
            out[which] = self.before[block] + sums[np.searchsorted(xs, edges[which], side="right")]
        return out

    def _open(self, wanted: list[int]) -> None:
        missing = [i for i in wanted if i not in self.held]
        if not missing:
            return
        if len(self.held) + len(missing) > BLOCKS_HELD:
            self.held = {i: self.held[i] for i in wanted if i in self.held}
        for row in self.blocks.where(F.col("id").isin(missing)).collect():  # at most two blocks per group and run
            x, w = np.array(row["xs"]), np.array(row["ws"])
            self.held[row["id"]] = x, np.concatenate((np.zeros((1, 3)), np.cumsum(np.column_stack((w, w * x, w * x * x)), axis=0)))


@dataclass
class Histogram:
    """Distinct values, standardised, with counts (x, w), written once; and their running sums."""

    counts: DataFrame
    mean: float
    std: float
    distinct: int
    sums: SortedCounts


def _partials(
    frame: DataFrame, task: Callable[[np.ndarray, np.ndarray], list[tuple]], schema: str, merge: Callable[[tuple, tuple], tuple], keys: int,
) -> list:
    """Rows that `task` makes of each batch of (x, w), gathered; a Spark task merges those whose first `keys` fields agree."""
    names = [part.split()[0] for part in schema.split(", ")]
    cloudpickle.register_pickle_by_value(peerwatch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            x, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2))
            for row in task(x, w):
                key, values = row[:keys], row[keys:]
                held[key] = merge(held[key], values) if key in held else values
        if held:
            rows = [key + values for key, values in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return frame.select("x", F.col("w").cast("double")).mapInArrow(run, schema).collect()


def _pool(a: tuple, b: tuple) -> tuple:
    """Count, mean, squared deviations and distinct values of two parts together."""
    n = a[0] + b[0]
    if not n:
        return n, 0.0, 0.0, a[3] + b[3]
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, a[3] + b[3]


def histogram(df: DataFrame, column: str) -> Histogram:
    counts = stage(
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(
            F.count(F.lit(1)).alias("w")
        ),
        "histogram",
    )

    def moments(x: np.ndarray, w: np.ndarray) -> list[tuple]:
        n = w.sum()
        mean = (x * w).sum() / n if n else 0.0
        return [(float(n), float(mean), float((w * (x - mean) ** 2).sum()), len(x))]

    parts = _partials(counts, moments, "n double, mean double, squares double, distinct bigint", _pool, 0)
    n = sum(p["n"] for p in parts)
    if not n:
        raise ValueError(f"no values in {column}")
    mean = sum(p["n"] * p["mean"] for p in parts) / n
    squares = sum(p["squares"] + p["n"] * (p["mean"] - mean) ** 2 for p in parts)
    std = (squares / n) ** 0.5 or 1.0
    scaled = counts.select(((F.col("x") - mean) / std).alias("x"), "w")
    distinct = sum(p["distinct"] for p in parts)
    return Histogram(scaled, mean, std, distinct, sort_counts(scaled, distinct))


def sort_counts(counts: DataFrame, distinct: int) -> SortedCounts:
    """Sorted blocks of (x, w) and their index, at most MOST_BLOCKS entries and one more per partition."""
    size = max(BLOCK, -(-distinct // MOST_BLOCKS))
    cloudpickle.register_pickle_by_value(peerwatch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        x, w = np.empty(0), np.empty(0)

        def emit(x: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            sums = [float(v) for v in (w.sum(), (w * x).sum(), (w * x * x).sum())]
            lists = [pa.array([v], pa.list_(pa.float64())) for v in (x, w)]
            columns = [pa.array([(part << 32) + number]), pa.array([float(x[0])]), *[pa.array([v]) for v in sums], *lists]
            return pa.RecordBatch.from_arrays(columns, ["id", "low", "w", "wx", "wxx", "xs", "ws"])

        for batch in batches:
            x = np.concatenate((x, batch.column(0).to_numpy(zero_copy_only=False)))
            w = np.concatenate((w, batch.column(1).to_numpy(zero_copy_only=False)))
            while len(x) >= size:
                yield emit(x[:size], w[:size])
                x, w, number = x[size:], w[size:], number + 1
        if len(x):
            yield emit(x, w)

    shape = "id bigint, low double, w double, wx double, wxx double, xs array<double>, ws array<double>"
    ordered = counts.select("x", F.col("w").cast("double")).repartitionByRange("x").sortWithinPartitions("x")
    blocks = stage(ordered.mapInArrow(cut, shape), "blocks")
    index = blocks.select("id", "low", "w", "wx", "wxx").orderBy("low").toArrow()
    sums = np.column_stack([index[c].to_numpy() for c in ("w", "wx", "wxx")])
    return SortedCounts(blocks.select("id", "xs", "ws"), index["id"].to_numpy(), index["low"].to_numpy(), np.cumsum(sums, axis=0) - sums)


def _seed_centres(hist: DataFrame, ks: list[int], n_init: int, seed: int) -> dict[int, list[float]]:
    """k-means++ for all runs at once.

    A draw proportional to weight times squared distance is the value with the
    smallest exponential key -ln(u) / (w d^2), u being a hash of value and run.
    """
    size = {i: k for i, k in enumerate(k for k in ks for _ in range(n_init))}
    centres: dict[int, list[float]] = {r: [] for r in size}
    for step in range(max(ks)):
        open_runs = {r: list(centres[r]) for r in size if len(centres[r]) == step < size[r]}

        def draw(x: np.ndarray, w: np.ndarray, open_runs=open_runs, step=step) -> list[tuple]:
            rows = []
            spot = np.rint(x * 1e9).astype(np.int64)
            for run, held in open_runs.items():
                gap = np.min([(x - c) ** 2 for c in held], axis=0) if held else 1.0
                weight = w * gap
                there = weight > 0
                if there.any():
                    key = -np.log(C.uniform_array(C.fold32_array(spot[there], run, step, seed))) / weight[there]
                    at = int(key.argmin())
                    rows.append((run, float(key[at]), float(x[there][at])))
            return rows

        best: dict[int, tuple[float, float]] = {}
        for row in _partials(hist, draw, "run bigint, key double, x double", min, 1):
            best[row["run"]] = min(best.get(row["run"], (np.inf, 0.0)), (row["key"], row["x"]))
        for run, (_, x) in best.items():
            centres[run].append(x)
    return {r: sorted(c) for r, c in centres.items()}


def _between(sums: SortedCounts, edges: list[np.ndarray]) -> list[np.ndarray]:
    """Per list of ascending edges: count, sum and sum of squares of the values up to each edge, between edges, and beyond the last."""
    upto = sums.upto(np.concatenate([np.append(e, np.inf) for e in edges]))
    ends = np.cumsum([len(e) + 1 for e in edges])[:-1]
    return [np.diff(part, axis=0, prepend=0.0) for part in np.split(upto, ends)]


def _step(hist: Histogram, runs: dict[int, list[float]]) -> dict[int, tuple[list[float], float]]:
    """One Lloyd iteration of every run: new centres and the cost at the old ones."""
    held = {r: np.array(c) for r, c in runs.items()}
    out = {}
    for (run, c), group in zip(held.items(), _between(hist.sums, [(c[:-1] + c[1:]) / 2.0 for c in held.values()])):
        w, wx, wxx = group.T
        # A centre that lost all its values stays where it is.
        new = sorted(float(b / a) if a else float(old) for a, b, old in zip(w, wx, c))
        out[run] = new, float(np.maximum(wxx - 2.0 * c * wx + c * c * w, 0.0).sum())
    return out


def band_scatter(hist: Histogram, cuts: dict[int, list[float]]) -> list[tuple]:
    """(k, group, centre, n, summed absolute and squared distance to the centre) of bands of the standardised values."""
    out = []
    for (k, edges), group in zip(cuts.items(), _between(hist.sums, [np.array(e, float) for e in cuts.values()])):
        some = np.nonzero(group[:, 0])[0]
        centres = group[some, 1] / group[some, 0]
        below = hist.sums.upto(centres) - np.concatenate((np.zeros((1, 3)), hist.sums.upto(edges)))[some]
        for g, c, (n, x, xx), (n_low, x_low, _) in zip(some.tolist(), centres.tolist(), group[some].tolist(), below.tolist()):
            apart = (c * n_low - x_low) + ((x - x_low) - c * (n - n_low))
            out.append((k, g, c, int(n), apart, max(xx - 2.0 * c * x + c * c * n, 0.0)))
    return out


def fit_many(
    df: DataFrame, column: str, ks, n_init: int = labels.KMEANS_RESTARTS, seed: int = labels.SEED,
    max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE, hist: Histogram | None = None,
) -> dict[int, PeerModel]:
    """Best of n_init restarts for each group count in `ks`.

    Raises if there are fewer distinct values than groups, or if a restart has
    not settled after `max_iterations`.
    """
    ks = list(ks)
    hist = hist or histogram(df, column)
    if hist.distinct < max(ks):
        raise ValueError(f"{column} has {hist.distinct} distinct values, too few for {max(ks)} groups")
    centres = _seed_centres(hist.counts, ks, n_init, seed)
    active = set(centres)
    for _ in range(max_iterations):
        if not active:
            break
        for r, (new, _) in _step(hist, {r: centres[r] for r in sorted(active)}).items():
            shift = sum((a - b) ** 2 for a, b in zip(centres[r], new))
            centres[r] = new
            if shift <= tolerance:
                active.discard(r)
    if active:
        raise RuntimeError(f"{len(active)} of {len(centres)} restarts have not settled after {max_iterations} iterations")
    cost = {r: c for r, (_, c) in _step(hist, centres).items()}
    models = {}
    for i, k in enumerate(ks):
        runs = range(i * n_init, (i + 1) * n_init)
        # Twelve digits: restarts that end in the same groups tie whatever order their sums took.
        best = min(runs, key=lambda r: (float(f"{cost[r]:.12g}"), r))
        models[k] = PeerModel(column, hist.mean, hist.std, centres[best], cost[best])
    return models


def fit_peers(df: DataFrame, column: str = "log_total", k: int = labels.PEER_COUNT, **options) -> PeerModel:
    return fit_many(df, column, [k], **options)[k]


def fit_lloyd(df: DataFrame, column: str = "log_total", k: int = labels.PEER_COUNT, iterations: int = 5) -> PeerModel:
    """Deterministic variant: a fixed number of iterations from evenly spaced quantiles.

    Raises if ties leave fewer than k different starting points.
    """
    hist = histogram(df, column)
    starts = quantile_values(df, column, [(i + 0.5) / k for i in range(k)])
    centres = sorted({(s - hist.mean) / hist.std for s in starts})
    if len(centres) < k:
        raise ValueError(f"the quantiles of {column} give {len(centres)} starting points, too few for {k} groups")
    for _ in range(iterations):
        centres = _step(hist, {0: centres})[0][0]
    return PeerModel(column, hist.mean, hist.std, centres, _step(hist, {0: centres})[0][1])


def quantile_bands(df: DataFrame, column: str = "total", probs=(0.25, 0.5, 0.75), out: str = "peer_group") -> DataFrame:
    """Groups of roughly equal size cut at the quantiles of the volume."""
    return df.withColumn(out, C.band(column, quantile_values(df, column, probs)))


def relabel_by_mean(df: DataFrame, raw: str, column: str = "log_total", out: str = "peer_group") -> DataFrame:
    """Renumber groups 0, 1, ... by ascending mean of a column."""
    means = df.groupBy(raw).agg(F.avg(column).alias("m"))
    ranked = means.agg(F.array_sort(F.collect_list(F.struct("m", raw))).alias("g"))
    mapping = ranked.select(F.posexplode("g")).select(F.col(f"col.{raw}").alias(raw), F.col("pos").alias(out))
    return attach(df, mapping, [raw])
