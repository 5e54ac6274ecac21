"""Isolation forest on Spark (Liu, Ting and Zhou, 2008).

Fitting reads the fact for the scale and the rows per hash bucket, looks again
into drawn buckets that are large, and reads it once more for the training rows;
only rows of drawn buckets cross a shuffle.  Every tree draws its own psi rows
from all rows, by the same scheme at every size.  Trees grow in parallel, a task
taking the psi rows of each of its trees.  All random choices are hashes of row
key, tree and node, so a forest depends on the data and the seed only, not on
partitioning or retries.

Scoring has two forms with the same result: arrays of nodes walked by Arrow
batches, and leaves as boxes that rows are joined to inside the JVM.

Nodes are numbered as a heap: the root is 1, the children of i are 2i and 2i+1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import peerwatch
from peerwatch import labels
from peerwatch.functions import columns as C
from peerwatch.functions.columns import fold32_array, fold32_int, uniform
from peerwatch.functions.special import average_path
from peerwatch.operators.quantiles import quantile_values
from peerwatch.sources.staging import stage

PSI = 256
SCORE_DIGITS = 12
FEATURES = ("log_total", "rate")
#: Bits of the row hash, those that number a bucket at first, and those that each closer look adds.
HASH_BITS, BUCKET_BITS, CLOSER_BITS = 32, 16, 4
#: Buckets are looked into until the drawn ones hold at most so many rows per drawn place.
ROWS_PER_PLACE = 4
#: Cells into which one axis is cut for the join of rows to boxes.
CELLS = 64


@dataclass
class Forest:
    """Nodes as a DataFrame (tree, node, feature, threshold, n) with scale and size.

    It holds at most trees x 2^(height + 1) nodes, whatever the size of the data.
    """

    nodes: DataFrame | None
    table: pd.DataFrame | None
    columns: tuple[str, ...]
    scale: dict[str, tuple[float, float]]
    trees: int
    psi: int

    @property
    def height(self) -> int:
        return math.ceil(math.log2(self.psi)) if self.psi > 1 else 0

    @property
    def slots(self) -> int:
        """Places in the node array of a tree."""
        return 2 ** (self.height + 1)


def _row_keys() -> list[Column]:
    return [F.col("entity_id"), C.month_index("month")]


def ship() -> None:
    """Let task functions travel with their code, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(peerwatch)


def draw_places(tree: int, psi: int, total: int, seed: int) -> list[int]:
    """psi distinct places among `total` rows (Floyd's sampling; the choices are hashes)."""
    return _floyd([fold32_int(tree, i, seed, 3) for i in range(psi)], total)


def draw_all(trees: int, psi: int, total: int, seed: int) -> np.ndarray:
    """The places of every tree, a row each."""
    hashes = np.array([fold32_array(np.arange(trees), i, seed, 3) for i in range(psi)]).T
    return np.array([_floyd(row, total) for row in hashes.tolist()])


def _floyd(choices: list[int], total: int) -> list[int]:
    places: set[int] = set()
    for last, choice in enumerate(choices, total - len(choices)):
        place = choice % (last + 1)
        places.add(last if place in places else place)
    return sorted(places)


def _hashed(df: DataFrame, columns, seed: int) -> DataFrame:
    """Rows with their hash, NULL without a key."""
    return df.select("entity_id", "month", *columns).withColumn("_hash", C.fold32(*_row_keys(), F.lit(seed)))


def _bucket(bits: int) -> Column:
    """The first bits of the hash."""
    return F.shiftright("_hash", HASH_BITS - bits)


def _census(hashed: DataFrame, columns) -> tuple[list[tuple[int, int]], dict[str, tuple[float, float]]]:
    """Rows per bucket, at most 2 ** BUCKET_BITS, and mean and population deviation of each column."""
    rows = hashed.groupBy(_bucket(BUCKET_BITS).alias("_bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("count", F.count), ("mean", F.avg), ("spread", F.var_pop))],
    ).toArrow()
    scale = {}
    for c in columns:
        k = rows[f"{c}_count"].to_numpy()
        has = k > 0
        k, m, s = k[has], rows[f"{c}_mean"].to_numpy()[has].astype(float), rows[f"{c}_spread"].to_numpy()[has].astype(float)
        n = int(k.sum())
        mean = float((k * m).sum()) / n if n else 0.0
        spread = float((k * (s + (m - mean) * (m - mean))).sum()) / n if n else 0.0
        scale[c] = mean, math.sqrt(spread) or 1.0
    return sorted((b, n) for b, n in zip(rows["_bucket"].to_pylist(), rows["n"].to_pylist()) if b is not None), scale


@dataclass
class _Drawn:
    """Distinct drawn places in hash order: the bucket each lies in, its place there, and the bucket's rows."""

    bits: int
    bucket: np.ndarray
    place: np.ndarray
    rows: np.ndarray

    def rows_to_rank(self) -> int:
        return int(self.rows[np.unique(self.bucket, return_index=True)[1]].sum())

    def only(self, hashed: DataFrame) -> DataFrame:
        """The rows of the drawn buckets; their numbers, no more than there are places, go to the scan."""
        wanted = hashed.sparkSession.createDataFrame(pd.DataFrame({"_wanted": np.unique(self.bucket)}), "_wanted bigint")
        return hashed.join(F.broadcast(wanted), _bucket(self.bits) == F.col("_wanted"), "left_semi")

    def closer(self, hashed: DataFrame) -> _Drawn:
        """The same places by more bits: rows are counted in the parts of the drawn buckets alone."""
        bits = min(HASH_BITS, self.bits + CLOSER_BITS)
        parts = self.only(hashed).groupBy(_bucket(bits).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").toArrow()
        part, n = parts["part"].to_numpy(), parts["n"].to_numpy()
        ends = np.cumsum(n)
        first = np.searchsorted(part, self.bucket << (bits - self.bits))  # the first part of each place's bucket
        at = np.searchsorted(ends, (ends - n)[first] + self.place, side="right")
        return _Drawn(bits, part[at], (ends - n)[first] + self.place - (ends - n)[at], n[at])


def training_rows(
    df: DataFrame, columns, trees: int, psi: int, seed: int, counts: list[tuple[int, int]] | None = None
) -> tuple[DataFrame, int]:
    """Training rows (tree, columns...), without replacement inside a tree; and psi, at most the rows there are.

    Rows have a place in the order of their hash.  Counts per hash bucket say
    which bucket holds a drawn place; large drawn buckets are counted by further
    bits of the hash.  Only the rows of the last, small buckets are shuffled and
    ranked, about `ROWS_PER_PLACE` for each of the trees x psi places at most.
    Rows without a key have no place.
    """
    hashed = _hashed(df, columns, seed)
    counts = _census(hashed, ())[0] if counts is None else counts
    n = np.array([n for _, n in counts], dtype=np.int64)
    ends = np.cumsum(n)
    if not len(ends):
        raise ValueError("no rows to fit on")
    total = int(ends[-1])
    psi = min(psi, total)
    places = draw_all(trees, psi, total, seed)
    distinct, back = np.unique(places, return_inverse=True)
    at = np.searchsorted(ends, distinct, side="right")
    drawn = _Drawn(BUCKET_BITS, np.array([b for b, _ in counts], dtype=np.int64)[at], distinct - (ends - n)[at], n[at])
    while drawn.bits < HASH_BITS and drawn.rows_to_rank() > ROWS_PER_PLACE * len(distinct):
        drawn = drawn.closer(hashed)
    chosen = df.sparkSession.createDataFrame(  # trees x psi rows
        pd.DataFrame({
            "tree": np.repeat(np.arange(trees, dtype=np.int32), psi),
            "_bucket": drawn.bucket[back.ravel()],
            "_place": drawn.place[back.ravel()],
        }),
        "tree int, _bucket bigint, _place bigint",
    )
    order = Window.partitionBy("_bucket").orderBy("_hash", "entity_id", "month")
    ranked = drawn.only(hashed).withColumn("_bucket", _bucket(drawn.bits)).withColumn("_place", (F.row_number().over(order) - 1).cast("bigint"))
    return ranked.join(F.broadcast(chosen), ["_bucket", "_place"]).select("tree", *columns), psi


NODE_SCHEMA = "tree int, node int, feature int, threshold double, n int"


def _grow_tree(points: np.ndarray, tree: int, height: int, seed: int) -> Iterator[tuple]:
    """Nodes of one isolation tree over its training points."""
    waiting = [(1, 0, points)]
    while waiting:
        node, level, here = waiting.pop()
        lo, hi = here.min(axis=0), here.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if level == height or not len(usable):
            yield tree, node, -1, None, len(here)
            continue
        feature = int(usable[fold32_int(tree, node, seed, 1) % len(usable)])
        u = uniform(fold32_int(tree, node, seed, 2))
        threshold = lo[feature] + u * (hi[feature] - lo[feature])
        right = here[:, feature] > threshold
        yield tree, node, feature, float(threshold), len(here)
        waiting.append((2 * node, level + 1, here[~right]))
        waiting.append((2 * node + 1, level + 1, here[right]))


def grow(rows: DataFrame, columns, height: int, seed: int) -> DataFrame:
    """Nodes of all trees from rows (tree, columns...); a group is the psi rows of one tree."""

    def one_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = _grow_tree(pdf[list(columns)].to_numpy(), int(pdf["tree"].iloc[0]), height, seed)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "n"])

    ship()
    # An explicit count keeps the trees spread out although the sample is small.
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, "tree").groupBy("tree").applyInPandas(one_tree, NODE_SCHEMA)


def fit(
    df: DataFrame, columns=FEATURES, trees: int = labels.TREES, psi: int = PSI, seed: int = labels.SEED
) -> Forest:
    """Forest on standardised columns; rows need `entity_id` and `month` as their key."""
    columns = tuple(columns)
    counts, scale = _census(_hashed(df, columns, seed), columns)
    sample, psi = training_rows(df, columns, trees, psi, seed, counts)
    forest = Forest(None, None, columns, scale, trees, psi)
    scaled = sample.select(
        "tree", *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in scale.items()]
    )
    # At most trees x slots nodes, gathered once for the frame and the arrays.
    held = grow(scaled, columns, forest.height, seed).toArrow()
    forest.nodes, forest.table = df.sparkSession.createDataFrame(held, NODE_SCHEMA), held.to_pandas()
    return forest


def given_forest(spark, nodes, columns, trees: int, psi: int, scale: dict[str, tuple[float, float]] | None = None) -> Forest:
    """A forest from its nodes (tree, node, feature or -1, threshold, n), on columns as they are unless a scale is given."""
    table = pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "n"])
    frame = spark.createDataFrame([tuple(r) for r in nodes], NODE_SCHEMA)
    return Forest(frame, table, tuple(columns), scale or {c: (0.0, 1.0) for c in columns}, trees, psi)


def _arrays(forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, threshold and leaf depth per tree and node."""
    nodes = forest.table
    shape = forest.trees, forest.slots
    feature = np.full(shape, -1, dtype=np.int32)
    threshold, depth = np.zeros(shape), np.zeros(shape)
    split = nodes[nodes["feature"] >= 0]
    feature[split["tree"], split["node"]] = split["feature"]
    threshold[split["tree"], split["node"]] = split["threshold"]
    leaf = nodes[nodes["feature"] < 0]
    added = leaf["n"].map({n: average_path(n) for n in leaf["n"].unique()})
    depth[leaf["tree"], leaf["node"]] = np.floor(np.log2(leaf["node"])) + added
    trained = leaf.groupby("tree")["n"].sum()
    if len(trained) != forest.trees or not (trained == forest.psi).all():
        raise ValueError("a tree did not receive its full training sample")
    return feature, threshold, depth


def score(df: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """Negative anomaly score, lower is more unusual, in (-1, 0).

    Vectorised over Arrow batches; rows with equal values are scored once per
    batch.  Scores carry 12 decimals, so equal paths compare equal.
    """
    ship()
    shared = df.sparkSession.sparkContext.broadcast(_arrays(forest))
    height, trees, slots = forest.height, forest.trees, forest.slots
    norm = average_path(forest.psi) or 1.0
    offsets = (np.arange(trees) * slots)[:, None]

    def paths(points: np.ndarray) -> np.ndarray:
        feature, threshold, depth = (a.ravel() for a in shared.value)
        node = np.ones((trees, len(points)), dtype=np.int64)
        row = np.arange(len(points))[None, :]
        for _ in range(height):
            at = node + offsets
            split = feature[at]
            right = points[row, np.maximum(split, 0)] > threshold[at]
            node = np.where(split >= 0, 2 * node + right, node)
        return depth[node + offsets].sum(axis=0)

    @F.pandas_udf("double")
    def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            points, back = np.unique(np.column_stack(series), axis=0, return_inverse=True)
            totals = np.concatenate([
                paths(points[i:i + 2000]) for i in range(0, len(points), 2000)
            ]) if len(points) else np.empty(0)
            values = -np.power(2.0, -(totals / trees) / norm)
            yield pd.Series(np.round(values, SCORE_DIGITS)[back.ravel()])

    scaled = [(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in forest.scale.items()]
    return df.withColumn(out, isolation(*scaled))


def leaf_boxes(forest: Forest) -> pd.DataFrame:
    """Leaves as boxes (tree, depth, low_0, high_0, low_1, ...): a row is inside where low < value <= high on every axis.

    `depth` is the path length a leaf stands for.  The boxes of a tree cover
    the space once, so a row lies in one box per tree.
    """
    nodes = forest.table.sort_values("node")
    axes = len(forest.columns)
    bounds: dict[tuple[int, int], list[float]] = {}
    rows = []
    for tree, node, feature, threshold, n in nodes[["tree", "node", "feature", "threshold", "n"]].itertuples(index=False):
        box = bounds.pop((tree, node), None) or [-math.inf, math.inf] * axes
        if feature < 0:
            rows.append((tree, math.floor(math.log2(node)) + average_path(n), *box))
            continue
        left, right = list(box), list(box)
        left[2 * feature + 1] = right[2 * feature] = threshold
        bounds[tree, 2 * node], bounds[tree, 2 * node + 1] = left, right
    names = [f"{side}_{axis}" for axis in range(axes) for side in ("low", "high")]
    return pd.DataFrame(rows, columns=["tree", "depth", *names])


def _cuts(boxes: pd.DataFrame, axes: int, cells: int) -> tuple[int, list[float]]:
    """The axis on which boxes are narrowest in cells, and the ends of its cells: quantiles of the boxes' edges."""
    best = None
    for axis in range(axes):
        edges = boxes[f"high_{axis}"].to_numpy()
        edges = np.unique(edges[np.isfinite(edges)])
        if not len(edges):
            continue
        cuts = np.unique(np.quantile(edges, np.linspace(0, 1, cells + 1)[1:-1], method="nearest"))
        wide = (np.searchsorted(cuts, boxes[f"high_{axis}"]) - np.searchsorted(cuts, boxes[f"low_{axis}"])).sum() / (len(cuts) + 1)
        if best is None or wide < best[0]:
            best = wide, axis, cuts.tolist()
    return (0, []) if best is None else best[1:]


def score_by_boxes(df: DataFrame, forest: Forest, out: str = "score", cells: int = CELLS) -> DataFrame:
    """The same scores as `score`, by a range join of rows to the boxes of the leaves; no Python touches a row.

    One axis is cut into cells.  A box is listed under every cell it reaches, at
    most `cells` times trees x leaves rows, and a row looks only at the boxes of
    its cell.  Rows with equal values are joined once, and counted over trees in the shuffle.
    """
    spark = df.sparkSession
    boxes = leaf_boxes(forest)
    axes = len(forest.columns)
    axis, cuts = _cuts(boxes, axes, cells)
    held = spark.createDataFrame(boxes).withColumn(
        "_cell", F.explode(F.sequence(_cell(F.col(f"low_{axis}"), cuts), _cell(F.col(f"high_{axis}"), cuts)))
    )
    lowest = F.lit(float("-inf"))  # a missing value goes left everywhere
    names = [f"_at_{i}" for i in range(axes)]
    scaled = {
        name: F.coalesce(F.nanvl((F.col(c).cast("double") - F.lit(m)) / F.lit(s), lowest), lowest)
        for name, (c, (m, s)) in zip(names, forest.scale.items())
    }
    rows = df.withColumns(scaled)
    points = rows.select(*names).distinct().withColumn("_cell", _cell(F.col(names[axis]), cuts))
    inside = [
        ((F.col(name) > F.col(f"low_{i}")) | (F.col(f"low_{i}") == lowest)) & (F.col(name) <= F.col(f"high_{i}"))
        for i, name in enumerate(names)
    ]
    found = points.join(held, "_cell").where(reduce(and_, inside))
    norm = average_path(forest.psi) or 1.0
    value = -F.pow(F.lit(2.0), -(F.sum("depth") / F.lit(forest.trees)) / F.lit(norm))
    totals = found.groupBy(*names).agg(F.bround(value, SCORE_DIGITS).alias(out))
    return rows.drop(out).join(totals, names).drop(*names)


def _cell(value: Column, cuts: list[float]) -> Column:
    """Number of the cell: how many cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < value))


def offset(scored: DataFrame, contamination: float = labels.CONTAMINATION, column: str = "score") -> float:
    return quantile_values(scored, column, [contamination])[0]


def apply_threshold(
    scored: DataFrame, contamination: float = labels.CONTAMINATION, column: str = "score"
) -> DataFrame:
    """Decision, label (-1 or 1), intensity and flag at the contamination quantile of the scores."""
    decision = F.col(column) - F.lit(offset(scored, contamination, column))
    return scored.withColumn("if_decision", decision).withColumns({
        "if_label": F.when(F.col("if_decision") < 0, F.lit(-1)).otherwise(F.lit(1)),
        "if_intensity": -F.col("if_decision"),
        "flag_forest": F.col("if_decision") < 0,
    })


def detect(
    df: DataFrame, columns=FEATURES, trees: int = labels.TREES, contamination: float = labels.CONTAMINATION,
    seed: int = labels.SEED,
) -> DataFrame:
    """Fit, score and flag; scores are written once because the threshold reads them again."""
    scored = stage(score(df, fit(df, columns, trees, seed=seed)), "scored")
    return apply_threshold(scored, contamination)
