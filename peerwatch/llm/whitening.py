"""Embedding whitening by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers, so counts and sums are exact. The scatter of the
centred vectors is added up by tasks, one d x d matrix each, and their rows are
merged by the shuffle, salted first; the driver sees d x d numbers whatever the
number of vectors. There the scatter A is factored as G G' by Cholesky with
pivoting, which also finds the rank. Rotations of pairs of columns of G, from
the right, make the columns orthogonal and leave G G' alone: their squared
norms are the eigenvalues of A, the normalised columns its eigenvectors.
Neither A nor G'G is diagonalised, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerwatch.llm.common import ship, table
from peerwatch.sources.staging import stage

#: Entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers beyond this size count as it.
LARGEST = 1 << 61
COMPONENTS = 32
#: Groups into which the tasks' partial sums are dealt before they are merged.
SALTS = 16
#: A pivot below this share of the first one counts as zero.
RANK_TOLERANCE = 1e-13
#: Columns count as orthogonal when their cosine is at most this.
COSINE = 1e-15
SWEEPS = 60
#: Rows that are worked on together.
TILE = 8192

_LOW = (1 << 31) - 1


def sound(column: str) -> Column:
    """The vector is present and all its entries are present and finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """The vectors' entries as whole numbers."""
    held = np.floor(SCALE * np.minimum(np.abs(vectors), LARGEST / SCALE) * np.sign(vectors))
    return np.clip(held, -float(LARGEST), float(LARGEST)).astype(np.int64) + OFFSET


def tiles(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a batch, vectors of one length together, at most TILE of them."""
    lists = batch.column(at)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        which = np.nonzero(sizes == dim)[0]
        for a in range(0, len(which), TILE):
            rows = which[a : a + TILE]
            yield dim, rows, flat[starts[rows][:, None] + np.arange(dim)[None, :]]


@dataclass
class Centre:
    """Count and exact sums of the vectors of one length: every sum is n * floor + rest with 0 <= rest < n."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.floor = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part of the mean is taken off before anything is rounded."""
        return (x - self.floor) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sums over the entries of (n * x - S) ** 2, as long where all fit, else as Python numbers."""
        d = x - self.floor
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * d - self.rest) ** 2).sum(axis=1)
        return ((self.n * d.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)


def centres(rows: DataFrame) -> dict[int, Centre]:
    """Centre by length of the vectors (id, v). One job; d rows per length reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, rows_, v in tiles(batch, 1):
                x = whole(v)
                now = held.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
                now[0] += len(x)
                now[1] += (x >> 31).sum(axis=0)
                now[2] += (x & _LOW).sum(axis=0)
        for dim, (n, high, low) in held.items():
            columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "i", "n", "high", "low"])

    ship()
    parts = rows.mapInArrow(run, "dim int, i int, n bigint, high bigint, low bigint")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect():
        found.setdefault(r["dim"], {})[r["i"]] = r["n"], (int(r["high"]) << 31) + int(r["low"])
    return {dim: Centre(of[0][0], [of[i][1] for i in range(dim)]) for dim, of in found.items()}


def _merged(parts: DataFrame) -> DataFrame:
    """(dim, i, row): rows of matrices added up, salt by salt and then together, each in a fixed order."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("part")
        total = np.sum(np.stack(ordered["row"].to_numpy()), axis=0)
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "i": [rows["i"].iloc[0]], "part": [ordered["part"].iloc[0] % SALTS], "row": [total]})

    shape = "dim int, i int, part int, row array<double>"
    salted = parts.groupBy("dim", "i", F.pmod(F.col("part"), F.lit(SALTS)).alias("salt")).applyInPandas(add, shape)
    return salted.groupBy("dim", "i").applyInPandas(add, shape)


def scatter(rows: DataFrame, centred, at: int = 1) -> dict[int, np.ndarray]:
    """Sum over all vectors of one length of the outer product of `centred(dim, vector)` with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, v in tiles(batch, at):
                if dim:
                    c = centred(dim, v)
                    held[dim] = held.get(dim, 0.0) + c.T @ c
        part = TaskContext.get().partitionId()
        for dim, total in held.items():
            columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([part] * dim, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "part", "row"])

    ship()
    found: dict[int, dict[int, list]] = {}
    for r in _merged(rows.mapInArrow(run, "dim int, i int, part int, row array<double>")).collect():
        found.setdefault(r["dim"], {})[r["i"]] = r["row"]
    return {dim: np.array([of[i] for i in range(dim)]) for dim, of in found.items()}


def pivoted_cholesky(a: np.ndarray, tolerance: float = RANK_TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L', L lower trapezoidal with as many columns as `a` has rank.

    Each step takes the largest remaining diagonal entry as its pivot.
    """
    d = len(a)
    order = np.arange(d)
    left = a.astype(float).copy()
    lower = np.zeros((d, d))
    first = 0.0
    for k in range(d):
        at = k + int(np.argmax(np.diag(left)[k:]))
        pivot = left[at, at]
        first = first or pivot
        if not pivot > tolerance * first:
            return lower[:, :k], order
        if at != k:
            order[[k, at]] = order[[at, k]]
            left[[k, at]] = left[[at, k]]
            left[:, [k, at]] = left[:, [at, k]]
            lower[[k, at], :k] = lower[[at, k], :k]
        root = np.sqrt(pivot)
        lower[k, k] = root
        lower[k + 1 :, k] = left[k + 1 :, k] / root
        left[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], lower[k + 1 :, k])
    return lower, order


def _rounds(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of m columns, dealt into rounds of disjoint pairs."""
    seats = np.arange(m + m % 2)
    for _ in range(len(seats) - 1):
        one, two = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
        real = (one < m) & (two < m)
        yield one[real], two[real]
        seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))


def one_sided_jacobi(g: np.ndarray, cosine: float = COSINE, sweeps: int = SWEEPS) -> np.ndarray:
    """The columns of g rotated in pairs until all are orthogonal; g g' stays as it is.

    A round rotates disjoint pairs together, each by the smaller of the two
    angles that make it orthogonal. Raises if `sweeps` do not suffice.
    """
    rows = np.ascontiguousarray(g.T)  # a column in one piece of memory
    floor = cosine * max(1, g.shape[0])
    for _ in range(sweeps):
        worst = 0.0
        for i, j in _rounds(len(rows)):
            a, b = rows[i], rows[j]
            aa, bb, ab = (np.einsum("ij,ij->i", x, y) for x, y in ((a, a), (b, b), (a, b)))
            size = np.sqrt(aa * bb)
            apart = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, float(apart.max(initial=0.0)))
            turn = apart > floor
            zeta = np.divide(bb - aa, 2 * ab, out=np.zeros_like(ab), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            c = (1 / np.sqrt(1 + t * t))[:, None]
            s = c * t[:, None]
            rows[i], rows[j] = c * a - s * b, s * a + c * b
        if worst <= floor:
            return rows.T
    raise RuntimeError(f"columns are not orthogonal after {sweeps} sweeps")


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, columns) of a symmetric matrix without negative eigenvalues, falling, as many as its rank."""
    lower, order = pivoted_cholesky(a)
    g = np.empty_like(lower)
    g[order] = lower
    turned = one_sided_jacobi(g)
    norms = np.sqrt((turned * turned).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    return norms[falling] ** 2, turned[:, falling] / norms[falling]


@dataclass
class Whitening:
    """Centre, total variance, eigenvalues and components of the vectors of one length."""

    centre: Centre
    trace: float
    values: np.ndarray
    columns: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.columns / np.sqrt(self.values)


def fit(rows: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening by length of the vectors, from all sound rows. Components of no variance are left out.

    A pass counts and adds up, another adds up the scatter of the centred vectors.
    """
    held = rows.where(sound(vec_col)).select(F.lit(0).alias("id"), F.col(vec_col).alias("v"))
    middle = centres(held)
    spread = scatter(held, lambda dim, v: middle[dim].centred(whole(v)))
    model = {}
    for dim, centre in middle.items():
        values, columns = eigen(spread[dim] / centre.n)
        model[dim] = Whitening(centre, float(np.trace(spread[dim])) / centre.n, values[:components], columns[:, :components])
    return model


def project(rows: DataFrame, model: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, deviation, whitened), one row per sound row; deviation as decimal, NULL beyond 38 digits."""
    most = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, v in tiles(batch, 1):
                if dim not in model:
                    continue
                x = whole(v)
                far = [str(y) if y < most else None for y in model[dim].centre.deviation(x).tolist()]
                white = pa.array(list(model[dim](x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([dim] * len(at), pa.int32()), pa.array(far, pa.string()), white],
                    ["vec_id", "dim", "deviation", "whitened"],
                )

    ship()
    held = rows.where(sound(vec_col)).select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    kind = held.schema["vec_id"].dataType.simpleString()
    out = held.mapInArrow(run, f"vec_id {kind}, dim int, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_errors(white: DataFrame) -> dict[int, float]:
    """By length: largest absolute entry of the covariance of the whitened rows minus the identity, from all rows of `project`."""
    means: dict[int, dict[int, float]] = {}
    each = white.select("dim", F.posexplode("whitened").alias("i", "w"))
    count = {}
    for r in each.groupBy("dim", "i").agg(F.avg("w").alias("m"), F.count("w").alias("n")).collect():
        means.setdefault(r["dim"], {})[r["i"]] = r["m"]
        count[r["dim"]] = r["n"]
    out = {}
    for dim, of in means.items():
        mean = np.array([of[i] for i in range(len(of))])
        rows = white.where(F.col("dim") == dim).select("vec_id", "whitened")
        total = scatter(rows, lambda _, v, mean=mean: v - mean)[len(mean)]
        out[dim] = float(np.abs(total / count[dim] - np.eye(len(mean))).max())
    return out


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per sound row and component.

    Rows with a NULL vector, or a NULL or non-finite entry, take no part. Rows
    repeated or without an id count and are returned like any other; other columns are
    ignored. Vectors of different length are whitened apart, each length with its
    own n. Components are numbered from 1 by falling eigenvalue (equal ones in
    any order), and those without variance are left out: a table with one row,
    with equal rows only, with empty vectors only or with none gives no rows. Entries beyond
    2^61 / 64 count as that bound. `deviation` is a decimal, NULL beyond 38 digits.
    """
    spark = rows.sparkSession
    model = fit(rows, vec_col, components)
    white = stage(project(rows, model, id_col, vec_col), "white")
    errors = identity_errors(white)
    facts = [
        (dim, i + 1, m.centre.n, float(e / m.trace), errors[dim]) for dim, m in model.items() if dim in errors for i, e in enumerate(m.values)
    ]
    known = spark.createDataFrame(facts, "dim int, component int, n bigint, explained double, identity_error double")
    each = white.select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    each = each.withColumn("component", F.col("at") + 1).drop("at")
    joined = each.join(F.broadcast(known), ["dim", "component"])  # COMPONENTS rows per length of vector
    return joined.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_whiten_jacobi(spark, sf_dir: str) -> DataFrame:
    """All `embeddings` on their first 32 components; a deviation that no long holds is NULL."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
