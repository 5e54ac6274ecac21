"""Hard negatives by exact integer scores of anchors against all rows.

Components become whole numbers. Rows lie in blocks of bounded size; a chunk of
anchors is broadcast, meets every block once for its positives and once more
for the rows inside the window under each positive's score. A tile of anchors
times a block is multiplied by Strassen's recursion on 64-bit integers, padded
with zeros. Sums wrap around at 2^64, which does no harm on the way: a score
itself always fits, as components are held to a bound.

What a tile finds goes into heaps of the best few (score, id) per anchor, for
the windows per anchor and positive. Heaps merge tile by tile inside a task and
task by task in the shuffle, so no list of scores is ever kept, and a group of
copies of any size costs its tiles and no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peerwatch.llm.common import ship, table
from peerwatch.sources.staging import stage

#: A component c becomes floor(SCALE * c).
SCALE = 256
ANCHOR_STEP = 50
POSITIVES, NEGATIVES = 5, 3
#: Share of a positive's score, in percent, that a negative's must have at least and at most.
LOW, HIGH = 50, 95
#: Rows of a block at most, anchors of a tile.
BLOCK, TILE = 4096, 512
#: Bytes of anchors' vectors in a chunk, about. With their heaps, a task holds some twenty times a 64-dimensional chunk's bytes at most.
CHUNK_BYTES = 4 << 20
#: A side of a product shorter than twice this is not halved.
LEAF = 16

_NONE = -(2**63 - 1)
_LAST = 2**63 - 1


def largest(dim: int) -> int:
    """Bound of a component, such that a score of `dim` products is below 2^62."""
    return min(2**31 - 1, math.isqrt((1 << 62) // max(1, dim)))


def whole(vectors: np.ndarray) -> np.ndarray:
    """The vectors' components as whole numbers, at most `largest` in size."""
    bound = largest(vectors.shape[1])
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -bound, bound).astype(np.int32)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b.T of int64 matrices (m, k) and (n, k), modulo 2^64, by seven products of halves instead of eight."""
    sides = m, k, n = len(a), a.shape[1], len(b)
    depth = 0
    while min(sides) >> (depth + 1) >= leaf:
        depth += 1
    step = 1 << depth
    padded = [-(-side // step) * step for side in sides]
    if padded != [m, k, n]:
        a = np.pad(a, ((0, padded[0] - m), (0, padded[1] - k)))
        b = np.pad(b, ((0, padded[2] - n), (0, padded[1] - k)))
    return _halves(a, b, depth)[:m, :n]


def _halves(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return a @ b.T
    m, k, n = len(a) // 2, a.shape[1] // 2, len(b) // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b21, b12, b22 = b[:n, :k], b[:n, k:], b[n:, :k], b[n:, k:]  # b is transposed
    p1 = _halves(a11 + a22, b11 + b22, depth - 1)
    p2 = _halves(a21 + a22, b11, depth - 1)
    p3 = _halves(a11, b12 - b22, depth - 1)
    p4 = _halves(a22, b21 - b11, depth - 1)
    p5 = _halves(a11 + a12, b22, depth - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    np.add(p3, p5, out=out[:m, n:])
    np.add(p2, p4, out=out[m:, :n])
    p4 += p1
    p4 -= p5
    p1 -= p2
    p1 += p3
    np.add(p4, _halves(a12 - a22, b21 + b22, depth - 1), out=out[:m, :n])
    np.add(p1, _halves(a21 - a11, b11 + b12, depth - 1), out=out[m:, n:])
    return out


class Heaps:
    """The best `k` (score, id) of each of `n` owners: higher scores first, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _NONE)
        self.id = np.full((n, k), _LAST)

    def merge(self, owners: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in heaps (owners, any width) of the same order; an id comes once per owner in all."""
        k = self.score.shape[1]
        score = np.concatenate((self.score[owners], score), axis=1)
        ids = np.concatenate((self.id[owners], ids), axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[owners] = np.take_along_axis(score, best, 1)
        self.id[owners] = np.take_along_axis(ids, best, 1)

    def offer(self, owners: np.ndarray, score: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Take in a tile of scores (owners, ids) where it `fits`; ids ascend."""
        k = self.score.shape[1]
        fits &= score >= self.score[owners, -1][:, None]
        busy = np.nonzero(fits.any(axis=1))[0]
        if not len(busy):
            return
        held = np.where(fits[busy], score[busy], _NONE)
        if held.shape[1] > k:
            edge = -np.partition(-held, k - 1, axis=1)[:, k - 1 : k]
            tied = (held == edge) & (held != _NONE)
            taken = (held > edge) | (tied & (np.cumsum(tied, axis=1) <= k))
        else:
            taken = held != _NONE
        rows, at = np.nonzero(taken)
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(busy)))[rows]
        width = int(place.max()) + 1
        found, names = np.full((len(busy), width), _NONE), np.full((len(busy), width), _LAST)
        found[rows, place], names[rows, place] = held[rows, at], ids[at]
        self.merge(owners[busy], found, names)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, score, id) of all that is held."""
        owner, at = np.nonzero(self.score != _NONE)
        return owner, self.score[owner, at], self.id[owner, at]


def sound(column: str):
    """The vector is present, and all its components are present and finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))


def blocks(rows: DataFrame, id_col: str, vec_col: str, label_col: str, block: int = BLOCK) -> DataFrame:
    """(dim, ids, labels, vectors) of all rows that take part, vectors of one length together, ids ascending; stage the result."""
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def emit(dim: int, parts: list) -> pa.RecordBatch:
            ids, labels, vectors = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(ids)
            columns = [pa.array([c[order].tobytes()], pa.binary()) for c in (ids, labels, vectors)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *columns], ["dim", "ids", "labels", "vectors"])

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                which = np.nonzero(sizes == dim)[0]
                while len(which):
                    parts = held.setdefault(dim, [])
                    now, which = np.split(which, [block - sum(len(p[0]) for p in parts)])
                    parts.append((ids[now], labels[now], whole(flat[starts[now][:, None] + np.arange(dim)[None, :]])))
                    if sum(len(p[0]) for p in parts) == block:
                        yield emit(dim, held.pop(dim))
        for dim, parts in held.items():
            yield emit(dim, parts)

    ship()
    taken = rows.where(sound(vec_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")
    )
    single = taken.repartition(tasks, "id").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
    return single.select("id", "r.label", "r.v").mapInArrow(run, "dim int, ids binary, labels binary, vectors binary")


def _open(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    dim, ids, labels, vectors = (batch.column(c)[i].as_py() for c in range(4))
    ids = np.frombuffer(ids, np.int64)
    return dim, ids, np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.int32).reshape(len(ids), dim).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch], anchors: dict[int, tuple]) -> Iterator[tuple]:
    """(dim, owners, scores, anchors' labels, ids, labels) per tile of a chunk's anchors and a block."""
    for batch in batches:
        for i in range(len(batch)):
            dim, ids, labels, vectors = _open(batch, i)
            own, kinds, asked = anchors.get(dim, (np.empty(0, np.int64),) * 3)
            for a in range(0, len(own), TILE):
                owners = np.arange(a, min(a + TILE, len(own)))
                yield dim, owners, strassen(asked[owners], vectors), kinds[owners], ids, labels


def _anchors(index: DataFrame, step: int) -> DataFrame:
    """(dim, id, label, vector) of the rows whose id is divisible by `step`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                dim, ids, labels, vectors = _open(batch, i)
                at = np.nonzero(ids % step == 0)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), dim, np.int32)), pa.array(ids[at]), pa.array(labels[at]), pa.array([v.tobytes() for v in vectors[at]], pa.binary())],
                    ["dim", "id", "label", "vector"],
                )

    return index.mapInArrow(run, "dim int, id bigint, label bigint, vector binary")


def _first(found: DataFrame, owner: list[str], k: int) -> DataFrame:
    """The tasks' heaps merged: rank 1 to k per owner."""
    order = Window.partitionBy(*owner).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(index: DataFrame, shared, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        heaps = {dim: Heaps(len(own), k) for dim, (own, _, _) in anchors.items()}
        for dim, owners, score, kinds, ids, labels in _tiles(batches, anchors):
            own = anchors[dim][0][owners]
            heaps[dim].offer(owners, score, (kinds[:, None] == labels) & (own[:, None] != ids), ids)
        for dim, heap in heaps.items():
            owner, score, ids = heap.rows()
            yield pa.RecordBatch.from_arrays([pa.array(anchors[dim][0][owner]), pa.array(score), pa.array(ids)], ["anchor_id", "score", "id"])

    return _first(index.mapInArrow(run, "anchor_id bigint, score bigint, id bigint"), ["anchor_id"], k)


def _negatives(index: DataFrame, shared, positives, k: int) -> DataFrame:
    """`positives`: by length, (rows, slots) of ids, scores and the least and greatest score of a negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, known = shared.value, positives.value
        heaps = {dim: [Heaps(len(held[0]), k) for _ in range(held[0].shape[1])] for dim, held in known.items()}
        for dim, owners, score, kinds, ids, labels in _tiles(batches, anchors):
            _, _, least, most = known[dim]
            other = kinds[:, None] != labels
            for slot, heap in enumerate(heaps[dim]):
                low, high = least[owners, slot], most[owners, slot]
                if (low <= high).any():
                    heap.offer(owners, score, other & (score >= low[:, None]) & (score <= high[:, None]), ids)
        for dim, slots in heaps.items():
            for slot, heap in enumerate(slots):
                owner, score, ids = heap.rows()
                columns = [anchors[dim][0][owner], known[dim][0][owner, slot], known[dim][1][owner, slot], score, ids]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score", "score", "id"])

    found = index.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, id bigint")
    return _first(found, ["anchor_id", "positive_id"], k)


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole number between `low` and `high` percent of each score."""
    exact = score.astype(object)
    return np.array(-(-exact * low // 100), np.int64), np.array(exact * high // 100, np.int64)


def mine(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", step: int = ANCHOR_STEP,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Anchors are the rows whose id is divisible by `step`. Labels are whole
    numbers. Rows with a NULL id, label or vector, or a NULL or non-finite
    component, take no part; of rows repeated under one id the one with the least
    (label, vector) counts. Vectors of different length do not meet; empty ones
    all score 0. Components beyond `largest` count as that bound. Ties go to the smaller id.
    An anchor without positives, or with a positive of negative score, has no
    negatives there; an empty table has none. Other columns are ignored.
    """
    spark = rows.sparkSession
    index = stage(blocks(rows, id_col, vec_col, label_col, block), "blocks")
    anchors = stage(_anchors(index, step), "anchors")
    size = anchors.agg(F.coalesce(F.sum(F.length("vector") + 24), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    found = None
    for number in range(chunks):
        out = _mine_chunk(spark, index, anchors.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == number), positives, negatives, low, high)
        found = out if found is None else found.unionByName(out)
    return found


def _mine_chunk(spark: SparkSession, index: DataFrame, chunk: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Negatives of one chunk of anchors, staged; its broadcasts are gone when it returns."""
    asked = chunk.orderBy("id").toArrow()  # about CHUNK_BYTES
    dims = asked["dim"].to_numpy()
    held = {}
    for dim in np.unique(dims).tolist():
        part = asked.filter(pa.array(dims == dim))
        vectors = np.frombuffer(b"".join(part["vector"].to_pylist()), np.int64).reshape(len(part), dim)
        held[dim] = part["id"].to_numpy(), part["label"].to_numpy(), vectors
    ship()
    shared = spark.sparkContext.broadcast(held)
    best = _positives(index, shared, positives).toArrow()  # `positives` rows per anchor of the chunk
    known = {}
    for dim, (own, _, _) in held.items():
        ids, scores = np.full((len(own), positives), _LAST), np.full((len(own), positives), -1)
        of = np.searchsorted(own, best["anchor_id"].to_numpy())
        mine_ = (of < len(own)) & (own[np.minimum(of, len(own) - 1)] == best["anchor_id"].to_numpy())
        at = best["rank"].to_numpy() - 1
        ids[of[mine_], at[mine_]], scores[of[mine_], at[mine_]] = best["id"].to_numpy()[mine_], best["score"].to_numpy()[mine_]
        least, most = window(scores, low, high)
        empty = (ids == _LAST) | (scores < 0)
        known[dim] = ids, scores, np.where(empty, 1, least), np.where(empty, 0, most)
    slots = spark.sparkContext.broadcast(known)
    out = _negatives(index, shared, slots, negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    out = stage(out, "negatives")
    shared.destroy()
    slots.destroy()
    return out


def op12_strassen_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth of all `embeddings`; a row whose id is divisible by 7 takes the next of ten labels."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))


ORACLES = {
    "op12_strassen_negatives": """
        WITH rows_ AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
                   CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
            WHERE a.vec_id % 50 = 0
        ), positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, p.positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
               s.id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
         AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
        QUALIFY rank <= 3
    """
}
