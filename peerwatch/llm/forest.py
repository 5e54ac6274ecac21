"""Approximate nearest neighbours by a hash-prefix forest.

A tree gives every vector a string of `BITS` sign bits of random projections and
keeps the strings sorted, so all strings with a common prefix are one slice. A
query descends in every tree to the longest prefix it shares with a string;
then all trees ascend together, one bit at a time, until the slices hold enough
candidates, whose distances are computed exactly.

The index is a table of blocks: a bounded number of vectors with the sorted
arrays of all trees. The array of a tree is the union of its blocks' arrays, so
the entries under a prefix are the sum of the blocks' slices: one pass counts
them for every prefix length, the ascent ends at these sums over the whole
table, and a second pass lets the blocks that a query's prefix reaches answer
with their nearest k. Neither a dense region nor near-copies of one vector crowd
a task, and a prefix that singles out few vectors costs a block without them
nothing but its look-ups.

How many entries are enough is measured: for a bounded sample of the queries the
true neighbours are found by brute force, and the least number of entries at
which the forest holds `TARGET` of them is wanted for all queries.

Queries are taken in bounded chunks, one after the other. The chunk's answers are
written and its broadcast is destroyed before the next chunk is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerwatch.llm.common import ship, table
from peerwatch.sources.staging import stage

TREES = 12
BITS = 64
SEED = 42
#: Vectors of a block at most, and their bytes.
BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
#: Entries that a query's slices must hold together at least, over all trees (repeats counted).
LEAST = 256
#: Queries per length of vector that are held against brute force, and the share of their neighbours that must be found.
SAMPLE, TARGET = 64, 0.96
#: Queries of a chunk, about.
CHUNK = 20_000
K = 10
QUERY_STEP = 100


def projections(dim: int, trees: int = TREES) -> np.ndarray:
    """Directions (dim, trees * BITS), the same on every executor."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """(trees, rows) bit strings as unsigned numbers, first bit highest."""
    bits = (vectors.astype(np.float32) @ directions) > 0
    packed = np.packbits(bits.reshape(len(vectors), -1, BITS), axis=2)
    return np.ascontiguousarray(packed).view(">u8")[:, :, 0].astype(np.uint64).T


def _prefix_range(strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that share the first `length` bits."""
    tail = np.where(length >= BITS, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(length, BITS - 1).astype(np.uint64))
    return strings & ~tail, strings | tail


def slices(trees: np.ndarray, strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trees, queries) bounds of the slices with a common prefix of `length` bits."""
    low, high = _prefix_range(strings, length[None, :])
    first = np.stack([np.searchsorted(t, q, "left") for t, q in zip(trees, low)])
    last = np.stack([np.searchsorted(t, q, "right") for t, q in zip(trees, high)])
    return first, last


def entries(trees: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """(queries, BITS + 1) entries of all trees together that share a prefix of each length."""
    found = np.zeros((strings.shape[1], BITS + 1), np.int64)
    live = np.arange(strings.shape[1])
    for length in range(BITS + 1):
        first, last = slices(trees, strings[:, live], np.full(len(live), length))
        found[live, length] = (last - first).sum(axis=0)
        live = live[found[live, length] > 0]
        if not len(live):
            break
    return found


def ascend(found: np.ndarray, wanted: int) -> np.ndarray:
    """The longest prefix, the same in all trees, whose slices hold `wanted` entries together; 0 if none does."""
    return np.maximum((found >= wanted).sum(axis=1) - 1, 0)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that two strings have in common before the first that differs."""
    differ = a ^ b
    top = (differ & ~(differ >> np.uint64(1))).astype(np.float64)  # no carry when rounded
    return np.where(differ == 0, BITS, BITS - np.frexp(top)[1])


def calibrate(found: np.ndarray, prefixes: np.ndarray, target: float = TARGET) -> int:
    """The least number of wanted entries at which the sample's true neighbours are found at the target share.

    `prefixes` holds, per query, the longest prefix that each true neighbour shares in any tree; -1 where there is none.
    """
    there = prefixes >= 0
    options = np.unique(found)
    low, high = 0, len(options) - 1  # wanting everything finds everything
    while low < high:
        middle = (low + high) // 2
        held = (prefixes >= ascend(found, options[middle])[:, None])[there]
        low, high = (low, middle) if not len(held) or held.mean() >= target else (middle + 1, high)
    return int(options[low])


def valid(column: str):
    """Vectors that take part: present, not empty, all components finite, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


def build_index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, block: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (dim, ids, vectors, strings, order) over every valid row with an id; stage the result.

    Vectors of different length are never compared and lie in different blocks.
    """
    kind = rows.schema[vec_col].dataType.elementType.simpleString()
    exact = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def emit(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([i for i, _ in held[dim]])
            vectors = np.concatenate([v for _, v in held.pop(dim)])
            strings = hash_strings(vectors, projections(dim, trees))
            order = np.argsort(strings, axis=1, kind="stable").astype(np.uint32)
            columns = [
                pa.array([dim], pa.int32()), *(
                    pa.array([x.tobytes()], pa.binary())
                    for x in (ids, vectors, np.take_along_axis(strings, order.astype(np.int64), 1), order)
                ),
            ]
            return pa.RecordBatch.from_arrays(columns, ["dim", "ids", "vectors", "strings", "order"])

        for batch in batches:
            lists = batch.column(1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                which = np.nonzero(sizes == dim)[0]
                vectors = flat[starts[which][:, None] + np.arange(dim)[None, :]].astype(exact)
                most = max(1, min(block, BLOCK_BYTES // (dim * vectors.itemsize)))
                at = 0
                while at < len(which):
                    room = most - count.get(dim, 0)
                    part = slice(at, at + room)
                    held.setdefault(dim, []).append((ids[which[part]].astype(np.int64), vectors[part]))
                    count[dim] = count.get(dim, 0) + len(which[part])
                    at += room
                    if count[dim] >= most:
                        yield emit(dim)
                        count[dim] = 0
        for dim in list(held):
            yield emit(dim)

    ship()
    sound = rows.where(valid(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return sound.mapInArrow(run, "dim int, ids binary, vectors binary, strings binary, order binary")


def _opened(block: tuple, trees: int, exact) -> tuple:
    dim, ids, vectors, strings, order = block
    return (
        dim, np.frombuffer(ids, np.int64), np.frombuffer(vectors, exact).reshape(-1, dim),
        np.frombuffer(strings, np.uint64).reshape(trees, -1), np.frombuffer(order, np.uint32).reshape(trees, -1),
    )


def _blocks(batches: Iterator[pa.RecordBatch], trees: int, exact) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):
            yield _opened(tuple(batch.column(c)[i].as_py() for c in range(5)), trees, exact)


def _by_row(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A block's strings in the order of its rows."""
    rows = np.empty_like(strings)
    np.put_along_axis(rows, order.astype(np.int64), strings, 1)
    return rows


def _reached(block: tuple, asked: tuple) -> np.ndarray:
    """Entries of a block by query and prefix length; rows under the query's own id do not count."""
    _, ids, _, strings, order = block
    own, _, asked_strings = asked
    found = entries(strings, asked_strings)
    at = np.nonzero(np.isin(ids, own))[0]
    if len(at):
        by_row = _by_row(strings, order)
        place = {key: q for q, key in enumerate(own.tolist())}
        for row in at.tolist():
            q = place[int(ids[row])]
            for length in common_prefix(by_row[:, row], asked_strings[:, q]).tolist():
                found[q, : length + 1] -= 1
    return found


def _nearest(block: tuple, asked: tuple, lengths: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, ids, distances, rows) of each query's nearest k in a block, among the rows that share `lengths` bits in some tree."""
    _, ids, vectors, strings, order = block
    own, wanted, asked_strings = asked
    first, last = slices(strings, asked_strings, lengths)
    vectors = vectors.astype(np.float64)
    seen = np.zeros(len(ids), bool)
    for q in np.nonzero((last > first).any(axis=0))[0].tolist():
        seen[:] = False
        for t in range(len(strings)):
            seen[order[t, first[t, q] : last[t, q]]] = True
        rows = np.nonzero(seen & (ids != own[q]))[0]
        if not len(rows):
            continue
        far = np.sqrt(((vectors[rows] - wanted[q]) ** 2).sum(axis=1))
        if len(rows) > k:
            edge = np.partition(far, k - 1)[k - 1]
            close = far <= edge
            rows, far = rows[close], far[close]
        best = np.lexsort((ids[rows], far))[:k]
        yield q, ids[rows[best]], far[best], rows[best]


def _asked(rows: pa.Table, trees: int) -> dict[int, tuple]:
    """Length of vector -> (ids, vectors, hash strings) of collected queries."""
    by_dim: dict[int, list] = {}
    for key, v in zip(rows["id"].to_pylist(), rows["v"]):
        by_dim.setdefault(len(v), []).append((key, np.array(v.as_py(), np.float64)))
    held = {}
    for dim, pairs in by_dim.items():
        vectors = np.stack([v for _, v in pairs])
        held[dim] = (np.array([i for i, _ in pairs]), vectors, hash_strings(vectors, projections(dim, trees)))
    return held


def _count(index: DataFrame, asked, trees: int, exact) -> DataFrame:
    """(query_id, dim, c0 to c64): entries of the whole index by prefix length, one row per query that its blocks know.

    `asked` gives the queries within a task. A task adds up its blocks before it hands anything over.
    """
    names = [f"c{length}" for length in range(BITS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        queries = asked()
        for block in _blocks(batches, trees, exact):
            if block[0] in queries:
                sums[block[0]] = sums.get(block[0], 0) + _reached(block, queries[block[0]])
        for dim, found in sums.items():
            columns = [pa.array(queries[dim][0]), pa.array(np.full(len(found), dim, np.int32)), *map(pa.array, found.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "dim", *names])

    ship()
    counted = index.mapInArrow(run, "query_id bigint, dim int, " + ", ".join(f"{c} bigint" for c in names))
    return counted.groupBy("query_id", "dim").agg(*[F.sum(c).alias(c) for c in names])


def _counts(counted: DataFrame, dim: int, own: np.ndarray) -> np.ndarray:
    rows = counted.where(F.col("dim") == dim).drop("dim").toArrow()  # as many as queries
    held = dict(zip(rows["query_id"].to_pylist(), np.stack([rows[f"c{n}"].to_numpy() for n in range(BITS + 1)], axis=1)))
    return np.stack([held.get(key, np.zeros(BITS + 1, np.int64)) for key in own.tolist()])


def budgets(
    index: DataFrame, asked: DataFrame, exact, k: int = K, trees: int = TREES, sample: int = SAMPLE, target: float = TARGET, least: int = LEAST
) -> dict[int, int]:
    """Entries wanted by length of vector, from at most `sample` staged queries (id, v) of each length held against brute force."""
    drawn = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("id"), "id")
    some = asked.withColumn("n", F.row_number().over(drawn)).where(F.col("n") <= sample).drop("n").toArrow()
    queries = _asked(some, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, trees, exact):
            dim, _, _, strings, order = block
            if dim not in queries:
                continue
            own, _, asked_strings = queries[dim]
            by_row = _by_row(strings, order)
            for q, ids, far, rows in _nearest(block, queries[dim], np.zeros(len(own), np.int64), k):
                shared = common_prefix(by_row[:, rows], asked_strings[:, q, None]).max(axis=0)
                columns = [pa.array(np.full(len(ids), own[q])), pa.array(ids), pa.array(far), pa.array(shared.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "prefix"])

    ship()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    near = index.mapInArrow(run, "query_id bigint, vec_id bigint, score double, prefix int")
    true = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()  # k per query of the sample
    counted = stage(_count(index, lambda: queries, trees, exact), "sample")
    wanted = {}
    for dim, (own, _, _) in queries.items():
        place = {key: q for q, key in enumerate(own.tolist())}
        prefixes = np.full((len(own), k), -1)
        for r in true:
            if r["query_id"] in place:
                prefixes[place[r["query_id"]], r["rank"] - 1] = r["prefix"]
        wanted[dim] = max(least, 2 * trees * k, calibrate(_counts(counted, dim, own), prefixes, target))
    return wanted


def search(
    index: DataFrame, queries: DataFrame, kind: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
    trees: int = TREES, target: float = TARGET, least: int = LEAST, chunk: int = CHUNK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest k found in a staged index, by Euclidean distance.

    A row under the query's own id is no candidate. Ties go to the smaller id; rows
    repeated under another id are candidates each, so an id can fill several ranks.
    Other columns are ignored; an empty table gives no rows.
    Queries without a valid vector or id get no rows; of several query rows under
    one id one is asked. `kind` is the component type the index was built from.
    `target` is the share of true neighbours to find, as measured on a sample.
    """
    exact = np.float32 if kind == "float" else np.float64
    sound = queries.where(valid(vec_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.min(F.col(vec_col).cast("array<double>")).alias("v")
    )
    asked = stage(sound, "queries")
    spark = index.sparkSession
    chunks = max(1, -(-asked.count() // chunk))
    wanted = budgets(index, asked, exact, k, trees, target=target, least=least)
    found = None
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    for number in range(chunks):
        held = _asked(asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == number).orderBy("id").toArrow(), trees)  # about `chunk` rows
        shared = spark.sparkContext.broadcast(held)
        counted = stage(_count(index, lambda shared=shared: shared.value, trees, exact), "counted")
        lengths = {dim: ascend(_counts(counted, dim, own), wanted[dim]).astype(np.int8) for dim, (own, _, _) in held.items()}

        def run(batches: Iterator[pa.RecordBatch], shared=shared, lengths=lengths) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, trees, exact):
                dim = block[0]
                if dim not in lengths:
                    continue
                asked = shared.value[dim]
                parts = [
                    (np.full(len(ids), asked[0][q]), ids, far)
                    for q, ids, far, _ in _nearest(block, asked, lengths[dim].astype(np.int64), k)
                ]
                if parts:
                    columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        ship()
        near = index.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best = stage(best, "nearest")  # all of a query's candidates are in its chunk
        shared.destroy()
        found = best if found is None else found.unionByName(best)
    return found


def op9_hash_forest(spark, sf_dir: str) -> DataFrame:
    """Nearest ten of every hundredth of all `embeddings`."""
    rows = table(spark, sf_dir, "embeddings")
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    index = stage(build_index(rows), "index")
    return search(index, rows.where(F.col("vec_id") % QUERY_STEP == 0), kind)
