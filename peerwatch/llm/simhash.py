"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint is the bitwise majority over the XXH64 values of a text's word
shingles. Fingerprints that differ in at most `RADIUS` bits are linked, and
documents fall into the connected components of the links.

Searching: the 64 bits are cut into RADIUS + 1 bands. Two fingerprints within
the radius agree on a band, so each distinct fingerprint joins one shard per
band, that of the first bits of the band, and no link is lost. As many bits count
as bring shards near `SHARD` members; up to `SHARD` fingerprints in all, there is
one shard. A shard that exceeds twice `SHARD` is cut again, by bands of its
remaining bits; distinct fingerprints make that end. Each shard is one BK-tree:
children hang under the integer Hamming distance to their parent, and a search
follows only edges within the radius of its own distance.

Trees are written as flat arrays and broadcast in bundles of at most
`BUNDLE_BYTES`, one bundle at a time, to tasks that read the fingerprints of the
bundle's shards. What a search finds is merged per run of queries and told as
each member with one it is connected to, not as all pairs, so a dense group
costs as many rows as it has members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerwatch.llm.common import fresh, ship, table
from peerwatch.llm.components import components
from peerwatch.sources.staging import stage

SHINGLE = 3
HASH_SEED = 42
RADIUS = 2
#: Fingerprints of a BK-tree, about; twice as many at most.
SHARD = 1024
#: Bytes of trees that are broadcast at a time, and of a node.
BUNDLE_BYTES, NODE_BYTES = 4 << 20, 13
#: Tasks over which a bundle's fingerprints are spread, and fingerprints that search a tree together.
SPREAD, TOGETHER = 16, 1024
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 text as an unsigned number; zero without words."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, HASH_SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1))
        hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of whole texts; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            values = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    ship()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


class BKTree:
    """BK-tree over distinct fingerprints as flat arrays.

    Node 0 is the root; `parent` and `edge` say under which node, and at which
    distance to it, a node hangs. The children of a node follow each other by rising
    edge, and so do the nodes of a level by their parents: one sorted array of
    (parent, edge) serves all lookups.
    """

    def __init__(self, values: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.values, self.parent, self.edge = values, parent, edge
        self.hangs = parent[1:].astype(np.int64) * 128 + edge[1:]
        self.visited = 0

    @classmethod
    def grow(cls, values: np.ndarray) -> BKTree:
        """Level by level: the first member of every group becomes its node, the others fall into groups by their distance to it."""
        members, group = np.arange(len(values)), np.zeros(len(values), np.int64)
        above, at = np.array([-1]), np.array([0])
        nodes, parents, edges, before = [], [], [], 0
        while len(members):
            first = np.concatenate(([True], group[1:] != group[:-1]))
            pivots = members[first]
            nodes.append(pivots)
            parents.append(above)
            edges.append(at)
            rest, under = members[~first], group[~first]
            far = np.bitwise_count(values[rest] ^ values[pivots[under]]).astype(np.int64)
            order = np.lexsort((far, under))
            members, under, far = rest[order], under[order], far[order]
            new = np.concatenate(([True], (under[1:] != under[:-1]) | (far[1:] != far[:-1])))[: len(members)]
            group = np.cumsum(new) - 1
            above, at = before + under[new], far[new]
            before += len(pivots)
        return cls(values[np.concatenate(nodes)], np.concatenate(parents).astype(np.int32), np.concatenate(edges).astype(np.uint8))

    def to_bytes(self) -> bytes:
        return self.values.tobytes() + self.parent.tobytes() + self.edge.tobytes()

    @classmethod
    def from_bytes(cls, held: bytes) -> BKTree:
        n = len(held) // NODE_BYTES
        return cls(np.frombuffer(held, np.uint64, n), np.frombuffer(held, np.int32, n, 8 * n), np.frombuffer(held, np.uint8, n, 12 * n))

    def depth(self) -> int:
        """Edges from the root to the farthest node."""
        level = np.zeros(len(self.values), np.int64)
        for i in range(1, len(level)):
            level[i] = level[self.parent[i]] + 1
        return int(level.max(initial=0))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes within `radius`; a level of the tree at a time, for all queries together."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found = []
        while len(query):
            self.visited += len(query)
            far = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = far <= radius
            found.append((query[near], node[near]))
            low = np.searchsorted(self.hangs, node * 128 + np.maximum(far - radius, 0), "left")
            high = np.searchsorted(self.hangs, node * 128 + far + radius, "right")
            count = high - low
            starts = np.cumsum(count) - count
            node = np.repeat(low - starts, count) + np.arange(count.sum()) + 1
            query = np.repeat(query, count)
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (query, node)


def connected(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node it is connected to by the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tree_links(tree: BKTree, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the tree's members as all pairs of a query and a member would; queries are members."""
    query, node = tree.search(queries, radius)
    own = np.empty(len(queries), np.int64)
    same = queries[query] == tree.values[node]
    own[query[same]] = node[same]
    label = connected(own[query], node, len(tree.values))
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return tree.values[moved].view(np.int64), tree.values[label[moved]].view(np.int64)


def _bands(mask: int, parts: int) -> list[int]:
    """The bits that `mask` leaves free, cut into `parts` runs; each with the bits of `mask`."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _long(number: int):
    return F.lit(number).cast("long")


def _first_bits(mask: int, inside: int, bits: int) -> int:
    """`mask` with the lowest `bits` of the further bits that `inside` has."""
    more = [bit for bit in range(64) if inside >> bit & 1 and not mask >> bit & 1][:bits]
    return mask | sum(1 << bit for bit in more)


def _cuts(mask: int, radius: int, size: int, shard: int) -> dict[int, int]:
    """Masks of the shards into which `size` fingerprints that agree on `mask` are cut, each with the whole band it begins."""
    bits = max(0, math.ceil(math.log2(size / shard))) if size else 0
    return {_first_bits(mask, band, bits): band for band in _bands(mask, radius + 1)}


def _spread(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, mask): one row per band."""
    return rows.select("fp", F.explode(F.array(*[_long(_signed(m)) for m in masks])).alias("mask"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """((mask, value), fingerprints) of rows that follow each other, at most a batch together."""
    for batch in batches:
        mask, value, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if len(fp):
            edge = np.nonzero((np.diff(mask) != 0) | (np.diff(value) != 0))[0] + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)]):
                yield (int(mask[a]), int(value[a])), fp[a:b]


def _plant(shards: DataFrame) -> DataFrame:
    """(mask, value, tree): the BK-tree of every shard of at least two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: tuple, parts: list) -> Iterator[pa.RecordBatch]:
            if sum(map(len, parts)) > 1:
                tree = BKTree.grow(np.unique(np.concatenate(parts)).view(np.uint64)).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([tree], pa.binary())], ["mask", "value", "tree"])

        key, parts = None, []
        for now, fps in _runs(batches):
            if now != key:
                yield from told(key, parts)
                key, parts = now, []
            parts.append(fps)
        yield from told(key, parts)

    ship()
    placed = shards.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return placed.mapInArrow(run, "mask bigint, value bigint, tree binary")


def _search(shards: DataFrame, sizes: DataFrame, radius: int, bundle_bytes: int) -> DataFrame:
    """Links (a, b) within the shards: their trees are broadcast, a bundle at a time; `sizes` counts the members of each."""
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    bundles = max(1, -(-2 * total * NODE_BYTES // bundle_bytes))

    def bundle() -> Column:
        return F.pmod(F.xxhash64("mask", "value"), F.lit(bundles)).cast("int")

    # Two shards of the largest size fit in a bundle, so doubling ends.
    while (sizes.groupBy(bundle().alias("b")).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] or 0) * NODE_BYTES > bundle_bytes:
        bundles *= 2
    trees = stage(_plant(shards).withColumn("bundle", bundle()).repartition("bundle"), "trees", by=["bundle"])
    asking = shards.select("mask", "value", "fp", bundle().alias("bundle"))
    dealt = asking.repartition("bundle", F.pmod(F.xxhash64("fp"), F.lit(SPREAD))).sortWithinPartitions("bundle", "mask", "value")
    asking = stage(dealt, "asking", by=["bundle"])
    found = None
    for number in range(bundles):
        held = trees.where(F.col("bundle") == number).select("mask", "value", "tree").toArrow()  # at most `bundle_bytes`
        if not len(held):
            continue
        planted = dict(zip(zip(held["mask"].to_pylist(), held["value"].to_pylist()), held["tree"].to_pylist()))
        shared = shards.sparkSession.sparkContext.broadcast(planted)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for key, fps in _runs(batches):
                if key in shared.value:
                    tree = BKTree.from_bytes(shared.value[key])
                    for a in range(0, len(fps), TOGETHER):
                        links = tree_links(tree, fps[a : a + TOGETHER].view(np.uint64), radius)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in links], ["a", "b"])

        ship()
        rows = asking.where(F.col("bundle") == number).select("mask", "value", "fp")
        links = stage(rows.mapInArrow(run, "a bigint, b bigint"), "links")
        shared.destroy()
        found = links if found is None else found.unionByName(links)
    return shards.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0) if found is None else found


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (fp) exactly as all pairs within `radius` would."""
    bands = _cuts(0, radius, distinct.count(), shard)
    spread = _spread(distinct, list(bands))
    found: DataFrame | None = None
    while True:
        placed = stage(spread.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "bands")
        sizes = stage(placed.groupBy("mask", "value").count(), "sizes")
        large = sizes.where(F.col("count") > 2 * shard)
        # The largest shard of each mask that needs a finer one; masks are at most (radius + 1) ** depth.
        most = {row["mask"]: row["n"] for row in large.groupBy("mask").agg(F.max("count").alias("n")).collect()}
        small = placed.join(large, ["mask", "value"], "left_anti") if most else placed
        links = _search(small, sizes.where(F.col("count") <= 2 * shard), radius, max(bundle_bytes, 4 * shard * NODE_BYTES))
        found = links if found is None else found.unionByName(links)
        if not most:
            return found
        # A large shard is cut by the rest of its band, and if that is used up by bands of the bits left free.
        finer, known = {}, bands
        for m, n in ((m & _ALL, n) for m, n in most.items()):
            below = _cuts(m, radius, n, shard) if known[m] == m else {known[m]: known[m]}
            finer[_signed(m)] = list(map(_signed, below))
            bands = bands | below
        cuts = F.create_map(*[x for m, below in finer.items() for x in (_long(m), F.array(*map(_long, below)))])
        spread = placed.join(large, ["mask", "value"], "left_semi").select(
            "fp", F.explode(F.element_at(cuts, F.col("mask"))).alias("mask")
        )


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shard: int = SHARD, shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of `docs`.

    Texts without words (NULL, empty, white space) have fingerprint zero and are
    linked like any other. component_id is the least id reachable; NULL ids do
    not count, and a component with no other has a NULL one. Rows repeated under
    one id each get a row. An empty table gives no rows; other columns are ignored.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    return group_rows(prints, nodes, stage(fingerprint_links(nodes.select("fp"), radius, shard), "found"))


def group_rows(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `prints` (id, fp), from `nodes` (fp, first id) and links (a, b), all staged."""
    members = stage(components(links), "members")
    linked = stage(members.join(nodes, members["node"] == nodes["fp"]).select("fp", "component", "first"), "linked")
    least = stage(linked.groupBy("component").agg(F.min("first").alias("least")), "least")
    named = stage(linked.join(least, "component").select("fp", "least"), "named")
    final = stage(
        nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "final"
    )
    return prints.join(final, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay when each component keeps the document with its least id.

    Rows under one id stay or go together, and stay if one of them stays; rows
    without an id stay. All columns are kept, whatever their names.
    """
    return drop_members(docs, near_groups(docs, id_col, text_col, radius), id_col)


def drop_members(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows of `docs` whose id is the least of its component in `groups`, or absent."""
    dropped = stage(
        groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays").select("doc_id"),
        "dropped",
    )
    side = dropped.toDF(fresh(docs.columns, "_dropped"))
    return docs.join(side, docs[id_col] == side[side.columns[0]], "left_anti")


def op2_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all `documents`."""
    return near_groups(table(spark, sf_dir, "documents"))
