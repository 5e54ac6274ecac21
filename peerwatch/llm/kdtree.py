"""Sharding by a k-d tree over metadata, at distributed weighted medians.

A node is split across its widest metadata dimension, at the place that divides
its bytes as its shards are divided, until every leaf is one shard. The place is
found without sorting: bytes are summed per cell of the node's key range, the
cell that holds the place is looked into again, until what is left in it is
small. A key is the dimension's value, then a hash of the text, then one of the
row, so equal texts stay side by side. A cut that falls into them goes to the
nearer border of the group; they are cut only where they outweigh a shard or both
borders lie further from the place than a fiftieth of one.

All nodes of a level share each pass; a pass brings at most nodes x `CELLS`
sums to the driver, whatever the data.

Rows with equal texts take the least metadata among them, so copies from several
sources share all keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerwatch.llm.common import table
from peerwatch.sources.staging import stage

SHARDS = 24
CELLS = 512
#: A cut may miss its place by this share of a shard; by more, if that spares a group of equal texts.
TOLERANCE = 0.002
WHOLE = 0.02
OVERHEAD = 8
_UNIT = (1 << 30) - 1


@dataclass
class Node:
    """A set of shards; a split node has a cut on (dimension key, row key) and two children."""

    shards: int
    first: int
    weight: int = 0
    dim: int = 0
    cut: tuple[int, int] | None = None
    low: Node | None = None
    high: Node | None = None


def document_dims(text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> list[Column]:
    """Metadata dimensions of documents, each within [0, 1]: size on a log scale, language, source."""
    size = F.log2(F.lit(1.0) + F.octet_length(F.coalesce(F.col(text_col), F.lit("")))) / 32
    named = [F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / float(1 << 32) for c in (lang_col, source_col)]
    return [size, *named]


def _metadata(docs: DataFrame, id_col: str, text_col: str, dims: list[Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(text, F.lit(7)), 32)
    keys = [
        (F.shiftleft((F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(d, F.lit(0.0)))) * _UNIT).cast("long"), 32).bitwiseOR(tie)).alias(f"k{i}")
        for i, d in enumerate(dims)
    ]
    row = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text), 1).alias("row_key")
    own = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), *keys, row,
    ), "own")
    same = ["text_key", "text_crc32", "size"]
    names = [f"k{i}" for i in range(len(dims))]
    copies = own.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *[F.min(k).alias(f"least_{k}") for k in names])
    shared = stage(copies.where("n > 1").drop("n"), "copies")
    return own.join(shared, same, "left").select(
        "doc_id", "size", "text_crc32", *[F.coalesce(f"least_{k}", k).alias(k) for k in names], "row_key"
    )


def _goes_low(node: Node) -> Column:
    key, row = node.cut
    at = F.col(f"k{node.dim}")
    return (at < key) | ((at == key) & (F.col("row_key") < row))


def _leaf(node: Node, of) -> Column:
    if node.cut is None:
        return F.lit(of(node))
    return F.when(_goes_low(node), _leaf(node.low, of)).otherwise(_leaf(node.high, of))


def _spans(rows: DataFrame, dims: int) -> dict:
    found = rows.groupBy("node").agg(
        F.sum("size").alias("weight"), *[F.min(f"k{i}").alias(f"l{i}") for i in range(dims)], *[F.max(f"k{i}").alias(f"h{i}") for i in range(dims)]
    )
    return {r["node"]: r for r in found.collect()}


def _by_node(values: dict[int, object], kind: str) -> Column:
    """Value of the row's node; the nodes are at most as many as shards."""
    pairs = [x for node, value in values.items() for x in (F.lit(node), F.lit(value).cast(kind))]
    return F.element_at(F.create_map(*pairs), F.col("node"))


def _narrow(rows: DataFrame, key: Column, wanted: dict[int, int], low: dict[int, int], high: dict[int, int], slack: int, whole: int = 0, shard: int = 0) -> dict[int, tuple]:
    """Per node the first key above the cut, or the one key that the cut lies in.

    `wanted` is the weight that belongs below the cut; it may be missed by `slack`, or
    by `whole` beside a single key that holds the place and weighs `shard` at most. Returns node -> (key, weight
    below it, whether the cut lies inside that key, whether its upper border is nearer).
    """
    done: dict[int, tuple] = {}
    below = dict.fromkeys(wanted, 0)
    low, high = dict(low), dict(high)
    while live := [n for n in wanted if n not in done]:
        step = {n: max(1, -(-(high[n] - low[n] + 1) // CELLS)) for n in live}
        inside = rows.where(F.col("node").isin(live)).withColumn("key", key)
        inside = inside.withColumn("lo", _by_node({n: low[n] for n in live}, "long"))
        inside = inside.where((F.col("key") >= F.col("lo")) & (F.col("key") <= _by_node({n: high[n] for n in live}, "long")))
        cell = F.expr("(key - lo) div step").alias("cell")
        sums = inside.withColumn("step", _by_node({n: step[n] for n in live}, "long")).groupBy("node", cell).agg(
            F.sum("size").alias("weight"), F.min("key").alias("least"), F.max("key").alias("most")
        ).collect()
        for n in live:
            cells = sorted((r for r in sums if r["node"] == n), key=lambda r: r["cell"])
            upto = below[n]
            for r in cells:
                if upto + r["weight"] > wanted[n] or r is cells[-1]:
                    under, over = wanted[n] - upto, upto + r["weight"] - wanted[n]
                    spared = r["least"] == r["most"] and r["weight"] <= shard
                    if min(abs(under), abs(over)) <= (max(slack, whole) if spared else slack):
                        near_low = abs(under) <= abs(over)
                        done[n] = (r["least"], upto, False, False) if near_low else (r["most"] + 1, upto + r["weight"], False, False)
                    elif r["least"] == r["most"]:
                        done[n] = (r["least"], upto, True, abs(over) < abs(under))
                    else:
                        below[n], low[n], high[n] = upto, r["least"], r["most"]
                    break
                upto += r["weight"]
    return done


def grow(rows: DataFrame, dims: int, shards: int, tolerance: float = TOLERANCE, kept_whole: float = WHOLE) -> Node:
    """The tree over staged metadata, level by level."""
    root = Node(shards, 0)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        ids = {id(n): i for i, n in enumerate(level)}
        placed = rows.withColumn("node", _leaf(root, lambda n: ids.get(id(n), -1))).where("node >= 0")
        spans = _spans(placed, dims)
        wanted, low, high = {}, {}, {}
        for i, node in enumerate(level):
            span = spans.get(i)
            if span is None:  # no rows: any cut will do
                node.cut = (0, 0)
            else:
                node.weight = span["weight"]
                node.dim = max(range(dims), key=lambda d: (span[f"h{d}"] >> 32) - (span[f"l{d}"] >> 32))
                wanted[i] = node.weight * (node.shards // 2) // node.shards
                low[i], high[i] = span[f"l{node.dim}"], span[f"h{node.dim}"]
        slack = {i: int(level[i].weight / level[i].shards * tolerance) for i in wanted}
        if wanted:
            key = F.lit(None).cast("long")
            for d in range(dims):
                key = F.when(F.col("node").isin([i for i in wanted if level[i].dim == d] or [-2]), F.col(f"k{d}")).otherwise(key)
            shard = min(level[i].weight // level[i].shards for i in wanted)
            cuts = _narrow(placed, key, wanted, low, high, min(slack.values()), int(shard * kept_whole), shard)
            heavy = {i: c for i, c in cuts.items() if c[2]}
            for i, (at, *_) in cuts.items():
                level[i].cut = (at, 0)
            if heavy:
                # One key outweighs the tolerance: the rows under it are divided by their own hash.
                same = placed.withColumn("key", key).where(F.col("node").isin(list(heavy)) & (F.col("key") == _by_node({i: c[0] for i, c in heavy.items()}, "long")))
                fine = _narrow(
                    same, F.col("row_key"), {i: wanted[i] - c[1] for i, c in heavy.items()}, dict.fromkeys(heavy, 0),
                    dict.fromkeys(heavy, (1 << 63) - 1), min(slack.values()),
                )
                for i, (row, _, _, above) in fine.items():
                    # A row that the place falls into, with rows repeating it, goes to the nearer side.
                    level[i].cut = (heavy[i][0], row + above)
        for node in level:
            half = node.shards // 2
            node.low, node.high = Node(half, node.first), Node(node.shards - half, node.first + half)
        level = [child for node in level for child in (node.low, node.high)]
    return root


def kd_shards(
    docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dims: list[Column] | None = None,
    id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of `docs`.

    The size is the text's UTF-8 bytes plus 8. Give the number of shards, or the
    bytes of one. Shards are near equal in size; a single document cannot be cut.
    Slots number a shard's rows from 0 without gaps. NULL texts are empty, NULL
    metadata counts as 0 or as an empty name; repeated rows share a shard. Very
    long texts are one row of their size. An empty table gives no rows; other
    columns are ignored.
    """
    dims = document_dims(text_col) if dims is None else dims
    rows = stage(_metadata(docs, id_col, text_col, dims), "metadata")
    if target_bytes is not None:
        total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
        shards = max(1, -(-total // target_bytes))
    tree = grow(rows, len(dims), shards, tolerance)
    placed = rows.select("doc_id", "size", "text_crc32", _leaf(tree, lambda n: n.first).cast("int").alias("shard"))
    return number_slots(placed)


def number_slots(placed: DataFrame) -> DataFrame:
    """Rows with `slot`: their number within `shard`, from per-task counts; no shard meets in one task."""
    spot = F.monotonically_increasing_id()
    laid = stage(placed.sortWithinPartitions("shard").withColumn("spot", spot), "laid").withColumn("part", F.shiftright("spot", 33))
    runs = laid.groupBy("shard", "part").agg(F.min("spot").alias("least"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(runs.select("shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("base")), "bases")
    return laid.join(bases, ["shard", "part"]).select(*placed.columns, (F.col("base") + F.col("spot")).alias("slot"))


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents themselves, one folder per shard. Ids must be unique."""
    side = sharded.select(F.col("doc_id").alias(id_col), "shard")
    docs.join(side, id_col).repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(16))).write.partitionBy("shard").parquet(path)


def op4_kd_shards(spark, sf_dir: str) -> DataFrame:
    """All `documents` in shards near equal in bytes."""
    rows = kd_shards(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
