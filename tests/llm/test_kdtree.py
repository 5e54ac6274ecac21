import random
import zlib

import pytest

from peerwatch.llm import kdtree
from peerwatch.sources.staging import stage


def held(rows, got, shards):
    """Each row once, with its size and crc; slots gapless; returns bytes per shard."""
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_sizes_near_equal(docs_of):
    rows = [(i, "é " * (i * 37 % 400), "en" if i % 3 else "de", None if i % 11 == 0 else f"s{i % 7}") for i in range(4000)]
    rows += [(5000 + i, "the hot text " * 20, "en", "s0") for i in range(2000)]
    got = kdtree.kd_shards(docs_of(rows).repartition(5), 24).collect()
    sizes = held(rows, got, 24)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) < 0.03 * mean
    hot = {r["shard"] for r in got if r["size"] == 268}
    assert len(hot) <= 12  # equal texts lie side by side


@pytest.mark.parametrize("shards", [1, 2, 3, 5])
def test_few_rows(docs_of, shards):
    rows = [(1, None, None, None), (2, "", None, "s"), (2, "", None, "s"), (None, "x" * 100_000, "en", "s"), (4, "y", "en", "s")]
    held(rows, kdtree.kd_shards(docs_of(rows), shards).collect(), shards)


def test_only_repeated_rows_share_a_shard(docs_of):
    rows = [(1, "a", "en", "s")] * 50
    assert len(held(rows, kdtree.kd_shards(docs_of(rows), 4).collect(), 4)) == 1
    rows = [(i, "a", "en", "s") for i in range(400)]
    sizes = held(rows, kdtree.kd_shards(docs_of(rows), 4).collect(), 4)
    assert set(sizes.values()) == {900}


def test_copies_from_several_sources_share_a_shard(docs_of):
    rows = [(i, f"text {i // 4} " * 5, "en" if i % 2 else "de", f"s{i % 4}") for i in range(2000)]
    got = kdtree.kd_shards(docs_of(rows), 8).collect()
    held(rows, got, 8)
    shards = {}
    for r in got:
        shards.setdefault(r["doc_id"] // 4, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # at most one group at each cut


def plain_tree(rows, dims, shards, kept_whole):
    """Shard of each row by a k-d tree that sorts every node's rows, cutting at the very place."""
    shard_of, level = {}, [(rows, shards, 0)]
    while level:
        live = [(own, n, first) for own, n, first in level if n > 1 and own]
        shard_of |= {r["doc_id"]: first for own, n, first in level if n == 1 for r in own}
        shard = min((sum(r["size"] for r in own) // n for own, n, _ in live), default=0)
        level = []
        for own, n, first in live:
            dim = max(range(dims), key=lambda d: (max(r[f"k{d}"] for r in own) >> 32) - (min(r[f"k{d}"] for r in own) >> 32))
            own = sorted(own, key=lambda r: (r[f"k{dim}"], r["row_key"]))
            wanted = sum(r["size"] for r in own) * (n // 2) // n
            upto = 0
            for held in own:  # the row that the place falls into
                if upto + held["size"] > wanted:
                    break
                upto += held["size"]
            key = held[f"k{dim}"]
            under = wanted - sum(r["size"] for r in own if r[f"k{dim}"] < key)
            over = sum(r["size"] for r in own if r[f"k{dim}"] <= key) - wanted
            if under and min(under, over) <= int(shard * kept_whole) and under + over <= shard:
                cut = (key, -1) if under <= over else (key, 1 << 64)
            else:
                above = upto < wanted and upto + held["size"] - wanted < wanted - upto
                cut = (key, held["row_key"] + above)
            low = [r for r in own if (r[f"k{dim}"], r["row_key"]) < cut]
            high = [r for r in own if (r[f"k{dim}"], r["row_key"]) >= cut]
            level += [(low, n // 2, first), (high, n - n // 2, first + n // 2)]
    return shard_of


@pytest.mark.parametrize("shards, kept_whole", [(2, 0.0), (7, 0.0), (7, 0.05), (24, 0.3)])
def test_equals_a_plain_tree(docs_of, shards, kept_whole):
    draw = random.Random(shards)
    rows = [(i, "w " * draw.randrange(300), draw.choice(["en", "de", None]), f"s{draw.randrange(9)}") for i in range(700)]
    rows += [(1000 + i, "hot text " * 30, "en", f"s{i % 3}") for i in range(300)]
    docs = docs_of(rows)
    dims = kdtree.document_dims()
    own = stage(kdtree._metadata(docs, "doc_id", "text", dims), "metadata")
    tree = kdtree.grow(own, len(dims), shards, 0.0, kept_whole)
    got = own.select("doc_id", kdtree._leaf(tree, lambda n: n.first).alias("shard")).collect()
    want = plain_tree([r.asDict() for r in own.collect()], len(dims), shards, kept_whole)
    assert {r["doc_id"]: r["shard"] for r in got} == want and len(got) == len(rows)


def test_a_group_beside_the_place_stays_whole(docs_of):
    rows = [(i, f"{i:04d}" + "x" * 88, "en", "s") for i in range(400)]
    rows += [(1000 + i, "y" * 92, "en", "s") for i in range(4)]  # 4 % of a shard
    for place in range(5):
        got = kdtree.kd_shards(docs_of(rows[place * 3 :]), 4).collect()
        sizes = held(rows[place * 3 :], got, 4)
        mean = sum(sizes.values()) / 4
        assert len({r["shard"] for r in got if r["doc_id"] >= 1000}) == 1
        assert max(abs(s - mean) for s in sizes.values()) < 0.06 * mean


def test_target_bytes(docs_of):
    rows = [(i, "x" * 92, "en", f"s{i % 5}") for i in range(1000)]
    sizes = held(rows, kdtree.kd_shards(docs_of(rows), target_bytes=10_000).collect(), 10)
    assert max(sizes.values()) <= 10_300


def test_empty_table_and_other_columns(docs_of):
    assert kdtree.kd_shards(docs_of([]), 24).collect() == []
    docs = docs_of([(1, "a", "en", "s", 5, 6)], ", shard int, k0 int")
    assert kdtree.kd_shards(docs, 3).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_written_shards(docs_of, spark, tmp_path):
    docs = docs_of([(i, f"text {i}", "en", "s") for i in range(100)])
    sharded = kdtree.kd_shards(docs, 4)
    kdtree.write_shards(docs, sharded, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["doc_id"], r["shard"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"]) for r in sharded.collect())
