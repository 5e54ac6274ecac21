import random
import re

import numpy as np
import pytest
import xxhash

from peerwatch.llm import components, simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    label = {p: p for p in prints}

    def find(p):
        while label[p] != p:
            p = label[p]
        return p

    values = sorted(set(prints))
    array = np.array(values, np.uint64)
    for i, p in enumerate(values):
        for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= radius)[0]:
            a, b = find(p), find(values[j])
            label[max(a, b)] = min(a, b)
    return {p: find(p) for p in values}


TEXTS = [
    "One two three four", "one TWO three\tfour", "É é words like these", "", None, "  \n", "single", "two words", "a b c",
    "a b c a b c a b c", "ſ K not ascii letters", "long " * 60_000, "x\x0by\x0cz w", "one two three four five",
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint((text or "").encode()) == brute_print(text)


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("shard", [64, 4096])
def test_links_connect_as_all_pairs(spark, shard):
    draw = random.Random(5)
    centre = [draw.getrandbits(64) for _ in range(40)]
    prints = set(centre)
    for c in centre[:20]:  # chains and clouds around some
        for _ in range(60):
            p = draw.choice([c, *list(prints)[-3:]])
            for _ in range(draw.randrange(1, 5)):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    hot = centre[0] & ~((1 << 22) - 1)  # many prints that share two bands
    prints |= {hot | draw.getrandbits(22) for _ in range(300)}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    links = simhash.fingerprint_links(frame, shard=shard)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    groups = {}
    for p, root in brute_components(prints).items():
        groups.setdefault(root, []).append(signed(p))
    wanted = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
    assert got == wanted


def near_pairs(values, radius=2):
    far = np.bitwise_count(values[:, None] ^ values[None, :])
    return set(zip(*(x.tolist() for x in np.nonzero(far <= radius))))


@pytest.mark.parametrize("n, mask", [(600, 0xFFFF), (1, 1), (2, 3), (900, (1 << 63) - 1)])
def test_tree_finds_all_within_the_radius(n, mask):
    draw = np.random.default_rng(1)
    values = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64) & np.uint64(mask))
    tree = simhash.BKTree.from_bytes(simhash.BKTree.grow(values).to_bytes())
    assert sorted(tree.values.tolist()) == values.tolist()
    for i in range(1, len(values)):  # every node hangs at its distance to its parent, once
        assert tree.edge[i] == int(tree.values[i] ^ tree.values[tree.parent[i]]).bit_count()
    hung = list(zip(tree.parent[1:].tolist(), tree.edge[1:].tolist()))
    assert hung == sorted(hung) and len(set(hung)) == len(hung)
    query, node = tree.search(values, 2)
    at = np.searchsorted(values, tree.values[node])
    assert set(zip(query.tolist(), at.tolist())) == near_pairs(values) and len(query) == len(near_pairs(values))


def test_search_follows_few_edges(spark, sf_dir):
    """On the given documents: a tree has levels, and a query meets a small share of it."""
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect()
    values = np.unique(np.array([simhash.fingerprint((r["text"] or "").encode()) for r in rows], np.uint64))
    tree = simhash.BKTree.grow(values)
    query, node = tree.search(values, simhash.RADIUS)
    assert len(values) > 500 and tree.depth() >= 3
    assert tree.visited < 0.35 * len(values) ** 2
    assert len(query) == len(near_pairs(values))


def test_shards_are_near_their_size(spark):
    """Only as many bits of a band as needed; one shard where all fit."""
    assert list(simhash._cuts(0, 2, 1000, 1024)) == list(simhash._cuts(0, 2, 0, 1024)) == [0]
    cuts = simhash._cuts(0, 2, 10_000, 1024)
    assert [bin(m).count("1") for m in cuts] == [4, 4, 4] and sum(cuts.values()) == (1 << 64) - 1
    assert all(m & band == m for m, band in cuts.items())


def test_bundles_stay_within_their_bytes(spark, monkeypatch):
    draw = np.random.default_rng(3)
    values = np.unique(draw.integers(0, 1 << 63, 1000))
    values = np.unique(np.concatenate([values, values[:400] ^ 1, values[:100] ^ 6]))
    frame = spark.createDataFrame([(v,) for v in values.tolist()], "fp bigint")
    sent = []
    context = type(spark.sparkContext)
    real = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, held: sent.append(sum(map(len, held.values()))) or real(self, held))
    links = simhash.fingerprint_links(frame, shard=64, bundle_bytes=16384)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert len(sent) > 3 and max(sent) <= 16384
    groups = {}
    for p, root in brute_components([int(v) for v in values]).items():
        groups.setdefault(root, []).append(p)
    assert got == {p: min(g) for g in groups.values() if len(g) > 1 for p in g}


def test_dense_groups_tell_one_link_per_member():
    values = np.unique(np.array([1 << a | 1 << b for a in range(30) for b in range(a)], np.uint64))
    a, b = simhash.tree_links(simhash.BKTree.grow(values), values)
    assert len(a) == len(values) - 1 and len(set(b.tolist())) == 1


def test_groups_of_documents(docs_of):
    rows = [(i + 1, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, "a b c", "en", "s"), (9, "a b c", "en", "s"), (None, "alone here now", "en", "s")]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs_of(rows)).collect()), key=repr)
    prints = [brute_print(t) for _, t, _, _ in rows]
    root = brute_components(prints)
    least = {}
    for (doc_id, *_), p in zip(rows, prints):
        if doc_id is not None:
            least[root[p]] = min(doc_id, least.get(root[p], doc_id))
    wanted = sorted(((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints)), key=repr)
    assert got == wanted


def test_drop_near(docs_of):
    docs = docs_of([(3, "a b c d", "en", "s", 1), (1, "A b  c D", "en", "s", 2), (2, "other words are here", "en", "s", 3), (None, "a b c d", "en", "s", 4)], ", _dropped int")
    got = simhash.drop_near(docs)
    assert got.columns == docs.columns
    assert sorted(r["_dropped"] for r in got.collect()) == [2, 3, 4]


def test_empty_table(docs_of):
    assert simhash.near_groups(docs_of([])).collect() == [] and simhash.drop_near(docs_of([])).collect() == []


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1500)] + [(5000, 5000)] + [(-3, 7000), (7000, -3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1500)} | {-3: -3, 7000: -3}
