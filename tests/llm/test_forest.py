import numpy as np
import pytest

from peerwatch.llm import forest


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def found(spark, rows, queries, **how):
    table = frame(spark, rows)
    index = forest.stage(forest.build_index(table, block=how.pop("block", forest.BLOCK_ROWS)), "index")
    got = {}
    for r in forest.search(index, frame(spark, queries), "float", **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in got.items()}


def brute(rows, key, vector, k=10):
    v = np.array(vector, np.float32).astype(float)
    far = [(float(np.sqrt(((np.array(x, np.float32).astype(float) - v) ** 2).sum())), i) for i, x, _ in rows if i is not None and i != key and x is not None and len(x) == len(v) and sound(x)]
    return sorted(far)[:k]


def sound(x):
    return all(c is not None and np.isfinite(c) for c in x) and any(c != 0 for c in x)


@pytest.fixture(scope="module")
def clusters():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(10, 32))
    v = centres[draw.integers(0, 10, 1200)] * 0.6 + draw.normal(size=(1200, 32))
    return [(i, x.tolist(), 0) for i, x in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize("block", [300, 4096])
def test_recall_and_scores(spark, clusters, block):
    queries = [r for r in clusters if r[0] % 50 == 0]
    got = found(spark, clusters, queries, block=block)
    hits = 0
    for key, vector, _ in queries:
        want = brute(clusters, key, vector)
        assert [rank for rank, _, _ in got[key]] == list(range(1, 11))
        assert [(s, i) for _, i, s in got[key]] == sorted((s, i) for _, i, s in got[key])
        exact = {i: s for s, i in brute(clusters, key, vector, 4000)}
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in got[key])
        hits += len({i for _, i in want} & {i for _, i, _ in got[key]})
    assert hits / (10 * len(queries)) >= 0.9


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [], 0),
            (7, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [0.5, 0.5], 0), (10, [1.0, 2.0, 3.0], 0), (None, [1.0, 0.0], 0), (9, [0.5, 0.5], 0), (100, [0.0, 0.0], 0)]
    queries = [rows[0], (100, [0.0, 0.0], 0), (200, None, 0), (10, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0)]
    got = found(spark, rows, queries)
    assert {q: [(i, round(s, 9)) for _, i, s in x] for q, x in got.items()} == {0: [(7, 0.0), (8, 0.0), (9, round(0.5**0.5, 9)), (9, round(0.5**0.5, 9))]}


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(500, 0, -1)]
    got = found(spark, rows, [rows[-1]], block=64)
    assert [i for _, i, _ in got[1]] == list(range(2, 12))


def test_queries_in_chunks(spark, clusters):
    queries = [r for r in clusters if r[0] % 400 == 0]
    assert found(spark, clusters[:1000], queries, chunk=3) == found(spark, clusters[:1000], queries)


def test_empty_tables(spark, clusters):
    assert found(spark, [], clusters[:1]) == {} and found(spark, clusters[:100], []) == {}


def test_slices_are_longest_common_prefixes():
    draw = np.random.default_rng(2)
    trees = np.sort(draw.integers(0, 1 << 63, (3, 200)).astype(np.uint64) * np.uint64(2), axis=1)
    asked = trees[:, :20] ^ draw.integers(0, 1 << 40, (3, 20)).astype(np.uint64)

    def prefix(a, b):
        return 64 - int(a ^ b).bit_length()

    first, last = forest.slices(trees, asked, forest.ascend(forest.entries(trees, asked), 30))
    for q in range(20):
        for length in range(64, -1, -1):
            held = [[i for i in range(200) if prefix(int(trees[t, i]), int(asked[t, q])) >= length] for t in range(3)]
            if sum(map(len, held)) >= 30:
                break
        assert forest.common_prefix(trees[0], asked[0, q]).tolist() == [prefix(int(s), int(asked[0, q])) for s in trees[0]]
        assert [list(range(first[t, q], last[t, q])) for t in range(3)] == held


def test_entries_add_up_over_blocks(spark, clusters):
    queries = [r for r in clusters if r[0] % 100 == 0]
    asked = forest._asked(frame(spark, queries).selectExpr("vec_id id", "cast(embedding as array<double>) v").toArrow(), 12)
    counts = []
    for block in (170, 4096):
        index = forest.stage(forest.build_index(frame(spark, clusters), block=block), "index")
        counts.append(forest._counts(forest._count(index, lambda: asked, 12, np.float32), 32, asked[32][0]))
    assert (counts[0] == counts[1]).all() and (counts[0][:, 0] == 12 * (len(clusters) - 1)).all()


def test_share_falls_as_a_clustered_table_grows(spark):
    draw = np.random.default_rng(8)
    shares = []
    for size in (2_000, 16_000):
        centres = draw.normal(size=(size // 25, 24))
        v = (np.repeat(centres, 25, axis=0) + 0.05 * draw.normal(size=(size, 24))).astype(np.float32)
        rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
        index = forest.stage(forest.build_index(frame(spark, rows), block=1000), "index")
        asked = frame(spark, rows[:: size // 40]).selectExpr("vec_id id", "cast(embedding as array<double>) v")
        shares.append(forest.budgets(index, asked, np.float32)[24] / (forest.TREES * size))
        got = {}
        for r in forest.search(index, frame(spark, rows[:: size // 40]), "float").collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = sum(len({i for _, i in brute(rows, key, vector)} & got[key]) for key, vector, _ in rows[:: size // 40])
        assert hits >= 0.9 * 10 * len(got) and len(got) == 40
    assert shares[1] < shares[0] / 4


def test_one_chunk_is_held_at_a_time(spark, clusters, monkeypatch):
    from pyspark import Broadcast, SparkContext

    events = []
    make, drop = SparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: events.append(sum(len(x[0]) for x in value.values())) or make(self, value))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: events.append("gone") or drop(self, *a))
    queries = [r for r in clusters if r[0] % 60 == 0]
    got = found(spark, clusters, queries, chunk=5)
    assert len(got) == len(queries) and sum(events[::2]) == len(queries)
    assert len(events) >= 8 and set(events[1::2]) == {"gone"}


def test_candidates_repeated_under_one_id_fill_ranks(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2), (1, [1.0, 0.2], 3), (2, [0.0, 1.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    index = forest.stage(forest.build_index(df), "index")
    got = forest.search(index, df.where("vec_id = 0"), "double", k=3).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 1), (3, 2)]
    none = forest.stage(forest.build_index(df.limit(0)), "index")
    assert forest.search(none, df.limit(0), "double").collect() == []
