import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peerwatch.functions.special import average_path
from peerwatch.operators import isolation


def frame(spark, n, parts=4, outlier=True):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"entity_id": np.arange(n), "log_total": rng.normal(5, 1, n), "rate": rng.beta(2, 5, n)})
    if outlier:
        pdf.loc[0, ["log_total", "rate"]] = [14.0, 1.0]
    return spark.createDataFrame(pdf).withColumn("month", F.lit("2020-01-01").cast("date")).repartition(parts)


@pytest.fixture(scope="module")
def fitted(spark):
    df = frame(spark, 1500).cache()
    return df, isolation.fit(df, trees=30, psi=64)


def test_forest_shape(fitted):
    _, forest = fitted
    nodes = forest.nodes.toPandas()
    assert forest.height == 6 and nodes["tree"].nunique() == 30
    assert not nodes.duplicated(["tree", "node"]).any()
    assert (nodes.groupby("tree").size() <= 2 * 64 - 1).all()
    assert np.floor(np.log2(nodes["node"])).max() <= 6
    leaves = nodes[nodes["feature"] < 0]
    assert (leaves.groupby("tree")["n"].sum() == 64).all()
    index = nodes.set_index(["tree", "node"])
    for _, split in nodes[nodes["feature"] >= 0].head(200).iterrows():
        left, right = (index.loc[(split["tree"], 2 * split["node"] + side)] for side in (0, 1))
        assert left["n"] + right["n"] == split["n"] and left["n"] > 0 and right["n"] > 0


def test_same_data_and_seed_give_the_same_forest(spark, fitted):
    _, forest = fitted
    again = isolation.fit(frame(spark, 1500, parts=11), trees=30, psi=64).nodes.toPandas()
    key = ["tree", "node"]
    first = forest.nodes.toPandas().sort_values(key).reset_index(drop=True)
    again = again.sort_values(key).reset_index(drop=True)
    assert (first[["tree", "node", "feature", "n"]].to_numpy() == again[["tree", "node", "feature", "n"]].to_numpy()).all()
    np.testing.assert_allclose(first["threshold"], again["threshold"], rtol=1e-9)
    other = isolation.fit(frame(spark, 1500), trees=30, psi=64, seed=7).nodes.toPandas()
    assert len(other) != len(first) or not np.allclose(
        other.sort_values(key)["threshold"].fillna(0).to_numpy(), first["threshold"].fillna(0).to_numpy()
    )


def test_scores_against_a_walk_by_hand(fitted):
    df, forest = fitted
    nodes = {(r["tree"], r["node"]): r for r in forest.nodes.collect()}
    rows = isolation.score(df, forest).orderBy("entity_id").limit(25).collect()
    for row in rows:
        x = [(row[c] - m) / s for c, (m, s) in forest.scale.items()]
        depth = 0.0
        for tree in range(30):
            at = nodes[(tree, 1)]
            while at["feature"] >= 0:
                at = nodes[(tree, 2 * at["node"] + int(x[at["feature"]] > at["threshold"]))]
            depth += math.floor(math.log2(at["node"])) + average_path(at["n"])
        assert row["score"] == pytest.approx(-(2 ** (-(depth / 30) / average_path(64))), abs=1e-12)


def test_outlier_has_the_lowest_score_and_share_respects_contamination(fitted):
    df, forest = fitted
    scored = isolation.score(df, forest).cache()
    assert scored.orderBy("score").first()["entity_id"] == 0
    for contamination in (0.01, 0.05):
        flagged = isolation.apply_threshold(scored, contamination)
        share = flagged.where("flag_forest").count() / 1500
        assert 0 < share <= contamination
        assert flagged.where("flag_forest <> (if_label = -1)").count() == 0
        assert flagged.where("if_intensity <> -if_decision").count() == 0


def test_each_tree_draws_distinct_rows(spark):
    df = frame(spark, 300)
    rows, psi = isolation.training_rows(df, ("log_total", "rate"), 20, 64, 42)
    drawn = rows.toPandas()
    assert psi == 64 and (drawn.groupby("tree").size() == 64).all() and drawn["tree"].nunique() == 20
    assert not drawn.duplicated(["tree", "log_total", "rate"]).any()


@pytest.mark.parametrize("n", [10, 100, 5000])
def test_trees_draw_from_all_rows_by_one_scheme(spark, n):
    """More rows than trees x psi, and fewer: the places in hash order are those drawn by hand."""
    from peerwatch.functions.columns import fold32_int

    df = frame(spark, n, outlier=False)
    rows, psi = isolation.training_rows(df, ("log_total", "rate"), 6, 16, 42)
    assert psi == min(16, n)
    ranked = df.toPandas()
    ranked["h"] = [fold32_int(e, 2020 * 12 + 1, 42) for e in ranked["entity_id"]]
    ranked = ranked.sort_values(["h", "entity_id"]).reset_index(drop=True)
    drawn = rows.toPandas()
    for tree in range(6):
        want = ranked.loc[isolation.draw_places(tree, psi, n, 42), "log_total"].sort_values().tolist()
        assert drawn.loc[drawn["tree"] == tree, "log_total"].sort_values().tolist() == want


def test_large_buckets_are_looked_into(spark, monkeypatch):
    """Few bits at first, so that buckets are large: the same draws, and few rows are shuffled and ranked."""
    df = frame(spark, 6000, outlier=False)
    want = sorted(map(tuple, isolation.training_rows(df, ("log_total", "rate"), 5, 8, 42)[0].collect()))
    looked = []
    closer = isolation._Drawn.closer
    monkeypatch.setattr(isolation._Drawn, "closer", lambda self, hashed: looked.append(closer(self, hashed)) or looked[-1])
    monkeypatch.setattr(isolation, "BUCKET_BITS", 2)
    rows, _ = isolation.training_rows(df, ("log_total", "rate"), 5, 8, 42)
    assert sorted(map(tuple, rows.collect())) == want and len(want) == 40
    assert [d.bits for d in looked][:2] == [6, 10] and looked[-1].rows_to_rank() <= isolation.ROWS_PER_PLACE * 40
    last = looked[-1]
    hashed = isolation._hashed(df, ("log_total",), 42)
    assert last.only(hashed).count() == last.rows_to_rank()


def test_only_rows_of_drawn_buckets_are_shuffled(spark):
    """The filter lies under the ranking, so before the shuffle, and leaves a small multiple of trees x psi rows."""
    df = frame(spark, 20_000, outlier=False)
    kept = []
    only = isolation._Drawn.only
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(isolation._Drawn, "only", lambda self, hashed: kept.append(only(self, hashed)) or kept[-1])
        rows, psi = isolation.training_rows(df, ("log_total", "rate"), 4, 32, 42)
    assert rows.count() == 4 * psi == 128 and kept[-1].count() <= isolation.ROWS_PER_PLACE * 128
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Window")


def test_places_are_even_over_all_rows():
    places = np.array([isolation.draw_places(tree, 50, 1000, 7) for tree in range(400)])
    assert (places >= 0).all() and (places < 1000).all() and all(len(set(p)) == 50 for p in places.tolist())
    counts = np.bincount(places.ravel() // 100, minlength=10)
    assert abs(counts - 2000).max() < 200


def test_all_trees_draw_as_each_does():
    every = isolation.draw_all(7, 20, 500, 42)
    assert every.tolist() == [isolation.draw_places(tree, 20, 500, 42) for tree in range(7)]


def test_rows_without_a_key_are_not_drawn(spark):
    df = frame(spark, 30, outlier=False)
    df = df.unionByName(df.limit(5).withColumns({"month": F.lit(None).cast("date"), "rate": F.lit(9.0)}))
    rows, psi = isolation.training_rows(df, ("log_total", "rate"), 3, 64, 42)
    assert psi == 30 and rows.where("rate = 9").count() == 0


def test_repeated_keys_share_a_hash(spark):
    """All bits looked at, still several rows in a bucket: ranked there."""
    df = frame(spark, 400, outlier=False).withColumn("entity_id", F.col("entity_id") % 3)
    rows, psi = isolation.training_rows(df, ("log_total",), 2, 8, 42)
    assert psi == 8 and rows.count() == 16


def test_boxes_cover_the_space_once(fitted):
    _, forest = fitted
    boxes = isolation.leaf_boxes(forest)
    rng = np.random.default_rng(1)
    for x, y in rng.normal(0, 2, (200, 2)):
        inside = boxes[(boxes["low_0"] < x) & (x <= boxes["high_0"]) & (boxes["low_1"] < y) & (y <= boxes["high_1"])]
        assert sorted(inside["tree"]) == list(range(30))


@pytest.mark.parametrize("cells", [1, 5, 64])
def test_boxes_score_as_arrays_do(fitted, cells):
    df, forest = fitted
    by_arrays = {r["entity_id"]: r["score"] for r in isolation.score(df, forest).collect()}
    boxed = isolation.score_by_boxes(df, forest, cells=cells)
    got = {r["entity_id"]: r["score"] for r in boxed.collect()}
    assert got.keys() == by_arrays.keys() and all(abs(got[k] - by_arrays[k]) <= 1.1e-12 for k in got)
    plan = boxed._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_boxes_of_odd_values(spark, fitted):
    """Edges belong to the left box; NULL and NaN go left; values beyond all edges have a box."""
    df, forest = fitted
    (m0, s0), (m1, s1) = forest.scale["log_total"], forest.scale["rate"]
    edges = forest.table[forest.table["feature"] == 0]["threshold"].head(20)
    values = [(float(e) * s0 + m0, 0.3) for e in edges] + [(None, 0.2), (3.0, None), (float("nan"), 0.1), (1e9, -1e9), (None, None)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)] + [(0, *values[0])], "entity_id bigint, log_total double, rate double")
    one = sorted((r["entity_id"], r["score"]) for r in isolation.score(rows, forest).collect())
    two = sorted((r["entity_id"], r["score"]) for r in isolation.score_by_boxes(rows, forest).collect())
    assert [i for i, _ in one] == [i for i, _ in two] and np.allclose([v for _, v in one], [v for _, v in two], atol=1.1e-12, rtol=0)


def test_a_forest_of_single_leaves_and_an_empty_table(spark):
    df = frame(spark, 50).withColumns({"log_total": F.lit(1.0), "rate": F.lit(0.5)})
    forest = isolation.fit(df, trees=4)
    assert isolation.score_by_boxes(df, forest).select("score").distinct().collect() == isolation.score(df, forest).select("score").distinct().collect()
    assert isolation.score_by_boxes(df.limit(0), forest).collect() == []


def test_fewer_rows_than_a_sample(spark):
    df = frame(spark, 40, outlier=False)
    forest = isolation.fit(df, trees=5)
    assert forest.psi == 40 and forest.height == 6
    assert isolation.score(df, forest).where("score > -1 AND score < 0").count() == 40


def test_constant_rows_are_one_leaf(spark):
    df = frame(spark, 50).withColumns({"log_total": F.lit(1.0), "rate": F.lit(0.5)})
    forest = isolation.fit(df, trees=4)
    assert forest.nodes.count() == 4
    assert isolation.detect(df, trees=4).where("flag_forest").count() == 0


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """A session started elsewhere, whose workers cannot import the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession, functions as F\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from peerwatch.operators import isolation\n"
        "df = spark.range(300).select(F.col('id').alias('entity_id'), F.lit('2020-01-01').cast('date').alias('month'),"
        " F.log1p('id').alias('log_total'), (F.col('id') % 7 / 7).alias('rate'))\n"
        "print('scored', isolation.score(df, isolation.fit(df, trees=4)).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "scored 300" in done.stdout, done.stderr[-2000:]
