import zlib

import pytest
from pyspark.sql import functions as F

from peerwatch.llm import quality

GOOD = "the river runs under old bridges where people walk in the evening"
BAD = "BUY!! NOW!! $$$ click### cheap%%% deal!! &&&"


def made(n):
    rows = []
    for i in range(n):
        words = (GOOD if i % 3 else BAD).split()
        rows.append((i, " ".join(words[(i * 7 + k) % len(words)] for k in range(5 + i % 20)), "en", "s"))
    return rows


@pytest.fixture(scope="module")
def fitted(docs_of, spark):
    docs = docs_of(made(600))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(None, 1, 0), (5, None, 0), (99999, 1, 0)], "doc_id bigint, quality int, toxic int")
    return docs, labels, quality.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, _, model = fitted
    got = model.scores(docs).collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] >= 500]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held) / len(held) >= 0.95


def test_held_out_labels_teach_nothing(fitted, spark):
    docs, labels, model = fitted
    flipped = labels.rdd.map(lambda r: (r[0], 1 - r[1] if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[1], r[2]))
    again = quality.fit(docs, spark.createDataFrame(flipped, labels.schema))
    assert (again.weights == model.weights).all()


def test_reruns_agree_on_any_partitioning(fitted):
    docs, labels, model = fitted
    assert (quality.fit(docs.repartition(7), labels.repartition(3)).weights == model.weights).all()


def test_scores_see_texts_only(fitted, docs_of):
    _, _, model = fitted
    rows = [(1, GOOD, "en", "s"), (7, GOOD, None, None), (3, None, "en", "s"), (4, "", "en", "s"), (5, BAD * 20_000, "en", "s"), (1, GOOD, "en", "s")]
    got = sorted((r["doc_id"], r["score"]) for r in model.scores(docs_of(rows)).collect())
    score = dict(got)
    assert len(got) == 6 and score[1] == score[7] and score[3] == score[4] and score[5] < 0.5 < score[1]


def test_keep_returns_rows_as_they_were(fitted, spark):
    _, _, model = fitted
    docs = spark.createDataFrame([(1, 0.1, GOOD, [1]), (2, 0.9, BAD, None), (3, None, GOOD, [])], "doc_id bigint, score double, text string, w array<int>")
    got = model.keep(docs)
    assert got.schema == docs.schema and sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_without_examples(docs_of, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(docs_of(made(3)), none)
    assert [r["score"] for r in model.scores(docs_of(made(3))).collect()] == [0.5] * 3
    assert quality.fit(docs_of([]), none).scores(docs_of([])).collect() == []


def test_fold_is_the_crc_of_the_id(spark):
    got = spark.range(50).select("id", quality.fold(F.col("id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)


def plain_ftrl(examples, slots, epochs):
    """FTRL-proximal as published, one coordinate at a time on plain numbers."""
    import math

    z, n = [0.0] * slots, [0.0] * slots

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * quality.L1) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for at, values, label in examples:
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, values))))
            for i, v in zip(at, values):
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(slots)]


def test_weights_and_scores_equal_a_plain_form(docs_of, spark, monkeypatch):
    """One learner over a small table: the same weights and scores as by hand, from text to score."""
    import math

    import numpy as np

    slots, rows = 512, [r for r in made(60)] + [(100, "", "en", "s"), (101, None, "en", "s")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels, learners=1, slots=slots)

    def plain_example(text):
        counts = {}
        found = quality.grams(text or "", quality._Slots(), slots).tolist()
        for slot in found:
            counts[slot] = counts.get(slot, 0) + 1
        at = [0, *sorted(counts)]
        return at, [1.0] + [float(np.float32(counts[i] / math.sqrt(len(found)))) for i in at[1:]]

    # Spark's hash of a long, to deal the rows in the operator's order.
    order = {r["k"]: r["h"] for r in spark.createDataFrame([(i,) for i, *_ in rows], "k bigint").select("k", F.xxhash64("k").alias("h")).collect()}
    taught = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1), key=lambda r: order[r[0]])
    weights = plain_ftrl([(*plain_example(t), i % 2) for i, t, *_ in taught], slots, quality.EPOCHS)
    np.testing.assert_allclose(model.weights, weights, rtol=1e-9, atol=1e-12)
    got = {r["doc_id"]: r["score"] for r in model.scores(docs).collect()}
    for i, text, *_ in rows:
        at, values = plain_example(text)
        margin = sum(weights[a] * v for a, v in zip(at, values))
        assert abs(got[i] - 1 / (1 + math.exp(-margin))) < 1e-6
