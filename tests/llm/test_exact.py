import hashlib
from collections import defaultdict

from peerwatch.llm import exact

ROWS = [
    (1, "a b", "en", "s0"), (2, "a b", "en", "s1"), (3, "a  b", "en", "s0"), (4, None, "en", None), (5, "", "en", "s0"),
    (6, "x" * 300_000, "en", "s0"), (7, "x" * 300_000, "en", "s0"), (8, "A b", "en", "s0"), (None, "a b", "en", "s0"),
    (9, "dup", "en", "s0"), (9, "dup", "en", "s0"), (None, "only null", "en", "s0"),
]


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    out = []
    for row in rows:
        ids = groups[row[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((row[0], keep, len(ids), keep is None or row[0] == keep, hashlib.sha256((row[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_equal_brute_force(docs_of):
    got = exact.exact_groups(docs_of(ROWS).repartition(5))
    wanted = [(a, b, c, bool(d) if a is not None or b is None else None, e) for a, b, c, d, e in brute(ROWS)]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert [(r[0], r[1], r[2], r[4]) for r in found] == [(r[0], r[1], r[2], r[4]) for r in wanted]
    assert all(bool(r[3]) == bool(w[3]) for r, w in zip(found, wanted))


def test_hot_text_sends_few_rows(spark):
    many = spark.range(20_000, numPartitions=16).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text"
    )
    got = exact.exact_groups(many).where("kept")
    assert got.count() == 20_000 - 6667 + 1
    assert got.where("group_size > 1").collect()[0]["group_size"] == 6667


def test_empty_table(docs_of):
    assert exact.exact_groups(docs_of([])).collect() == []
    assert exact.drop_exact(docs_of([])).collect() == []


def test_drop_keeps_columns_of_any_name(spark):
    rows = [(1, "t", 5, {"k": 1}), (2, "t", 6, {"k": 2}), (2, "t", 6, {"k": 2}), (3, None, 7, None), (4, "u", None, {"k": 4})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest int, `row` map<string,int>")
    got = exact.drop_exact(docs)
    assert got.columns == docs.columns and got.schema["text"].dataType == docs.schema["text"].dataType
    assert sorted((r["doc_id"], r["text"], r["digest"]) for r in got.collect()) == [(2, "t", 6), (3, None, 7), (4, "u", None)]


def test_texts_under_one_digest_stay_apart(docs_of, monkeypatch):
    real = exact._combine

    def colliding(rows, winner, salts):
        from pyspark.sql import functions as F

        return real(rows, winner, salts).withColumn("digest", F.lit("same"))

    docs = docs_of([(1, "a", "", ""), (2, "b", "", ""), (3, "a", "", "")])
    monkeypatch.setattr(exact, "_combine", colliding)
    monkeypatch.setattr(exact, "DIGEST", "'same'")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.exact_groups(docs).collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]
