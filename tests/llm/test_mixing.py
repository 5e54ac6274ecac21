import re

import pytest

from peerwatch.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), rate=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(rate * sizes[s] for s in capped)
        if not open_:
            return {s: rate * sizes[s] for s in names}
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if rate * sizes[s] <= weight[s] * level]
        if not over:
            return {s: rate * sizes[s] if s in capped else weight[s] * level for s in names}
        capped.update(over)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 50, None: 3, "é": 70, "Z": 0},
    {"a": 1, "b": 1, "c": 1000},
    {None: 5},
    {"a": 0, "b": 0},
])
def test_targets_equal_brute_force(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r for r in mixing.source_targets(rows).collect()}
    for source, target in brute_targets(sizes).items():
        assert got[source]["target"] == pytest.approx(target)
        assert got[source]["rate"] <= 3
    assert sum(r["target"] for r in got.values()) == pytest.approx(sum(sizes.values()))


def test_counts(docs_of, spark):
    rows = [(i, " ".join(["w"] * (i % 40)), "en", None if i % 10 == 0 else f"s{i % 3}") for i in range(3000)]
    rows += [(9001, None, "en", "s0"), (9002, "a\x0b b\tc", "en", "s0"), (9003, "x " * 50_000, "en", "s1"), (9004, "", "en", "new")]
    docs = docs_of(rows)
    got = {r["doc_id"]: r for r in mixing.mix_counts(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, _ in rows:
        assert got[doc_id]["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert 0 <= got[doc_id]["copies"] <= 3
    sizes = {}
    for doc_id, _, _, source in rows:
        sizes[source] = sizes.get(source, 0) + got[doc_id]["size"]
    wanted = brute_targets(sizes)
    taken = {}
    for doc_id, _, _, source in rows:
        r = got[doc_id]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(wanted[source])
        taken[source] = taken.get(source, 0) + r["size"] * r["copies"]
    assert all(abs(taken[s] - wanted[s]) <= 0.03 * wanted[s] for s in ("s0", "s2", None))
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs.repartition(7)).collect()}
    assert again == {k: r["copies"] for k, r in got.items()}


def test_mix_repeats_rows_with_their_columns(docs_of):
    docs = docs_of([(i, f"a b {i}", "en", f"s{i % 4}", i) for i in range(50)], ", copies int")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    seen = {}
    for r in got.collect():
        assert r["copies"] == r["doc_id"] and r["text"] == f"a b {r['doc_id']}"
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: n for k, n in copies.items() if n}


def test_empty_table(docs_of):
    assert mixing.mix_counts(docs_of([])).collect() == [] and mixing.mix(docs_of([])).collect() == []
