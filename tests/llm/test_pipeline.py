import zlib

import pytest

import corpus_pipeline
from peerwatch.llm import queries
from llm.test_packing import held
from llm.test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Rows after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        out.append(docs.collect())
    return out


def test_quality_keeps_clean_documents(steps, spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1]}
    held_out = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in kept) == (labels[i] == 1) for i in held_out) / len(held_out) > 0.9
    assert set(steps[1]) <= set(steps[0])


def test_exact_keeps_the_largest_id_of_each_text(steps):
    largest = {}
    for r in steps[1]:
        largest[r["text"]] = max(r["doc_id"], largest.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(largest.values()) and set(steps[2]) <= set(steps[1])


def test_near_keeps_one_of_each_component(steps):
    prints = {r["doc_id"]: brute_print(r["text"]) for r in steps[2]}
    root = brute_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert sorted(r["doc_id"] for r in steps[3]) == sorted(least.values()) and set(steps[3]) <= set(steps[2])


def test_mix_repeats_whole_rows(steps):
    assert set(steps[4]) <= set(steps[3]) and steps[4][0].__fields__ == steps[0][0].__fields__
    assert max(steps[4].count(r) for r in set(steps[4])) <= 3


def test_pack_holds_every_token(steps):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [r.asDict() for r in steps[5]]
    counts = {}
    for r in steps[4]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    copies = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        p["ids_crc32"] = zlib.crc32(p["ids"])
        number = copies[p["doc_id"], p["start"]] = copies.get((p["doc_id"], p["start"]), -1) + 1
        p["doc_id"] = (p["doc_id"], number)
    texts = {r["doc_id"]: r["text"] for r in steps[4]}
    ids = {i: [*encode.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    held(pieces, {(i, n): ids[i] for i, c in counts.items() for n in range(c)}, 1024)
    assert all(np.frombuffer(p["ids"], "<u4").size == p["length"] for p in pieces)


def test_run_is_the_stages_in_turn(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == len(steps[-1])


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (2, "", "en", "s", 0, 2), (None, "the and of to in it", "en", None, 5, 3), (4, "w " * 50_000, "en", "s", 9, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row int")
    for name, step in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
    assert docs.count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
