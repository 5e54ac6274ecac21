import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from peerwatch.llm import packing

TEXTS = [
    "Hello world, it's 42!", "", None, " leading", "trailing ", "two  spaces", "line\nbreak \n mix\t tab\r\n", "a\x00b c",
    "x" * 3000, "y " * 4000, "<|endoftext|> inside", "naïve café — ünïcödé 日本語 text", " nbsp em 　wide", "'s 't re've",
    "\x1c file sep \x85 nel", "🎉 emoji🎉s", " ", "\n\n\n", "9" * 1500, "don't STOP!!! $$$ ### a_b-c",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(reference):
    encode = packing.Encoder()
    for text in [t or "" for t in TEXTS] * 2:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, text


def test_encoder_forgets_and_goes_on(reference, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    text = " ".join(f"word{i}" for i in range(50))
    assert np.frombuffer(packing.Encoder()(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def held(pieces, ids_of, window):
    """Every id in one piece, offsets gapless, no sequence over the window; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids_of)
    for doc_id, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids_of[doc_id])
            part = np.array(ids_of[doc_id][at : at + p["length"]], "<u4")
            assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids_of[doc_id])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return 1 - sum(map(len, ids_of.values())) / (window * len(by_sequence)) if by_sequence else 0


def test_documents_packed(docs_of, reference):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(100 + i, "word " * (i * 7 % 900), "en", "s") for i in range(300)]
    got = packing.pack_digests(docs_of(rows).repartition(3)).collect()
    ids_of = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _, _ in rows}
    assert held(got, ids_of, 1024) < 0.02


def test_small_groups_meet_again(docs_of, reference, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    draw = np.random.default_rng(5)
    rows = [(i, "word " * int(n), "en", "s") for i, n in enumerate(draw.integers(0, 1500, 600))]
    rows += [(1000 + i, "the hot one " * 100, "en", "s") for i in range(300)]
    ids_of = {i: [*reference.encode(t, add_special_tokens=False).ids, 0] for i, t, _, _ in rows}
    got = packing.pack_digests(docs_of(rows).repartition(7))
    assert held(got.collect(), ids_of, 1024) < 0.08
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_only_open_sequences_are_shuffled(spark, monkeypatch):
    lengths = [3, 5] * 200 + [7, 7, 6]
    table = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "nth int, length bigint, open string").coalesce(1)
    dealt = []
    place = packing._place
    monkeypatch.setattr(packing, "_place", lambda pieces, *how: dealt.append(pieces.count()) or place(pieces, *how))
    got = packing.pack(table, 8).collect()
    assert dealt == [403, 3] and {r["open"] for r in got} == {"x"}
    assert sorted(r["nth"] for r in got) == list(range(403)) and len({r["sequence_id"] for r in got}) == 203


def test_ids_come_with_the_pieces(docs_of, reference):
    got = packing.pack_documents(docs_of([(1, "one two", "en", "s"), (None, "three", "en", "s"), (1, "one two", "en", "s")])).collect()
    assert sorted((r["doc_id"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == sorted(
        (i, tuple([*reference.encode(t).ids, 0])) for i, t in ((1, "one two"), (0, "three"), (1, "one two"))
    )


def test_empty_table(docs_of):
    assert packing.pack_digests(docs_of([])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_takes_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    histogram = np.zeros(65, np.int64)
    np.add.at(histogram, draw.integers(1, 65, 500) if seed else np.full(500, 7), 1)
    chosen = packing.plan(histogram, 64)
    used = np.zeros(65, np.int64)
    for lengths, times in chosen:
        assert sum(lengths) <= 64 and times > 0
        np.add.at(used, list(lengths), times)
    assert (used == histogram).all()
    places = packing.Places(chosen, 64)
    seen = set()
    for length in np.nonzero(histogram)[0]:
        sequence, offset = places(np.full(histogram[length], length), np.arange(histogram[length]))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            cells = {(s, x) for x in range(o, o + length)}
            assert not cells & seen
            seen |= cells
    assert len(seen) == (histogram * np.arange(65)).sum()


def test_repeats_solve_least_squares():
    options = [(3, 1), (2, 2), (2, 1, 1)]
    histogram = np.array([0, 50_000, 40_000, 30_000, 0])
    x = packing.fit_repeats(histogram, options)
    a = np.array([[1, 0, 2], [0, 2, 1], [1, 0, 0]], float)
    gradient = a.T @ (a @ x - histogram[1:4])
    assert (x >= 0).all() and (np.abs(gradient[x > 1e-9]) < 10).all() and (gradient[x <= 1e-9] > -10).all()


def test_repeats_settle_with_a_hot_length():
    draw = np.random.default_rng(1)
    histogram = np.bincount(np.where(np.arange(9000) % 3, draw.integers(1, 256, 9000), 180), minlength=257)
    options = packing.combinations(histogram, 256)
    x = packing.fit_repeats(histogram, options)
    left = histogram.astype(float)
    for c, n in zip(options, x):
        for length in c:
            left[length] -= n
    steps = [max(-n, sum(left[length] for length in c) / sum(c.count(length) for length in c)) for c, n in zip(options, x)]
    assert (x >= 0).all() and max(map(abs, steps)) < 0.5 + 1e-6
    assert packing.fit_repeats(histogram, []).tolist() == []
