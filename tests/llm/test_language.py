import unicodedata
import zlib

import numpy as np
import pytest

from peerwatch.llm import language

WORDS = {
    "en": "the and of with that was they from this water house people mother through would",
    "de": "der und von mit dass war sie aus diese wasser haus leute mutter durch würde",
    "nl": "de en van met dat was zij uit deze water huis mensen moeder door zou",
    "fr": "le et de avec que était ils depuis cette eau maison gens mère travers serait",
    "es": "el y de con que era ellos desde esta agua casa gente madre través sería",
    "ja": "これ は 水 家 人々 母 から です ある その 私 日本 語 本 山",
}


def made(n, seed=0, languages=tuple(WORDS)):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = languages[int(rng.integers(len(languages)))]
        words = WORDS[lang].split()
        rows.append((i, " ".join(rng.choice(words, 4 + i % 30)), lang, "s"))
    return rows


@pytest.fixture(scope="module")
def fitted(docs_of):
    rows = made(900)
    return rows, language.fit(docs_of(rows))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(fitted, docs_of):
    rows, model = fitted
    assert sorted(map(sorted, model.families)) == [["de", "en", "nl"], ["es", "fr"], ["ja"]]
    assert sorted(model.pairs) == [("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")]
    got = {r["doc_id"]: r for r in model.predictions(docs_of(rows)).collect()}
    want = {i: lang for i, _, lang, _ in rows if held_out(i)}
    assert sum(got[i]["lang_pred"] == lang for i, lang in want.items()) / len(want) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_query_accuracy(spark, sf_dir):
    got = language.op13_language_svm(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98


def test_held_out_rows_and_other_columns_teach_nothing(fitted, docs_of):
    rows, model = fitted
    changed = [(i, t, "xx" if held_out(i) else lang, None) for i, t, lang, _ in rows] + [(5000, "quite other words", None, "s")]
    again = language.fit(docs_of(changed).repartition(7))
    assert again.families == model.families and (again.chance == model.chance).all()
    assert all((again.pairs[p] == w).all() for p, w in model.pairs.items())


def test_sample_bounds_each_language(docs_of):
    rows = made(600, languages=("en", "de")) + [(10_000 + i, "solo una palabra", "es", "s") for i in range(3)]
    model = language.fit(docs_of(rows), sample=20)
    assert sorted(sum(model.families, [])) == ["de", "en", "es"]
    got = model.predictions(docs_of(rows)).collect()
    assert sum(r["lang_pred"] == rows[i][2] for i, r in enumerate(sorted(got, key=lambda r: r["doc_id"]))) / len(rows) > 0.9


def test_odd_texts(fitted, docs_of):
    _, model = fitted
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 34 -- !!", "en", "s"), (4, "the water and the people", None, None), (4, "the water and the people", "de", "x"), (None, "das wasser und die leute", "fr", "s"), (6, "der und von mit " * 100_000, "en", "s")]
    got = model.predictions(docs_of(rows)).collect()
    found = sorted(((r["doc_id"] or 0), r["lang_pred"]) for r in got)
    assert found == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (6, "de")]
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}


def test_models_of_few_languages(docs_of):
    texts = docs_of([(i, "some words", None, "s") for i in range(4)])
    none = language.fit(docs_of([]))
    assert {(r["lang_pred"], r["score"]) for r in none.predictions(texts).collect()} == {("und", 0.0)}
    assert none.predictions(docs_of([])).collect() == []
    assert language.fit(texts).families == []
    one = language.fit(docs_of([(i, "some words", "en", "s") for i in range(9)]))
    assert {r["lang_pred"] for r in one.predictions(texts).collect()} == {"en"}


def test_extra_columns_and_other_names(spark):
    rows = [(i, t, lang, 1, "x") for i, t, lang, _ in made(200, languages=("en", "fr"))]
    df = spark.createDataFrame(rows, "key bigint, body string, tongue string, score int, lang_pred string")
    model = language.fit(df, lang_col="tongue", id_col="key", text_col="body")
    got = model.predictions(df, "key", "body")
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == 200


def brute_counts(text, grams):
    """n-grams one by one."""
    line = "".join(c if c.isalpha() else " " for c in unicodedata.normalize("NFC", text.lower()))
    line = " " + " ".join(line.split()) + " "
    total = np.zeros(grams.slots, np.int64)
    for n in language.GRAMS:
        for a in range(len(line) - n + 1):
            if n > 1 or line[a] != " ":
                total += one_gram([ord(c) for c in line[a : a + n]], grams)
    return total


def one_gram(codes, grams):
    """Slot of one n-gram, by whole numbers."""
    mask, mixed = (1 << 64) - 1, 0
    for k, c in enumerate(codes, 1):
        mixed = (mixed * 0x9E3779B97F4A7C15 + c + k) & mask
    spread = ((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9) & mask
    out = np.zeros(grams.slots, np.int64)
    out[(spread >> 40) % grams.slots] = 1
    return out


@pytest.mark.parametrize("text", ["a", "Das ist, ein Haus.", "  È vrai!! x ", "ab" * 9, "1 b 2 c"])
def test_counts_equal_brute_force_in_any_stretch(text, monkeypatch):
    grams = language.Grams(512)
    want = brute_counts(text, grams)
    for stretch in (1 << 20, 4, 7):
        monkeypatch.setattr(language, "STRETCH", stretch)
        assert (grams.counts(text) == want).all()


def test_machine_separates_and_settles():
    rng = np.random.default_rng(0)
    at = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(200)]
    sign = np.array([1.0 if a.sum() > 180 else -1.0 for a in at])
    x = [language.scaled(np.ones(8)) for _ in at]
    w = language.train_pair(at, x, sign, 50)
    assert np.mean([np.sign(w[a] @ v + w[-1]) == s for a, v, s in zip(at, x, sign)]) > 0.97


def test_families():
    assert language.family_of("de") == language.family_of("en-GB") == "germanic" and language.family_of("zz") == "=zz"
    listed = [x for members in language.FAMILIES.values() for x in members]
    assert len(listed) == len(set(listed))
