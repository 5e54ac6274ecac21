"""Language identification in two steps: the family first, then the language within it.

Features are character n-grams of the letters of a whole text, hashed into a
fixed number of slots. The family is found by a multinomial model over the
n-grams. Languages of one family are told apart by linear support vector
machines, one per pair of languages, each trained on these two alone; the
language with the most won pairs is the answer.

Learning is bounded: at most `SAMPLE` labelled texts of a language, those with
the smallest hash of id and text. Training texts are hashed where they lie, and
every pair is solved in a task of its own. Predicting is one pass over the table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerwatch.llm.common import ship, table, text_of
from peerwatch.llm.quality import HELD_OUT, fold
from peerwatch.sources.staging import stage

SLOTS = 1 << 16
#: Lengths of the character n-grams.
GRAMS = (1, 2, 3, 4)
#: Labelled texts of a language that are learnt from, at most.
SAMPLE = 1000
#: Characters of a text that are hashed at a time.
STRETCH = 1 << 20
#: Texts whose counts are handed over together.
HASHED_ROWS = 256
#: Penalty of a margin missed, passes over a pair's texts at most, and the change of a weight that ends them.
COST, PASSES, SETTLED = 10.0, 40, 1e-3
UNKNOWN = "und"

#: ISO 639-1 codes by language family. A language of no family listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "sd", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("ceb", "id", "jv", "mg", "ms", "su", "tl"),
}


class Grams:
    """Hashed n-gram counts of a text."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def counts(self, text: str) -> np.ndarray | None:
        """Counts per slot; None if the text has no letter.

        Letters count in lower case; everything between two runs of letters is one space, and
        n-grams of spaces alone do not occur. All of the text counts.
        """
        total, last, found = np.zeros(self.slots, np.int64), np.empty(0, np.uint64), False
        for a in range(0, len(text), STRETCH):
            part = unicodedata.normalize("NFC", text[a : a + STRETCH].lower())
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)
            letter = self.letter[codes]
            found = found or bool(letter.any())
            codes = np.where(letter, codes, np.uint64(32))
            fresh = np.concatenate((last, codes)) if len(last) else np.concatenate((np.array([32], np.uint64), codes))
            keep = np.ones(len(fresh), bool)
            keep[1:] = (fresh[1:] != 32) | (fresh[:-1] != 32)
            seam = int(np.count_nonzero(keep[: len(last)]))
            line = fresh[keep]
            if a + STRETCH >= len(text) and line[-1] != 32:
                line = np.append(line, np.uint64(32))
            self._add(total, line, seam)
            last = line[-(max(GRAMS) - 1) :]
        return total if found else None

    def _add(self, total: np.ndarray, line: np.ndarray, seam: int) -> None:
        """Count the n-grams of `line` that end after its first `seam` characters, which were counted before."""
        mixed = np.zeros(len(line), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(line) < n:
                return
            mixed = (mixed[: len(line) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + line[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                at = mixed[max(0, seam - n + 1) :]
                if n == 1:
                    at = at[line[seam:] != 32]
                spread = (at ^ (at >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                total += np.bincount((spread >> np.uint64(40)).astype(np.int64) % self.slots, minlength=self.slots)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, of length one."""
    x = np.sqrt(counts)
    return x / np.sqrt(counts.sum())


def train_pair(at: list[np.ndarray], x: list[np.ndarray], sign: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Weights (slots + 1, the last the constant's) of a linear support vector machine, by dual coordinate descent.

    Squared hinge loss; examples are taken in their order, every pass.
    """
    w, dual = np.zeros(slots + 1), np.zeros(len(sign))
    square = [float(v @ v) + 1.0 + 0.5 / COST for v in x]
    for _ in range(PASSES):
        most = 0.0
        for i, y in enumerate(sign.tolist()):
            slope = y * (w[at[i]] @ x[i] + w[-1]) - 1.0 + dual[i] * 0.5 / COST
            new = max(0.0, dual[i] - slope / square[i])
            change = (new - dual[i]) * y
            if change:
                w[at[i]] += change * x[i]
                w[-1] += change
                dual[i] = new
                most = max(most, abs(change))
        if most <= SETTLED:
            break
    return w


@dataclass
class Language:
    """A fitted model: its size depends on slots and languages, not on the data."""

    slots: int
    families: list[list[str]] = field(default_factory=list)
    chance: np.ndarray | None = None  # (families, slots): log probability of an n-gram
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str, grams: Grams) -> tuple[str, float]:
        """Language of a whole text and a confidence in it, 0 to 1."""
        counts = grams.counts(text)
        if counts is None or not self.families:
            return UNKNOWN, 0.0
        used = np.nonzero(counts)[0]
        held = counts[used]
        odds = self.chance[:, used] @ held
        best = int(np.argmax(odds))
        sure = float(1.0 / np.exp(np.minimum(odds - odds[best], 0.0)).sum())
        languages = self.families[best]
        if len(languages) == 1:
            return languages[0], sure
        x = scaled(held)
        won, margin = dict.fromkeys(languages, 0), {}
        for i, one in enumerate(languages):
            for two in languages[i + 1 :]:
                w = self.pairs[one, two]
                m = float(w[used] @ x + w[-1])
                margin[one, two], margin[two, one] = m, -m
                won[one if m >= 0 else two] += 1
        total = {a: sum(margin[a, b] for b in languages if b != a) for a in languages}
        first = min(languages, key=lambda a: (-won[a], -total[a], a))
        closest = min(margin[first, b] for b in languages if b != first)
        return first, float(sure / (1.0 + np.exp(-np.clip(4.0 * closest, -35, 35))))

    def predictions(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, lang_pred, score), one row per row of `docs`, by its text alone.

        A NULL text, one without a letter, and any text under a model that has learnt no language get
        `und` and 0. Texts of any length count whole; other columns are ignored.
        """
        ship()
        shared = docs.sparkSession.sparkContext.broadcast(self)  # slots x (families + pairs) numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            grams = Grams(model.slots)
            for batch in batches:
                found = [model.predict(t.as_py() or "", grams) for t in batch.column(1)]
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score"])

        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def family_of(language: str, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> str:
    """The family that lists the language, or its part before a hyphen; else the language itself."""
    base = language.split("-")[0].lower()
    return next((name for name, members in families.items() if base in members), f"={language}")


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
    held_out: int = HELD_OUT, slots: int = SLOTS, families: Mapping[str, tuple[str, ...]] = FAMILIES,
) -> Language:
    """Learn from texts with a language outside the held-out fold, `sample` of a language at most.

    Rows repeated under one id are rows of their own. NULL languages and texts without a letter
    teach nothing. Without any example the model knows no language. Only texts and languages enter it.
    """
    ship()
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_of(text_col))
    taught = docs.where(F.col(lang_col).isNotNull() & (fold(F.col(id_col)) != held_out)).select(
        F.col(lang_col).alias("lang"), text_of(text_col).alias("text"), key.alias("h")
    )
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return Language(slots)
    # Hashes up to a limit hold about twice the sample; the sample is cut from these, so no language is ranked whole.
    limit = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(2.0 * sample / n))])
    share = F.shiftrightunsigned(F.col("h"), 11) / F.lit(float(1 << 53))
    near = taught.where(share < F.element_at(limit, F.col("lang")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(slots)
        for batch in batches:
            for a in range(0, len(batch), HASHED_ROWS):
                part, has, at, counts = batch.slice(a, HASHED_ROWS), [], [], []
                for i, t in enumerate(part.column(1)):
                    held = grams.counts(t.as_py())
                    if held is not None:
                        has.append(i)
                        at.append(np.nonzero(held)[0].astype(np.int32))
                        counts.append(held[at[-1]])
                kept = part.take(pa.array(has, pa.int64()))
                columns = [kept.column(0), kept.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "h", "at", "x"])

    order = Window.partitionBy("lang").orderBy("h", "text")
    chosen = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).drop("rank")
    examples = stage(chosen.mapInArrow(hashed, "lang string, h bigint, at array<int>, x array<bigint>"), "examples")
    known = sorted(r["lang"] for r in examples.select("lang").distinct().collect())
    groups: dict[str, list[str]] = {}
    for lang in known:
        groups.setdefault(family_of(lang, families), []).append(lang)
    return Language(slots, list(groups.values()), _families(examples, list(groups.values()), slots), _pairs(examples, list(groups.values()), slots))


def _families(examples: DataFrame, groups: list[list[str]], slots: int) -> np.ndarray:
    """Log probability of each n-gram in each family; every language counts alike, and so does every family."""
    number = F.create_map(*[F.lit(x) for i, langs in enumerate(groups) for lang in langs for x in (lang, i)])
    each = examples.select(F.element_at(number, F.col("lang")).alias("family"), F.explode(F.arrays_zip("at", "x")).alias("g"))
    summed = each.groupBy("family", F.col("g.at").alias("at")).agg(F.sum("g.x").alias("n")).toArrow()  # families x slots
    counts = np.zeros((len(groups), slots))
    counts[summed["family"].to_numpy(), summed["at"].to_numpy()] = summed["n"].to_numpy()
    counts += 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _pairs(examples: DataFrame, groups: list[list[str]], slots: int) -> dict[tuple[str, str], np.ndarray]:
    """One machine per pair of languages of a family; a task holds the samples of two languages."""
    pairs = [(a, b) for langs in groups for i, a in enumerate(langs) for b in langs[i + 1 :]]
    if not pairs:
        return {}
    of: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(pairs):
        of.setdefault(a, []).append(i)
        of.setdefault(b, []).append(i)
    number = F.create_map(*[x for lang, at in of.items() for x in (F.lit(lang), F.array(*map(F.lit, at)))])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        pair = int(rows["pair"].iloc[0])
        rows = rows.sort_values(["h", "lang"], kind="stable")
        sign = np.where(rows["lang"] == pairs[pair][0], 1.0, -1.0)
        w = train_pair(list(rows["at"]), [scaled(x) for x in rows["x"]], sign, slots)
        return pd.DataFrame({"pair": [pair], "w": [w]})

    spread = examples.withColumn("pair", F.explode(F.element_at(number, F.col("lang"))))
    learnt = spread.groupBy("pair").applyInPandas(learn, "pair int, w array<double>").collect()  # slots numbers per pair
    return {pairs[r["pair"]]: np.array(r["w"], np.float32) for r in learnt}


def op13_language_svm(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`."""
    docs = table(spark, sf_dir, "documents")
    found = fit(docs).predictions(docs)
    return found.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")
