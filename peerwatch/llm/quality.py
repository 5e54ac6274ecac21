"""Quality scores: logistic regression over hashed word n-grams, trained by FTRL.

Tokens are words and runs of punctuation; one- and two-token grams are hashed
into a fixed number of slots. Follow-the-regularised-leader updates (per-slot
rates, L1 and L2) run over a bounded sample of labelled rows, dealt to a fixed
number of learners whose weights are averaged. A score is the logistic of a
sparse dot product, computed for whole texts in one pass over the table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerwatch.llm.common import ship, table, text_of

#: Slots of the hash.
SLOTS = 1 << 18
#: Labelled rows that are learnt from, at most: those with the smallest hash of their id.
SAMPLE = 16_000
#: Learners whose weights are averaged.
LEARNERS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.5
FOLDS = 3
HELD_OUT = 1
#: Tokens a task remembers with their slots.
REMEMBERED = 100_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Slots(dict):
    """Token to hash, remembered."""

    def __missing__(self, token: str) -> int:
        value = zlib.crc32(token.encode())
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = value
        return value


def grams(text: str, known: _Slots, slots: int = SLOTS) -> np.ndarray:
    """Slots of all one- and two-token grams of a whole text, repeats included; slot 0 is the constant.

    A token that repeats the one before, or the one before that, counts under a slot for such repeats, whatever the token.
    """
    tokens = _TOKEN.findall(text)
    one = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    left, right = one[:-1], one[1:]
    two = (left * 0x9E3779B1 + right * 0x85EBCA6B) >> 7
    two[left == right] = 0x5BD1E995
    again = np.full(np.count_nonzero(one[2:] == one[:-2]), 0x27D4EB2F)
    return np.concatenate((one, two, again)) % (slots - 1) + 1


def _scale(n: int) -> float:
    """Weight of one gram in a text of n grams."""
    return 1.0 / np.sqrt(n) if n else 0.0


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], slots: int = SLOTS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over (slots, values, label) examples, in their order."""
    z, n = np.zeros(slots), np.zeros(slots)

    def weights(at):
        held = z[at]
        w = -(held - np.sign(held) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(held) > L1, w, 0.0)

    for _ in range(epochs):
        for at, values, label in examples:
            w = weights(at)
            miss = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35))) - label
            g = miss * values
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weights(np.arange(slots))


def example(text: str, known: _Slots, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(grams(text, known, slots), return_counts=True)
    return np.concatenate(([0], at)), np.concatenate(([1.0], count * _scale(int(count.sum()))))


@dataclass
class Quality:
    """A fitted model; `weights` has a fixed number of slots, whatever the data."""

    weights: np.ndarray

    def score_text(self, text: str, known: _Slots) -> float:
        at = grams(text, known, len(self.weights))
        margin = self.weights[0] + self.weights[at].sum() * _scale(len(at))
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))))

    def _over(self, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        known = _Slots()
        for batch in batches:
            texts = batch.column(at)
            yield batch, np.fromiter((self.score_text(t.as_py() or "", known) for t in texts), float, len(texts))

    def scores(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score), one row per row. A NULL or empty text gets the score of the constant.

        Rows without an id or repeated under one get their own row; very long
        texts count whole; other columns are ignored.
        """
        ship()

        def run(batches):
            for batch, scores in self._over(batches, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")

    def keep(self, docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
        """The rows of `docs` with a score of at least `least`, all columns, whatever their names."""
        ship()
        names = docs.columns
        at = names.index(text_col)

        def run(batches):
            for batch, scores in self._over(batches, at):
                yield batch.filter(pa.array(scores >= least))

        inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
        return inner.mapInArrow(run, inner.schema).toDF(*names)


def fold(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    sample: int = SAMPLE, learners: int = LEARNERS, slots: int = SLOTS, held_out: int = HELD_OUT,
) -> Quality:
    """Learn from labelled rows outside the held-out fold; of these, the `sample` with the smallest id hash.

    The sample bounds the chosen ids, so they may be broadcast to the scan of the
    texts. Labels without a document, NULL labels and NULL ids teach nothing;
    several labels of one id count by their largest; several
    documents under one labelled id all teach (the bound is on ids). Without any example all weights are zero and
    every score is 0.5. Only texts and labels enter the model.
    """
    ship()
    allowed = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where(
        (fold(F.col("k")) != held_out) & F.col("y").isNotNull() & F.col("k").isNotNull()
    )
    chosen = allowed.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = docs.select(F.col(id_col).alias("k"), text_of(text_col).alias("text"))
    dealt = texts.join(F.broadcast(chosen), "k").select(
        "text", "y", F.xxhash64("k").alias("h"), F.pmod(F.xxhash64("k", F.lit(1)), F.lit(learners)).alias("learner")
    )

    def hashed(batches):
        known = _Slots()
        for batch in batches:
            rows = [example(t.as_py(), known, slots) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32())),
                    *batch.columns[1:],
                ],
                ["at", "x", "y", "h", "learner"],
            )

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["y"].to_numpy(), rows["h"].to_numpy()))
        at, x, y = (rows[c].to_numpy() for c in ("at", "x", "y"))
        w = ftrl([(at[i], x[i].astype(float), int(y[i])) for i in order], slots)
        used = np.nonzero(w)[0]
        return pd.DataFrame({"slot": used, "w": w[used]})

    examples = dealt.mapInArrow(hashed, "at array<int>, x array<float>, y int, h bigint, learner bigint")
    learnt = examples.groupBy("learner").applyInPandas(learn, "slot bigint, w double")
    # Sorted before the sum, so a rerun adds in the same order.
    mean = learnt.groupBy("slot").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    summed = mean.select("slot", F.aggregate("ws", F.lit(0.0), lambda a, b: a + b).alias("w")).toArrow()
    weights = np.zeros(slots)
    weights[summed["slot"].to_numpy()] = summed["w"].to_numpy() / learners
    return Quality(weights)


def op3_quality_ftrl(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents` as `labels.quality` marks them."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = model.scores(docs)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
