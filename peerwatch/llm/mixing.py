"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, each source gets a target and a repetition rate
(target / its tokens, at most `max_rate`), and a document is taken floor(rate)
times plus one more copy when a hash of its id falls below the fraction. Of a
few seeds a source uses the one whose draw comes nearest to its target. Only
(id, source, size) rows are grouped; a hot source arrives as partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerwatch.llm.common import WORD, fresh, hash_unit, table
from peerwatch.operators.ordering import number_rows
from peerwatch.sources.staging import stage

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = 42
#: Seeds a source may choose from.
TRIES = 16


def token_count(text_col: str = "text"):
    """Words of a text; none for NULL."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources in order of code points, NULL last, take the weights in turn. They
    share the sum of all sizes; a target stops at `max_rate` times its source,
    and the excess is shared anew by weight among the others. Each pass is one
    small aggregation over sources; it ends when no further source is capped.
    A source without words has target and rate 0.
    """
    totals = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = number_rows(totals, [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = stage(
        ranked.select("source", "source_size", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("weight")),
        "weighed",
    )
    level, capped = 0.0, -1
    while True:
        full = (F.col("source_size") * max_rate) <= F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("source_size") * max_rate)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if not row["open"] or row["capped"] == capped:
            break
        capped = row["capped"]
        level = ((row["total"] or 0) - (row["held"] or 0)) / row["open"]
    cap = (F.col("source_size") * max_rate).cast("double")
    target = F.least(cap, F.col("weight") * F.lit(float(level))) if row["open"] else cap
    size = F.col("source_size")
    return weighed.select(
        "source", "source_size", target.alias("target"), F.when(size > 0, target / size).otherwise(0.0).alias("rate")
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(text_col).alias("size"))


def _copies(rate, key, seed):
    whole = F.floor(rate).cast("int")
    return whole + F.when(hash_unit(F.coalesce(key.cast("string"), F.lit("")), seed=seed) < rate - whole, 1).otherwise(0)


def _with_seeds(sized: DataFrame, targets: DataFrame, seed: int, tries: int) -> DataFrame:
    """Targets with the `seed` of each source, chosen in one aggregation that adds up every seed's draw."""
    drawn = _on_source(sized, targets, "source")
    taken = F.array(*[F.sum(F.col("size") * _copies(F.col("rate"), F.col("id"), F.lit(seed + j))) for j in range(tries)])
    sums = drawn.groupBy("source", "source_size", "target", "rate").agg(taken.alias("taken"))
    missed = F.transform("taken", lambda t, j: F.struct(F.abs(t - F.col("target")).alias("by"), j.alias("j")))
    return sums.select("source", "source_size", "target", "rate", (F.array_min(missed)["j"] + seed).alias("seed"))


def mix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, max_rate: int = MAX_RATE, seed: int = SEED, tries: int = TRIES,
) -> DataFrame:
    """(doc_id, size, source_size, target, copies), one row per row of `docs`.

    A NULL or empty text has size 0; a NULL source is a source of its own, last
    in order; rows repeated under one id share their draw. The draw depends on
    id and seed only, and the seed on the table, so reruns agree. An empty table gives no rows.
    """
    sized = stage(_sized(docs, id_col, text_col, source_col), "sized")
    targets = stage(source_targets(sized, weights, max_rate), "targets")
    seeded = stage(_with_seeds(sized, targets, seed, tries), "seeded")
    return _on_source(sized, seeded, "source").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        _copies(F.col("rate"), F.col("id"), F.col("seed")).alias("copies"),
    )


def _on_source(rows: DataFrame, targets: DataFrame, source_col: str) -> DataFrame:
    """Rows with their source's figures; without a hint, so the join is chosen by measured size."""
    side = targets.withColumnRenamed("source", fresh(rows.columns, "_source"))
    return rows.join(side, rows[source_col].eqNullSafe(side[side.columns[0]]))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, max_rate: int = MAX_RATE, seed: int = SEED, tries: int = TRIES,
) -> DataFrame:
    """The mixture itself: every row of `docs`, with its columns, as often as `mix_counts` says."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {name: f"c{i}" for i, name in enumerate(names)}
    sized = stage(_sized(docs, id_col, text_col, source_col), "sized")
    targets = stage(source_targets(sized, weights, max_rate), "targets")
    seeded = stage(_with_seeds(sized, targets, seed, tries).select("source", "rate", "seed"), "seeded")
    copies = _copies(F.col("rate"), F.col(at[id_col]), F.col("seed"))
    taken = _on_source(inner, seeded, at[source_col]).withColumn("copies", copies).where("copies > 0")
    return taken.select(*inner.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy").toDF(*names)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words taken from each of all `documents`."""
    counts = mix_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
