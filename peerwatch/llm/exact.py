"""Exact deduplication by skew-safe combining.

Three stages, each a grouping on the full content beside its digest, so two texts
with one digest never merge:

1. inside a map task, the partial aggregation keeps one row per distinct text;
2. local winners meet by (digest, salt), the salt coming from the map task, so a
   text that fills a third of the table is spread over `salts` reducers;
3. at most `salts` winners per text meet by digest.

A hot text thus never sends more than one row per map task to a reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerwatch.llm.common import fresh, table, text_of
from peerwatch.sources.staging import stage

SALTS = 8
DIGEST = "sha2(content, 256)"


def _combine(rows: DataFrame, winner: str, salts: int) -> DataFrame:
    """Rows (content, row, ...) to one row per content: digest, content, row, n.

    `winner` is an aggregate expression that picks `row` among equals.
    """
    local = rows.selectExpr(f"{DIGEST} AS digest", f"pmod(spark_partition_id(), {salts}) AS salt", "content", "row")
    salted = local.groupBy("digest", "salt", "content").agg(F.expr(winner).alias("row"), F.count(F.lit(1)).alias("n"))
    return (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.expr(winner).alias("row"), F.sum("n").alias("n"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row with its group: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; a NULL text is an empty one; empty texts form
    a group like any other. The largest id of a group stays. A NULL id never
    wins against another one; a group with NULL ids only has a NULL keep_id and
    keeps its rows. Rows repeated under one id count each in group_size and
    share `kept`. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(text_of(text_col).alias("content"), F.col(id_col).alias("row"))
    winners = _combine(rows, "max(row)", salts)
    # Texts stay only where two of them share a digest; elsewhere the digest names the text.
    groups = stage(
        winners.groupBy("digest").agg(
            F.max("row").alias("keep_id"), F.max("n").alias("group_size"), F.count(F.lit(1)).alias("texts")
        ),
        "exact",
    )
    light = rows.selectExpr("row AS doc_id", f"{DIGEST} AS digest")
    named = light.join(groups, "digest")
    if not groups.where("texts > 1").isEmpty():
        named = _with_clashes(rows, winners, groups, named)
    return named.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _with_clashes(rows: DataFrame, winners: DataFrame, groups: DataFrame, named: DataFrame) -> DataFrame:
    """Rows under a digest of several texts are told apart by their content."""
    clashing = groups.where("texts > 1").select("digest")
    told = winners.join(clashing, "digest", "left_semi").selectExpr("digest", "content", "row AS keep_id", "n AS group_size")
    full = rows.selectExpr("row AS doc_id", f"{DIGEST} AS digest", "content")
    apart = full.join(told, ["digest", "content"]).select("digest", "doc_id", "keep_id", "group_size")
    return named.where("texts = 1").select("digest", "doc_id", "keep_id", "group_size").unionByName(apart)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text, with all its columns: the row with the largest id.

    The row travels beside its text through the three stages, so no join follows.
    Repeated rows leave one; among rows with equal ids the rest of the row decides.
    A NULL text equals an empty one. Columns may have any names.
    """
    names = docs.columns
    slots = [fresh(["content", "row"], f"c{i}") for i in range(len(names))]
    position = {name: i for i, name in enumerate(names)}
    renamed = docs.toDF(*slots)
    text_slot, id_slot = slots[position[text_col]], slots[position[id_col]]
    carried = [id_slot, *(c for c in slots if c not in (text_slot, id_slot))]
    # The NULL flag of the text travels too, so a kept NULL stays NULL.
    rows = renamed.select(
        F.coalesce(text_slot, F.lit("")).alias("content"),
        F.struct(*carried, F.col(text_slot).isNull().alias("absent")).alias("row"),
    )
    kept = _combine(rows, _largest(rows), salts)
    back = [
        F.when(~F.col("row.absent"), F.col("content")).alias(name) if slot == text_slot else F.col(f"row.{slot}").alias(name)
        for name, slot in zip(names, slots)
    ]
    return kept.select(*back)


def _largest(rows: DataFrame) -> str:
    """Aggregate for the largest row; fields without an order (maps, variants) do not decide."""
    fields = rows.schema["row"].dataType.fields
    ordered = [f.name for f in fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    if len(ordered) == len(fields):
        return "max(row)"
    return f"max_by(row, struct({', '.join('row.' + name for name in ordered)}))"


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact groups of all `documents`."""
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLES = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)
    """,
}
