"""What a run has finished: one small file per step, written after the step's tables.

An entry says what the step was made from (a mark of source, bounds and
parameters, chained from step to step), which tables it left and with what
columns, and which reports. A step whose entry carries the wanted mark need not
run again; a step that was cut short has no entry.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "step string, mark string, tables map<string, string>, reports array<string>"


def mark(*parts) -> str:
    """Digest of plain values; dates and the like count as their text."""
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()


def source_mark(df: DataFrame) -> str | None:
    """Digest of a table's columns and of the path, length and time of each of its files; None for one that has no files.

    Files are listed, not read, and only one row of sums reaches the driver.
    """
    files = df.inputFiles()
    if not files:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    row = listed.agg(
        F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", F.col("modificationTime").cast("string")))
    ).first()
    return mark(df.schema.json(), *row)


@dataclass(frozen=True)
class Entry:
    step: str
    mark: str
    tables: dict[str, str]
    reports: list[str]


class Manifest:
    """The entries of a run under a folder that outlives the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def finish(self, entry: Entry) -> None:
        row = self.spark.createDataFrame([(entry.step, entry.mark, entry.tables, entry.reports)], _SCHEMA)
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/{entry.step}")

    def entry(self, step: str) -> Entry | None:
        """The entry of a finished step; None for one that never finished."""
        try:
            row = self.spark.read.schema(_SCHEMA).json(f"{self.folder}/{step}").first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return Entry(row["step"], row["mark"], dict(row["tables"] or {}), list(row["reports"] or [])) if row else None
