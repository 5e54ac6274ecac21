"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship() -> None:
    """Let task functions of this package travel by value, so executors need no copy of it."""
    import peerwatch

    cloudpickle.register_pickle_by_value(peerwatch)


def text_of(column: str = "text") -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(taken: Iterable[str], name: str) -> str:
    """`name`, with underscores appended until no column has it (names compare without case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def hash_unit(*keys: Column, seed: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys, seed), 11) / F.lit(float(1 << 53))
