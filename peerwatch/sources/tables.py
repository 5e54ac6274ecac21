"""Reading sources and writing stages and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_source(spark: SparkSession, location: str, fmt: str | None = None, **options) -> DataFrame:
    """Transactions from files or from a database.

    A `jdbc:` location is read over `numPartitions` ranges of `partitionColumn`;
    without them the whole table would pass through one task, so they are required.
    """
    if location.startswith("jdbc:"):
        needed = ("dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")
        absent = [name for name in needed if name not in options]
        if absent:
            raise ValueError("a database table is read in ranges; missing options: " + ", ".join(absent))
        return spark.read.format("jdbc").option("url", location).options(**options).load()
    return spark.read.format(fmt or "parquet").options(**options).load(location)


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def read_stage(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    optional: bool = False,
) -> DataFrame | None:
    """A staged table with declared types; CSV text that does not parse becomes NULL.

    With `optional`, a table that was never written gives None.
    """
    try:
        if fmt != "csv":
            df = spark.read.format(fmt).load(path)
        else:
            df = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    require_columns(df, schema.fieldNames())
    typed = []
    for field in schema.fields:
        column = F.col(field.name)
        typed.append((column.try_cast(field.dataType) if fmt == "csv" else column.cast(field.dataType)).alias(field.name))
    return df.select(*typed)


def require_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The table itself if it has the declared columns in the declared types; it may have others."""
    require_columns(df, schema.fieldNames())
    wrong = [
        f"{f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}"
        for f in schema.fields if df.schema[f.name].dataType != f.dataType
    ]
    if wrong:
        raise ValueError("columns of another type: " + ", ".join(wrong))
    return df


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a staged table."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report with one row per group or indicator, as a single CSV file with header."""
    write_stage(df.coalesce(1), path, "csv")
