"""Cutting lineage between steps: tables are written to the shared folder and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_local_roots: dict[str, str] = {}
_runs: dict[str, list[str]] = {}
_kept: dict[str, dict[tuple, tuple[str, StructType]]] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder the program set as checkpoint folder, else spark.checkpoint.dir; a temporary one only in local mode with neither."""
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    configured = chosen.get() if chosen.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="peerwatch-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def folder(spark: SparkSession) -> str:
    """Where tables are staged now: the innermost run's folder, else the application's."""
    app = spark.sparkContext.applicationId
    owned = _runs.get(app)
    return owned[-1] if owned else f"{shared_root(spark)}/{app}"


def stage(df: DataFrame, name: str = "stage", into: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Write a table once as Parquet in the shared folder (or in `into`) and go on from the files.

    With `by`, rows lie in a folder per value of these columns, so a filter on them reads those folders alone.

    Later passes read only the columns they need, nothing upstream is computed
    twice, and a lost executor costs no recomputation of earlier steps.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, name, into, by))


def _written(df: DataFrame, name: str, into: str | None = None, by: Sequence[str] = ()) -> str:
    path = f"{into or folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return path


def stage_once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table staged under this key in the current folder, made the first time it is asked for."""
    held = _kept.setdefault(folder(spark), {})
    if key not in held:
        df = make()
        held[key] = _written(df, name), df.schema
    path, schema = held[key]
    return spark.read.schema(schema).parquet(path)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside belong to this run and go when it ends; results must be read or written before."""
    app = spark.sparkContext.applicationId
    path = f"{shared_root(spark)}/{app}/run-{uuid.uuid4().hex}"
    _runs.setdefault(app, []).append(path)
    try:
        yield path
    finally:
        _runs[app].remove(path)
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    _kept.pop(path, None)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """A few rows as a local relation, whose true size Catalyst knows."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(column, to_arrow_type(field.dataType)) for column, field in zip(columns, schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema.fieldNames()), schema)


def attach(df: DataFrame, stats: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Many-to-one join of statistics to rows; a key that the statistics hold twice raises when any of them is read.

    The check is an aggregation of the small side on the join keys. Statistics
    that come from a group-by on these keys are partitioned so already, and no
    job is added. No hint: adaptive execution broadcasts the side on its measured
    bytes, or joins by shuffle and splits hot keys.
    """
    return df.join(one_per_key(stats, on), on=on, how=how)


def one_per_key(stats: DataFrame, on: list[str]) -> DataFrame:
    """The table itself, with an assertion in its plan that each key occurs once; NULL keys, which match nothing, may repeat."""
    keys = [f"`{c}`" for c in on]
    others = [F.expr(f"any_value(`{c}`) AS `{c}`") for c in stats.columns if c not in on]
    shown = ", ".join(f"coalesce(CAST({k} AS STRING), 'NULL')" for k in keys)
    told = f"raise_error(concat('several rows of statistics for one key ({', '.join(on)}): ', concat_ws(', ', {shown})))"
    counted = stats.groupBy(*on).agg(F.expr("count(1) AS _rows_of_key"), *others)
    return counted.where(f"CASE WHEN _rows_of_key > 1 THEN CAST({told} AS BOOLEAN) ELSE true END").select(*stats.columns)


def drop_stages(spark: SparkSession) -> None:
    """Remove what this application staged, once nothing reads it any more."""
    _remove(spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}")
