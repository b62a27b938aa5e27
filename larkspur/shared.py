"""The folder that the driver and all executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one of its own only where the session names none and runs locally, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends there, and it survives lost executors. Removed at exit."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for work that is heavy for its bytes: the engine would put few bytes into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def once_each(rows: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that make adds to `columns`: each combination of values is read once, however many rows have it.

    make gets a table of the distinct combinations, spread over tasks, and gives it back with more columns. Nulls are values.
    """
    distinct = rows.select(*columns).distinct()
    made = make(distinct.repartition(tasks(rows.sparkSession), *columns))
    new = [c for c in made.columns if c not in columns]
    own = written(made, "once").select(*[F.col(c).alias(f"_{c}") for c in columns], *new)
    met = F.lit(True)
    for c in columns:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(own, met).select(*rows.columns, *new)


def spread(rows: DataFrame, column: str, **made: Column) -> DataFrame:
    """The distinct values of a column with what is made of each; written, so that each is made once and small tables are known as such."""
    once = rows.select(column).distinct().repartition(tasks(rows.sparkSession), column)
    return written(once.withColumns(made) if made else once, column)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S110  the session may be gone at exit
            pass
