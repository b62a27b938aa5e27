"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where the session names none (tests in local mode) is one of our own set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # the table stands for the shuffles that made it: they are removed when it is written, not when the driver's memory is short
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written() gave, when nothing reads them any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [x for x in _made if x[1] != path]


def drop_written(spark: SparkSession) -> None:
    """Remove the intermediate tables of this session; call it when no result that reads them is needed any more."""
    for owner, path in list(_made):
        if owner is spark:
            _delete(spark, path)


@atexit.register
def _drop_all() -> None:
    for spark in {x[0] for x in _made}:
        try:
            drop_written(spark)
        except Exception:  # noqa: BLE001, S110  the session may be gone at exit
            pass


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from batch to batch: one thing, of whatever operator used it last.

    Workers outlive a stage; what an earlier operator had there goes before the next one makes its own.
    """
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def running(df: DataFrame, by: list[str], amounts: dict[str, Column], *, group: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each amount, its sum over the rows of the same group that come before in the order of `by`.

    Rows are dealt by ranges of (group, by), so a group of any size is spread over tasks; each range sums its own rows, and the
    sums of the earlier ranges, one row for each range and group, are added. Nulls come first and are a group of their own.
    Rows that are equal in `by` are in one range, in any order. Numbers are longs.
    """
    plain = df.withColumns({n: c.cast("long") for n, c in amounts.items()})
    dealt = written(plain.repartitionByRange(*group, *by).withColumn("_range", F.spark_partition_id()), "dealt")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*group, "_range").agg(*[F.sum(n).alias(n) for n in amounts])
    before = totals.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_of"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in amounts])
    within = Window.partitionBy(*group, "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({n: F.coalesce(F.sum(n).over(within), F.lit(0)) for n in amounts})
    met = [F.col("_range") == F.col("_of"), *[F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]]
    out = own.join(before, met)
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in amounts])
