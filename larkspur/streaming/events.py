"""Structured Streaming over the event log: de-duplication, tumbling windows, and each key's last price.

Events come as files; a run takes what is there and stops (availableNow), and the next one goes on from its checkpoint.
Results are upserts: each micro-batch replaces its own folder, so a batch that is run again after a failure changes nothing,
and a reader takes the latest row of each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.shared import shared_dir, tasks

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: Events later than this behind the latest one are dropped from windows and de-duplication.
DELAY, WINDOW = "1 hour", "6 hours"
#: A key's state is kept so long after its last row; LONG_DAYS is longer than a log.
EXPIRE_HOURS, LONG_DAYS = 24 * 400, 400
#: Users share the state of their group, as the function of a state is called once a group and batch. The queries take more groups and
#: files for a longer log: about so many rows of the log for a group, and for a file.
GROUPS, GROUP_ROWS, FILE_ROWS = 256, 5_000, 100_000


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """The stream of event files that the path or pattern names, so many files a micro-batch."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame) -> DataFrame:
    """Events by their id, each once; ids are remembered as long as DELAY."""
    return events.withWatermark("at", DELAY).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame) -> DataFrame:
    """Events and their sum in each tumbling window, by type."""
    rows = events.withWatermark("at", DELAY).groupBy(F.window("at", WINDOW), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


_CHANGE = "user_id bigint, event_id bigint, old_price double, new_price double, kind string"
#: A group's state: the last row that was taken of each user, and the rows that the watermark hasn't passed yet, both as _ROW.
_STATE = "last binary, waiting binary"
_ROW = np.dtype([("user_id", "<i8"), ("at", "<i8"), ("event_id", "<i8"), ("value", "<f8")])
#: Stands for a missing event id, and is last in order as that is.
_NO_ID = (1 << 63) - 1


def _in_order(expire: int):
    """The function of a group's state: takes each user's rows that the watermark has passed, in order of time and id."""

    def told(rows: np.ndarray, old: np.ndarray | float, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "old_price": old, "new_price": rows["value"], "kind": kind})

    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() * 1000
        last, waiting = [np.frombuffer(b, _ROW) for b in state.get] if state.exists else [np.empty(0, _ROW)] * 2
        if not state.hasTimedOut:
            came = [np.empty(0, _ROW)]
            for rows in batches:
                came.append(np.empty(len(rows), _ROW))
                for name in _ROW.names:
                    came[-1][name] = rows[name].to_numpy()
            came = np.concatenate(came)
            late = came["at"] < watermark
            if late.any():
                yield told(came[late], np.nan, "late")
            waiting = np.concatenate([waiting, came[~late]])
        passed = waiting["at"] < watermark
        if passed.any():
            # a user's last row is earlier than all that waited when it was taken
            rows = np.concatenate([last, waiting[passed]])
            order = np.lexsort((rows["value"], rows["event_id"], rows["at"], rows["user_id"]))
            rows, new = rows[order], order >= len(last)
            follows = rows["user_id"][1:] == rows["user_id"][:-1]
            known, before = np.zeros(len(rows), bool), np.full(len(rows), np.nan)
            known[1:] = follows & (rows["at"][1:] - rows["at"][:-1] <= expire)
            before[1:] = rows["value"][:-1]
            change = new & (~known | (rows["value"] != before))
            if change.any():
                yield told(rows[change], np.where(known, before, np.nan)[change], "change")
            last, waiting = rows[np.append(~follows, True)], waiting[~passed]
        last = last[last["at"] >= watermark - expire]  # users of whom nothing came for so long are forgotten
        if len(last) or len(waiting):
            state.update((last.tobytes(), waiting.tobytes()))
            wake = int(waiting["at"].min() if len(waiting) else last["at"].max() + expire)
            state.setTimeoutTimestamp(max(wake, watermark) // 1000 + 1)
        elif state.exists:
            state.remove()

    return changes


def price_changes(events: DataFrame, delay: str = DELAY, expire_hours: int = EXPIRE_HOURS, groups: int = GROUPS) -> DataFrame:
    """user_id, event_id, old_price, new_price and kind: change, or late for rows that came after the watermark had passed them.

    Rows wait in their group's state until the watermark, `delay` behind the latest event, has passed them, and are taken in order
    of time and id, so files may come in any order and be split in any way; a timer takes them when no row of the group follows. A user's
    first price has no old one. Late rows change nothing and are returned to be counted. A price that comes more than expire_hours
    after the one before is a first one again, whether or not a timer has removed the user's state. Rows without a time are never passed.
    `groups` divides the users by a hash, and must stay the same for a checkpoint; each group's waiting rows should fit into memory easily.
    """
    # a row for the clock and one for its group; without a time of its own the latter isn't dropped before it can be counted
    kept = F.col("value").isNotNull() & F.col("user_id").isNotNull()
    event = F.coalesce("event_id", F.lit(_NO_ID)).alias("event_id")
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("grp")
    both = events.select(group, "user_id", event, F.unix_micros("at").alias("at"), "value", F.explode(F.array(F.col("at"), F.when(kept, F.lit(None)).otherwise(F.col("at")))).alias("clock"))
    rows = both.withWatermark("clock", delay).where("clock IS NULL AND at IS NOT NULL")
    out = rows.groupBy("grp").applyInPandasWithState(_in_order(expire_hours * 3_600_000_000), _CHANGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("event_id", F.nullif("event_id", F.lit(_NO_ID)))


def dealt(rows: DataFrame, where: str, part: Column, parts: int, delay_hours: int, files: int = 1) -> str:
    """Writes rows as files that come one after another, part by part, and a last one that moves the watermark past all.

    Each part is exactly so many files, some of them empty where it has few rows, so that a stream of so many files a batch meets it as one.
    """
    spark = rows.sparkSession
    for k in range(parts):
        rows.where(part == k).repartition(files).write.mode("append").parquet(where)
        there = len(spark.read.schema(rows.schema).parquet(where).inputFiles())
        for _ in range((k + 1) * files - there):
            spark.createDataFrame([], rows.schema).write.mode("append").parquet(where)
    end = rows.select(F.lit(-1).cast("long").alias("event_id"), "ts").groupBy("event_id").agg(F.max("ts").alias("ts"))
    names = {"user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
    end = end.select("event_id", (F.col("ts") + F.expr(f"INTERVAL {2 * delay_hours} HOURS")).alias("ts"), *[F.lit(None).cast(t).alias(n) for n, t in names.items()])
    end.select(*rows.columns).coalesce(1).write.mode("append").parquet(where)
    return where


def run(stream: DataFrame, mode: str, keys: list[str], where: str | None = None) -> DataFrame:
    """Runs the stream over what is there; the latest row of each key. where: the folder of results and of the checkpoint."""
    spark = stream.sparkSession
    where = where or folder(spark)
    names = stream.columns

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").foreachBatch(upsert).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{where}/out").parquet(f"{where}/out")
    if mode == "append":
        return rows.select(*names)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return latest.select("r.*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, f"{sf_dir}/events.parque[t]")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice in the stream, once in the result."""
    both = _events(spark, sf_dir).union(_events(spark, sf_dir))
    return run(deduplicated(both).select("event_id", "user_id", "event_type"), "append", ["event_id"])


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(windowed(_events(spark, sf_dir)), "update", ["start", "event_type"])


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet")


def _replayed(spark: SparkSession, sf_dir: str, part: Column, parts: int, delay_hours: int) -> DataFrame:
    """The price changes of the log, dealt to so many parts that come as a micro-batch each."""
    rows = _rows(spark, sf_dir)
    n = rows.count()
    files = max(1, min(tasks(spark), n // (parts * FILE_ROWS)))
    log = dealt(rows, f"{folder(spark)}/log", part, parts, delay_hours, files)
    changes = price_changes(read_events(spark, log, files), f"{delay_hours} hours", 24 * LONG_DAYS, max(GROUPS, n // GROUP_ROWS))
    return run(changes, "append", ["user_id", "event_id"])


def stream_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log dealt at random to four parts, so that each covers all times; the delay covers the log."""
    out = _replayed(spark, sf_dir, F.pmod(F.hash("event_id"), F.lit(4)), 4, 24 * LONG_DAYS)
    return out.where("kind = 'change'").drop("kind")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two parts, the even ids first: late rows of each user, and changes that could be told."""
    out = _replayed(spark, sf_dir, F.pmod(F.col("event_id"), F.lit(2)), 2, 1)
    return out.groupBy("user_id").agg(F.count_if(F.col("kind") == "late").alias("late"), F.count_if(F.col("kind") == "change").alias("changes"))


QUERIES = {f.__name__: f for f in (stream_dedup, stream_windows, stream_price_changes, stream_late_rows)}
ORACLES = {
    "stream_dedup": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_price_changes": """WITH e AS (SELECT user_id, event_id, lag(value) OVER w AS old_price, value AS new_price, row_number() OVER w AS k FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, old_price, new_price FROM e WHERE k = 1 OR old_price <> new_price""",
    "stream_late_rows": """WITH r AS (SELECT * FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
        mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS edge FROM events WHERE event_id % 2 = 0),
        kept AS (SELECT * FROM r, mark WHERE event_id % 2 = 0 OR ts >= edge),
        told AS (SELECT user_id, lag(value) OVER w AS old, value, row_number() OVER w AS k FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        c AS (SELECT user_id, count(*) AS changes FROM told WHERE k = 1 OR old <> value GROUP BY user_id),
        l AS (SELECT user_id, count(*) AS late FROM r, mark WHERE event_id % 2 = 1 AND ts < edge GROUP BY user_id)
        SELECT user_id, coalesce(late, 0) AS late, coalesce(changes, 0) AS changes FROM c FULL JOIN l USING (user_id)""",
}
