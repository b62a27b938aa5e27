"""Streams replayed file by file against batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import events
from tests.oracle import differs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def split(spark, tmp_path):
    """The event log in four files that were written one after another, in order of time."""
    rows = spark.read.parquet(f"{SF}/events.parquet")
    cuts = rows.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)
    for a, b in zip([-1, *cuts], [*cuts, 1 << 60]):
        rows.where((rows.event_id > a) & (rows.event_id <= b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return f"{tmp_path}/log", str(tmp_path)


def batch(rows):
    """Changes of each user in order of time and id, by hand."""
    last, out = {}, set()
    for r in sorted((r for r in rows if r["value"] is not None and r["user_id"] is not None), key=lambda r: (r["ts"], r["event_id"])):
        if last.get(r["user_id"]) != r["value"]:
            out.add((r["user_id"], r["event_id"], last.get(r["user_id"]), r["value"]))
        last[r["user_id"]] = r["value"]
    return out


def told(df, kind="change"):
    rows = [tuple(r[c] for c in ("user_id", "event_id", "old_price", "new_price")) for r in df.where(f"kind = '{kind}'").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("part", "parts"), [("pmod(hash(event_id, 7), 5)", 5), ("5 - floor(event_id / 200)", 6), ("floor(event_id / 400)", 3)])
def test_any_order_of_files_gives_the_batch_result(spark, tmp_path, part, parts):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    log = events.dealt(rows, f"{tmp_path}/log", F.expr(part), parts, 24 * 400)
    go = lambda: events.run(events.price_changes(events.read_events(spark, log, 1), "400 days"), "append", [], f"{tmp_path}/run")
    got = told(go())
    assert len(list((tmp_path / "run/checkpoint/commits").glob("[0-9]*"))) >= parts
    assert got == batch(rows.collect())
    assert told(go()) == got  # a second run has nothing new and repeats nothing


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    log = events.dealt(rows, f"{tmp_path}/log", F.expr("1 - floor(event_id / 500)"), 2, 1)
    out = events.run(events.price_changes(events.read_events(spark, log, 1)), "append", [])
    every = rows.collect()
    edge = max(r["ts"] for r in every if r["event_id"] >= 500) - datetime.timedelta(hours=1)
    edge = edge.replace(microsecond=edge.microsecond // 1000 * 1000)
    late = [r for r in every if r["event_id"] < 500 and r["ts"] < edge and r["value"] is not None and r["user_id"] is not None]
    assert {x[1] for x in told(out, "late")} == {r["event_id"] for r in late} and len(late) > 100
    assert told(out) == batch([r for r in every if r not in late])


def test_states_expire(spark, tmp_path):
    days = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(1, days(0), 7, "x", 5.0, ""), (2, days(1), 8, "x", 6.0, ""), (3, days(30), 9, "x", 1.0, ""), (4, days(31), 9, "x", 1.0, ""), (5, days(60), 7, "x", 5.0, ""), (6, days(60), 9, "x", 1.0, ""), (7, days(60), None, "x", 1.0, ""), (8, days(60), 9, "x", None, "")]
    log = events.dealt(spark.createDataFrame(rows, events.SCHEMA), f"{tmp_path}/log", F.col("event_id") - 1, 8, 1)
    got = told(events.run(events.price_changes(events.read_events(spark, log, 1), "1 hour", 24 * 40), "append", []))
    # user 7 was forgotten after 40 days, user 9 wasn't
    assert got == {(7, 1, None, 5.0), (8, 2, None, 6.0), (9, 3, None, 1.0), (7, 5, None, 5.0)}


def test_windows_over_micro_batches(spark, split):
    log, at = split
    got = events.run(events.windowed(events.read_events(spark, log, 1)), "update", ["start", "event_type"], f"{at}/windows")
    assert sorted(map(str, got.collect())) == sorted(map(str, events.stream_windows(spark, SF).collect()))


@pytest.mark.parametrize("part", ["pmod(event_id, 2)", "int(event_id = 3)"])
def test_a_part_of_many_files_is_one_batch_and_users_share_states(spark, tmp_path, part):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.expr("if(event_id = 7, null, event_id)"))
    first = rows.withColumn("p", F.expr(f"coalesce({part}, 0)")).collect()
    log = events.dealt(rows, f"{tmp_path}/log", F.expr(f"coalesce({part}, 0)"), 2, 1, files=4)
    assert len(list((tmp_path / "log").glob("*.parquet"))) == 9
    out = events.run(events.price_changes(events.read_events(spark, log, 4), groups=3), "append", [], f"{tmp_path}/run")
    edge = max(r["ts"] for r in first if r["p"] == 0) - datetime.timedelta(hours=1)
    edge = edge.replace(microsecond=edge.microsecond // 1000 * 1000)
    late = [r for r in first if r["p"] == 1 and r["ts"] < edge]
    assert {x[1] for x in told(out, "late")} == {r["event_id"] for r in late} and late
    kept = [{**r.asDict(), "event_id": 1 << 62 if r["event_id"] is None else r["event_id"]} for r in first if r not in late]
    assert {(u, 1 << 62 if e is None else e, old, new) for u, e, old, new in told(out)} == batch(kept)
    # a row of state for each group, not for each user
    assert 0 < spark.read.format("statestore").load(f"{tmp_path}/run/checkpoint").count() <= 3


@pytest.mark.parametrize("name", ["stream_late_rows", "stream_price_changes"])
def test_longer_logs_are_dealt_to_more_files_with_the_same_result(spark, monkeypatch, name):
    made, dealt = [], events.dealt
    monkeypatch.setattr(events, "FILE_ROWS", 100)
    monkeypatch.setattr(events, "GROUPS", 2)
    monkeypatch.setattr(events, "dealt", lambda *a: made.append(dealt(*a)) or made[-1])
    assert differs(events.QUERIES[name](spark, SF), events.ORACLES[name], SF) == ""
    assert len(spark.read.schema(events.SCHEMA).parquet(made[0]).inputFiles()) > 8
