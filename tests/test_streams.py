"""Streams: restarts, replayed batches, late data, and state that stays bounded."""

from __future__ import annotations

import json
import shutil
from datetime import datetime, timedelta

import pytest

from tracklight.plans import registry
from tracklight.streaming import jobs

R, Tables = registry.record_queries, registry.Tables

SF = "/root/testdata/sf0.001"


def files(spark, folder, parts, schema):
    """A file for each list of rows, read one a batch in this order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        (made,) = [p for p in (folder / f"part{i}").iterdir() if p.name.startswith("part-")]
        (folder / "in").mkdir(exist_ok=True)
        shutil.move(made, folder / "in" / f"{i}.parquet")
        import os

        os.utime(folder / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return jobs.source(spark, str(folder / "in"), files=1)


def test_a_job_killed_between_write_and_commit_writes_no_row_twice(spark, tmp_path):
    home, died = str(tmp_path / "home"), []
    parts = [[(i, f"r{i}") for i in range(k * 10, k * 10 + 10)] for k in range(4)]
    stream = files(spark, tmp_path, parts, "id bigint, name string")

    def write(batch, i, home):
        jobs.write_batch(batch, i, home)
        if i == 2 and not died:
            died.append(i)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        jobs.run_all(stream, "append", home, write)
    assert jobs.table(spark, home, stream.schema).count() == 20  # what was written and not committed is not read
    jobs.run_all(jobs.source(spark, str(tmp_path / "in"), files=1), "append", home, write)
    assert sorted(r.id for r in jobs.table(spark, home, stream.schema).collect()) == list(range(40))
    assert jobs.committed(spark, home) == [0, 1, 2, 3]
    # the log forgets that the last batch was done: it is run again, into its own folder
    (tmp_path / "home" / "log" / "commits" / "3").unlink()
    for crc in (tmp_path / "home" / "log" / "commits").glob(".3*"):
        crc.unlink()
    jobs.run_all(jobs.source(spark, str(tmp_path / "in"), files=1), "append", home, write)
    assert sorted(r.id for r in jobs.table(spark, home, stream.schema).collect()) == list(range(40))


def test_duplicates_are_dropped_across_restarts(spark, tmp_path):
    home = str(tmp_path / "home")
    for _ in range(2):
        got = jobs.ingest_once(spark, f"{SF}/events.parquet", home)
    assert got.count() == got.select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()


def told(rows):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in rows.collect())


def test_captured_streams_equal_captured_tables(spark, tmp_path):
    """Nested rows of all ended runs, over several batches, and after a batch was replayed."""
    t, home = Tables(spark, SF), str(tmp_path / "home")
    orders = spark.read.parquet(f"{SF}/orders.parquet").orderBy("o_orderkey")
    schema, rows = orders.schema, [tuple(r) for r in orders.collect()]
    cut = len(rows) // 3
    files(spark, tmp_path, [rows[:cut], rows[cut : 2 * cut], rows[2 * cut :] + rows[:5]], schema)
    stream = lambda: R.run_updates(t, jobs.source(spark, str(tmp_path / "in"), files=1))
    want = told(R._captured(t).where("metadata.status in ('completed', 'failed')"))
    assert told(jobs.capture_stream(stream(), t.v_steps, R._messages(t), home)) == want
    commits = tmp_path / "home" / "log" / "commits"
    for p in [commits / "2", *commits.glob(".2*")]:
        p.unlink()
    assert told(jobs.capture_stream(stream(), t.v_steps, R._messages(t), home)) == want


def test_live_tables_drop_their_state(spark, tmp_path):
    """Sixty days, a batch each, with rows that are late: those within the watermark count, those beyond it do not."""
    day = datetime(2024, 1, 1, 12)
    parts = [[(day + timedelta(days=d), float(d))] + ([(day + timedelta(days=d - 1), 1.0)] if d else []) + ([(day + timedelta(days=d - 20), 9.0)] if d > 30 else []) for d in range(60)]
    stream, seen = files(spark, tmp_path, parts, "ts timestamp, value double"), []
    got = {str(r.day): (r.n, r.avg_score) for r in jobs.daily_stream(stream, "2 days", seen=seen).collect()}
    want = {}
    for d in range(60):
        values = [float(d)] + ([1.0] if d < 59 else [])
        want[str((day + timedelta(days=d)).date())] = (len(values), sum(values) / len(values))
    assert got == want
    held = [s["numRowsTotal"] for p in seen for s in p["stateOperators"]]
    assert len(held) >= 60 and max(held[10:]) <= 6


def test_latency_windows_by_key(spark, tmp_path):
    at = datetime(2024, 1, 1)
    parts = [[("a", at + timedelta(hours=6 * k + 1)), ("b", at + timedelta(hours=6 * k)), ("a", at + timedelta(hours=max(0, 6 * k - 5)))] for k in range(12)]
    stream, seen = files(spark, tmp_path, parts, "event_type string, ts timestamp"), []
    got = {(r.event_type, r.start): r.n for r in jobs.latency_stream(stream, "12 hours", seen=seen).collect()}
    want = {}
    for kind, ts in [x for p in parts for x in p]:
        start = ts.replace(hour=ts.hour // 6 * 6)
        want[kind, start] = want.get((kind, start), 0) + 1
    assert got == want and max(s["numRowsTotal"] for p in seen[6:] for s in p["stateOperators"]) <= 10


def file_states(spark, tmp_path, parts, **more):
    events = files(spark, tmp_path, parts, "id bigint, event_id bigint, ts timestamp, asked string")
    home = jobs.new_home(spark)
    rows = jobs.drain(jobs.file_machine(events, **more), "update", home).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.step):
        last[r.id] = (r.status, r.error, r.refused)
    return last


def test_files_follow_event_time_across_batches(spark, tmp_path):
    """A request that is older than the newest one of an earlier batch counts in its place."""
    at = datetime(2024, 1, 1)
    m = lambda n: at + timedelta(minutes=n)
    parts = [[(1, 1, m(0), "parsing"), (1, 3, m(20), "completed"), (2, 4, m(1), "parsing")], [(1, 2, m(10), "embedding"), (3, 9, m(200), "parsing")], [(3, 10, m(201), "embedding"), (4, 11, m(5), "parsing")], [(3, 12, m(300), "completed")]]
    got = file_states(spark, tmp_path, parts, minutes=120, late="1 hour")
    assert got[1] == ("completed", None, 0)  # parsing, embedding (late), completed
    assert got[2] == ("error", jobs.TIMED_OUT, 0)
    assert got[3] == ("completed", None, 0)
    assert got[4] == ("error", jobs.TIMED_OUT, 0)  # later than that: it counts when it comes, and its time was long over


def test_file_rules_on_one_file():
    wait = 60_000
    go = lambda *events: jobs.asked_for(("pending", None, 0, 0), list(events), wait)
    assert go((1, 1, "embedding")) == ("pending", None, 1, 1)
    assert go((1, 1, "parsing"), (2, 2, "error"), (3, 3, "parsing")) == ("error", "asked to fail", 1, 3)
    assert go((1, 1, "parsing"), (70_000, 2, "embedding")) == ("error", jobs.TIMED_OUT, 1, 70_000)
