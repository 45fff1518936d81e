import datetime

import pytest
from pyspark.sql import functions as F

from lexiloom.streaming import verdicts as X

SCHEMA = "id long, ts timestamp, user string, value double"
START = datetime.datetime(2024, 1, 1)


def records(spark, path, minutes, user="u", value=1.0):
    rows = [(i, START + datetime.timedelta(minutes=m), user, value) for i, m in enumerate(minutes)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def sessions(spark, folder, root=None, late="10 minutes"):
    stream = X.read_stream(spark, folder, "events", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    updates = X.drain(X.pause_sessions(stream, "ts", "user", "30 minutes", late, "value"), "sessions", "update", root)
    out = X.closed_sessions(updates, "user").orderBy("user", "session_start").collect()
    minute = lambda t: (t - START).total_seconds() / 60
    return [(r["user"], minute(r["session_start"]), minute(r["session_end"]), r["records"], r["total"]) for r in out]


def test_sessions_over_several_batches(spark, tmp_path):
    """Forty records in two files, one file per trigger, and none is lost."""
    records(spark, str(tmp_path / "events"), range(0, 20))
    records(spark, str(tmp_path / "events"), range(20, 40))
    assert sessions(spark, str(tmp_path)) == [("u", 0, 69, 40, 40.0)]


def test_sessions_after_a_restart(spark, tmp_path):
    """A run that goes on from the checkpoint adds to the sessions of the one before, or opens others."""
    root = str(tmp_path / "run")
    records(spark, str(tmp_path / "events"), range(0, 20))
    assert sessions(spark, str(tmp_path), root) == [("u", 0, 49, 20, 20.0)]
    records(spark, str(tmp_path / "events"), [25, 200, 201], value=2.0)
    assert sessions(spark, str(tmp_path), root) == [("u", 0, 55, 21, 22.0), ("u", 200, 231, 2, 4.0)]
    records(spark, str(tmp_path / "events"), [500], "w", None)
    # the key comes back when its state has run out
    records(spark, str(tmp_path / "events"), [900])
    assert sessions(spark, str(tmp_path), root) == [("u", 0, 55, 21, 22.0), ("u", 200, 231, 2, 4.0), ("u", 900, 930, 1, 1.0), ("w", 500, 530, 1, 0.0)]


def test_late_records_join_sessions(spark, tmp_path):
    """A record that comes late closes the pause between two sessions; one behind the watermark is not counted."""
    records(spark, str(tmp_path / "events"), [0, 5])
    records(spark, str(tmp_path / "events"), [50, 52])
    records(spark, str(tmp_path / "events"), [27])
    assert sessions(spark, str(tmp_path), late="2 hours") == [("u", 0, 82, 5, 5.0)]
    records(spark, str(tmp_path / "events"), [500])
    records(spark, str(tmp_path / "events"), [1, 490])
    assert sessions(spark, str(tmp_path), late="30 minutes")[-1] == ("u", 490, 530, 2, 2.0)


def test_only_a_pause_longer_than_the_gap_parts(spark, tmp_path):
    records(spark, str(tmp_path / "events"), [0, 31, 61, 92])
    records(spark, str(tmp_path / "events"), [0, 10], None)
    assert sessions(spark, str(tmp_path)) == [("u", 0, 30, 1, 1.0), ("u", 31, 91, 2, 2.0), ("u", 92, 122, 1, 1.0)]


@pytest.mark.parametrize("files", [1, 3])
def test_sessions_equal_windows_over_everything(spark, tmp_path, files):
    """Many keys and random pauses, in files one after another, against a window over the whole table."""
    minutes = [(i * i * 37 + i * 11) % 2000 for i in range(300)]
    for f in range(files):
        part = [m for m in sorted(minutes) if m * files // 2000 == f]
        for user in ("a", "b", "c"):
            records(spark, str(tmp_path / "events"), [m for m in part if (m + ord(user)) % 3], user)
    # files of one span of time arrive in any order, so the bound is the span
    got = sessions(spark, str(tmp_path), late="2000 minutes")
    events = spark.read.parquet(str(tmp_path / "events"))
    want = events.groupBy("user", F.session_window("ts", "30 minutes").alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy("user", "s.start").collect()
    assert [(g[0], g[3]) for g in got] == [(w["user"], w["n"]) for w in want] and len(got) > 10
