"""Records that arrive over time: verdicts, pass rates per window, pause-delimited sessions.

Batches of alignments arrive one after another; a file stream of records takes
the place of rerunning the batch job. Event times are converted from
zone-less timestamps, which watermarks reject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from lexiloom.operators.segments import judge
from lexiloom.session import scratch_path


def read_stream(spark: SparkSession, folder: str, name: str, schema: StructType, time: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the table ``name`` below ``folder``, a file or a folder of part files."""
    source = spark.readStream.schema(schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern of one match, which a stream takes for a file and for a folder alike
    stream = source.parquet(f"{folder}/[{name[0]}]{name[1:]}")
    return stream.withColumn(time, F.col(time).cast("timestamp")) if time else stream


def verdict_stream(stream: DataFrame, thresholds: dict, tests, aligned: str) -> DataFrame:
    """The batch verdict on a stream: column expressions only, no state."""
    return judge(stream, thresholds, tests, aligned)


def pass_rates(stream: DataFrame, time: str, key: str, passed: Column, width: str, late: str, by: str | None = None) -> DataFrame:
    """Pass rate per tumbling window; repeated ids within the lateness bound count once.

    State is one counter pair per open window (and group) and the ids of the
    last ``late`` span; the watermark drops both.
    """
    groups = [F.window(time, width).alias("w"), *([F.col(by)] if by else [])]
    counts = (
        stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
        .groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"))
    )
    return counts.select(
        F.col("w.start").alias("window_start"), *([by] if by else []), "total", "passed",
        (F.col("passed") / F.col("total")).alias("pass_rate"),
    )


SESSION_STATE = "ids array<long>, starts array<long>, lasts array<long>, records array<long>, totals array<double>, next long"


def pause_sessions(stream: DataFrame, time: str, key: str, gap: str, late: str, value: str) -> DataFrame:
    """(key, session, session_start, session_end, records, total): runs of records of one key with no pause longer than ``gap``.

    For a stream in update mode: whenever records arrive, each session they touch is given out as it stands, under its
    number within the key; a session that a late record joins to an earlier one is given out with 0 records. The
    newest rows with records (``closed_sessions``) are the sessions so far, so a stream that ends needs no later
    record to have all of them. A session stays in the state until the watermark, ``late`` behind the newest
    record, has passed its end; then a timer drops it. Records behind the watermark are not counted. Null times
    and keys belong to no session; null values add nothing.
    """
    pause = _micros(stream.sparkSession, gap)
    rows = stream.withWatermark(time, late).where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    key_type = stream.schema[key].dataType.simpleString()

    def advance(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            ids, starts, lasts, counts, totals, following = state.get
            held = [list(s) for s in zip(ids, starts, lasts, counts, totals)]
        else:
            held, following = [], 0
        touched: dict[int, list] = {}
        if not state.hasTimedOut:
            for pdf in frames:
                pdf = pdf.sort_values("at", kind="stable")
                at = pdf["at"].to_numpy()
                # runs of the new records, then each with the sessions it meets
                edges = np.flatnonzero(np.diff(at) > pause) + 1
                for run in np.split(np.arange(len(at)), edges):
                    if not len(run):
                        continue
                    new = [None, int(at[run[0]]), int(at[run[-1]]), len(run), float(pdf["value"].to_numpy()[run].sum())]
                    met = sorted((s for s in held if s[1] - new[2] <= pause and new[1] - s[2] <= pause), key=lambda s: s[1])
                    if met:
                        for s in met[1:]:
                            touched[s[0]] = [s[0], s[1], s[2], 0, 0.0]
                        new = [met[0][0], min(new[1], met[0][1]), max(new[2], *(s[2] for s in met)), new[3] + sum(s[3] for s in met), new[4] + sum(s[4] for s in met)]
                        held = [s for s in held if s not in met]
                    else:
                        new[0], following = following, following + 1
                    held.append(new)
                    touched[new[0]] = new
        mark = state.getCurrentWatermarkMs() * 1000
        held = [s for s in held if s[2] + pause >= mark]
        if held:
            state.update((*map(list, zip(*sorted(held))), following))
            # the timer must lie behind the watermark, which a held session's end does
            state.setTimeoutTimestamp(max(min(s[2] for s in held) + pause, mark + 1000) // 1000 + 1)
        elif following:
            # numbers go on, so that a key that comes back takes none that was given out
            state.update(([], [], [], [], [], following))
        if touched:
            rows = list(touched.values())
            yield pd.DataFrame({
                "key": [name[0]] * len(rows), "session": [r[0] for r in rows], "session_start": pd.to_datetime([r[1] for r in rows], unit="us"),
                "session_end": pd.to_datetime([r[2] + pause for r in rows], unit="us"), "records": [r[3] for r in rows], "total": [r[4] for r in rows]})

    out = rows.groupBy("key").applyInPandasWithState(
        advance, f"key {key_type}, session long, session_start timestamp, session_end timestamp, records long, total double", SESSION_STATE, "update", "EventTimeTimeout")
    return out.withColumnRenamed("key", key)


def closed_sessions(updates: DataFrame, key: str) -> DataFrame:
    """The sessions in the drained output of ``pause_sessions``, in their newest form."""
    return latest(updates, [key, "session"]).where("records > 0").drop("session")


def _micros(spark: SparkSession, span: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {span}"))).first()[0]


def drain(result: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Run the stream over everything there is and read its output table back.

    With the same ``root`` a later run goes on from the checkpoint that the one before it left.

    Append goes to a file sink with exactly-once output. In update mode every
    micro-batch overwrites a folder named by its number, so a repeated batch
    leaves one copy, and the number tells which row of a key is the latest.
    """
    spark = result.sparkSession
    root = root or scratch_path(spark, name)
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").start(f"{root}/out")
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out/epoch={number}")

        run = writer.foreachBatch(save).start()
    run.awaitTermination()
    schema = result.schema if mode == "append" else StructType(result.schema.fields).add("epoch", "long")
    return spark.read.schema(schema).parquet(f"{root}/out")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key of an update-mode output."""
    rest = [c for c in updates.columns if c not in (*keys, "epoch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"))
    return newest.select(*keys, "r.*")
