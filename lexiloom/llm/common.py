"""Small helpers of the training-data operators: keys, text, bounded broadcasts, shared files."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Ids of at most this many rows may be broadcast: 16 MB of longs.
BROADCAST_ROWS = 1_000_000
ROWS_AT_ONCE = 256


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def row_key(*columns: str) -> Column:
    """A hash that names a row by the given columns, nulls included; equal rows share it."""
    return F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns])


def keep_ids(df: DataFrame, on: str, ids: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids`` (unique). Up to BROADCAST_ROWS ids are sent
    to every task, so that long rows stay where they are; more meet in a shuffled join."""
    n = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, on, "left_semi")


def shared_fs(uri: str):
    """(file system, path) of a folder that every executor reaches by the same URI."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def shared_output(folder: str, name: str):
    """A stream to a new file in a shared folder, given its name only when complete.

    A lost or repeated task leaves an unnamed attempt behind and never a torn file.
    """
    filesystem, path = shared_fs(folder)
    filesystem.create_dir(path, recursive=True)
    attempt = posixpath.join(path, f"_attempt-{uuid.uuid4().hex}")
    with filesystem.open_output_stream(attempt, compression=None) as stream:
        yield stream
    filesystem.move(attempt, posixpath.join(path, name))


def shared_input(folder: str, name: str):
    filesystem, path = shared_fs(folder)
    return filesystem.open_input_stream(posixpath.join(path, name), compression=None, buffer_size=1 << 20)


def arrow_rows(batches, *columns: str):
    """Rows of Arrow batches as tuples, ROWS_AT_ONCE of them in memory as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)
