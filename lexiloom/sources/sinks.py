"""Report and dataset sinks."""

from __future__ import annotations

import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.ranged import whole_file


# Cells come back as they were: blanks and line breaks kept, quotes doubled.
CELLS = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def write_report(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write the named columns in their order as csv, tsv, json or plain lines."""
    out = df.select(*(columns or df.columns)).write.mode(mode)
    if fmt in ("csv", "tsv"):
        out.csv(path, sep="," if fmt == "csv" else "\t", nullValue="", **CELLS)
    elif fmt == "json":
        out.json(path, ignoreNullFields=False)
    elif fmt == "lines":
        out.text(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def write_dataset(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """The full manifest, and per split a two-column metadata set below ``metadata/split=...``.

    The two stand apart so that a loader walking one split never meets the
    manifest's extra columns.
    """
    df.write.mode(mode).csv(f"{path}/manifest", **CELLS)
    (
        df.select("file_name", "text", split)
        .write.mode(mode).partitionBy(split).csv(f"{path}/metadata", **CELLS)
    )


def write_lexicon(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``word TAB phone phone ...`` lines."""
    df.select(F.concat_ws("\t", "word", F.array_join("phones", " ")).alias("value")).write.mode(mode).text(path)


def write_archives(df: DataFrame, path: str, file: str = "file", text: str = "text", members: int = 1024) -> None:
    """Zip archives of the rows' texts, up to ``members`` in each, below ``path``; a null text is an empty member.

    Rows are dealt by ``file`` and put in its order, so a repeated task writes the same archives again, under the same
    names.
    """

    def write(frames):
        part, held, nth = TaskContext.get().partitionId(), [], 0

        def archive():
            with whole_file(path, f"part-{part:05}-{nth:05}.zip") as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in held:
                    # a date of its own would make equal archives differ
                    z.writestr(zipfile.ZipInfo(name), content or "", zipfile.ZIP_DEFLATED)

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                held.append(tuple(row))
                if len(held) == members:
                    archive()
                    held, nth = [], nth + 1
        if held:
            archive()
        yield pd.DataFrame({"written": [nth]})

    rows = df.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text"))
    rows.repartition("file").sortWithinPartitions("file", "text").mapInPandas(write, "written long").count()


def write_wavs(df: DataFrame, path: str, name: str, samples: str, rate: str, channels: int = 1) -> None:
    """A WAV file of 16-bit samples for each row, named by ``name``; ``samples`` holds numbers from -1 to 1, ``rate`` is a column."""

    def write(frames):
        for pdf in frames:
            for stem, values, hertz in pdf.itertuples(index=False):
                with whole_file(path, f"{stem}.wav") as stream:
                    data = (np.clip(np.asarray(values, "float64"), -1, 1) * 32767).astype("<i2").tobytes()
                    width = 2 * channels
                    stream.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, hertz, hertz * width, width, 16, b"data", len(data)))
                    stream.write(data)
            yield pd.DataFrame({"written": [len(pdf)]})

    df.select(F.col(name).cast("string").alias("name"), F.col(samples).alias("samples"), F.col(rate).cast("int").alias("rate")).mapInPandas(write, "written long").count()
