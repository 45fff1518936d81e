"""Scans of corpus, transcript, report, interval, audio-header and vocabulary files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lexiloom.functions import text as T
from lexiloom.sources.ranged import archive_members, lines_of, member_bytes, open_ranged, wav_header

_LINE = "(?:\r\n|\r|\n)"


def file_stem(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, file, offset, size, method) of all members of the archives, which are not read for it.

    Only the directory at an archive's end is; a member's name may stand in several archives.
    """

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for archive in pdf["path"]:
                with open_ranged(archive) as stream:
                    rows = [(archive, *m) for m in archive_members(stream)]
                yield pd.DataFrame(rows, columns=["archive", "file", "offset", "size", "method"])

    paths = spark.read.format("binaryFile").load(path).select("path")
    return paths.mapInPandas(listed, "archive string, file string, offset long, size long, method int")


def scan_archive(spark: SparkSession, path: str, codes: list[str] | None = None, batch: int = 4096) -> DataFrame:
    """(archive, file, line_no, line) of the zip members whose name holds one of the codes.

    Members are dealt to the tasks one by one, not by archive; a task goes to its member's place in the
    archive and streams it line by line, so neither an archive nor a member is ever held whole, and
    members that are not wanted are not read.
    """

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for archive, name, *place in pdf[["archive", "file", "offset", "size", "method"]].itertuples(index=False):
                rows = []
                with open_ranged(archive) as stream:
                    for no, line in enumerate(lines_of(member_bytes(stream, *map(int, place)))):
                        rows.append((archive, name, no, line))
                        if len(rows) == batch:
                            yield pd.DataFrame(rows, columns=["archive", "file", "line_no", "line"])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "file", "line_no", "line"])

    wanted = members(spark, path)
    if codes is not None:
        wanted = wanted.where(reduce(Column.__or__, [F.contains("file", F.lit(c)) for c in codes], F.lit(False)))
    return wanted.repartition("archive", "offset").mapInPandas(lines, "archive string, file string, line_no long, line string")


def archive_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, text): one member's text per archive, null where it is absent."""

    @F.pandas_udf("string")
    def read(archive: pd.Series) -> pd.Series:
        def one(uri):
            with open_ranged(uri) as stream:
                # of members of one name the last counts
                found = [place for name, *place in archive_members(stream) if name == member]
                return b"".join(member_bytes(stream, *found[-1])).decode("utf-8") if found else None

        return archive.map(one)

    paths = spark.read.format("binaryFile").load(path).select("path")
    return paths.select(F.col("path").alias("archive"), read("path").alias("text"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): composed lines that are not blank. Spark keeps no line order here."""
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), T.nfc("value").alias("text"))
        .where(T.strip_space("text") != "")
    )


def split_lines(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The non-blank composed lines of a text column with their number in the text."""
    return (
        df.select(*keep, F.posexplode(F.split(text, _LINE)).alias("line_no", "line"))
        .where(T.strip_space("line") != "")
        .select(*keep, F.col("line_no").cast("long"), T.nfc("line").alias("line"))
    )


def scan_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, line_no, text) from files of ``number TAB text``; a missing tab and a byte-order mark are tolerated."""
    raw = spark.read.text(path, wholetext=True).select(file_stem("_metadata.file_path").alias("chapter"), "value")
    return transcript_lines(raw, "chapter", "value")


def transcript_lines(df: DataFrame, key: str, raw: str) -> DataFrame:
    body = F.regexp_replace(raw, "^\ufeff", "")
    return (
        df.select(key, F.posexplode(F.split(body, _LINE)).alias("line_no", "__l"))
        .withColumn("__p", F.split("__l", "\t", 2))
        .select(key, F.col("line_no").cast("long"), F.coalesce(F.get("__p", F.lit(1)), F.get("__p", F.lit(0))).alias("text"))
    )


# Texts that mean "no value" in reports.
NULL_TEXTS = ("", "nan", "NaN")


def number_or_null(col: Column | str) -> Column:
    """A double, or null for the null texts and for text that is not a number."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~col.isin(*NULL_TEXTS), F.trim(col).try_cast("double"))


def scan_delimited(spark: SparkSession, path: str, columns: list[str], numeric: list[str] = (), sep: str = ",", multi_line: bool = True) -> DataFrame:
    """A headed CSV or TSV; every cell is text until the named columns are cast.

    Columns are taken by header name, and one the file lacks reads as null. An
    empty cell is the empty text. Quoted cells may hold line breaks; a file known to have none
    can be split over tasks with ``multi_line=False``.
    """
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"', emptyValue="", lineSep="\n")
    present = set(raw.columns)
    cells = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in present else F.lit(None).cast("string") for c in columns}
    return raw.select(*[(number_or_null(v) if c in numeric else v).alias(c) for c, v in cells.items()])


def scan_intervals(spark: SparkSession, path: str, tier: str = "words") -> DataFrame:
    """(segment, idx, xmin, xmax, text) of one tier of long-form TextGrid files."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.TextGrid", recursiveFileLookup=True)
    return tier_intervals(raw.select(file_stem("_metadata.file_path").alias("segment"), "value"), "segment", "value", tier)


def tier_intervals(df: DataFrame, key: str, raw: str, tier: str = "words") -> DataFrame:
    """An interval is an xmin, xmax and text line in a row, which skips the tier's own bounds."""
    after = F.regexp_extract(raw, f'(?s)name = "{tier}"[ \t]*\r?\n(.*?)(?:\n[ \t]*name = |\\z)', 1)
    triple = r'xmin = (\S+)\s+xmax = (\S+)\s+text = "?([^\r\n]*?)"?[ \t]*(?=\r?\n|\z)'
    part = lambda i: F.regexp_extract_all("__t", F.lit(triple), F.lit(i))
    return (
        df.select(key, after.alias("__t"))
        .select(key, F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("idx", "r"))
        .select(
            key, F.col("idx").cast("long"),
            F.col("r.a").cast("double").alias("xmin"), F.col("r.b").cast("double").alias("xmax"),
            F.trim("r.c").alias("text"),
        )
    )


WAV_SCHEMA = ST.StructType([
    ST.StructField("channels", ST.LongType()),
    ST.StructField("sampwidth", ST.LongType()),
    ST.StructField("rate", ST.LongType()),
    ST.StructField("frames", ST.LongType()),
])


@F.pandas_udf(WAV_SCHEMA)
def _wav_udf(path: pd.Series, length: pd.Series) -> pd.DataFrame:
    rows = []
    for uri, size in zip(path, length):
        with open_ranged(uri) as stream:
            rows.append(wav_header(stream, size) or (None, None, None, None))
    return pd.DataFrame(rows, columns=["channels", "sampwidth", "rate", "frames"]).astype("Int64")


def scan_wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, channels, sampwidth, rate, frames, duration_s); an unreadable file lasts 0 s."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    # a chunk of any length may stand before the samples; the heads of chunks are read, their contents not
    return (
        raw.select("path", file_stem("path").alias("stem"), _wav_udf("path", "length").alias("h"))
        .select("path", "stem", "h.*")
        .withColumn("duration_s", F.coalesce(F.try_divide("frames", "rate"), F.lit(0.0)))
    )


def wav_violations(headers: DataFrame, rate: int = 16000, channels: int = 1, sampwidth: int = 2) -> DataFrame:
    """Rows whose format is not the expected one, with the reason."""
    reason = (
        F.when(F.col("rate").isNull(), "unreadable header")
        .when((F.col("channels") != channels) | (F.col("sampwidth") != sampwidth),
              F.format_string(f"expected {channels}ch/{sampwidth * 8}-bit, got %dch/%d-bit", "channels", F.col("sampwidth") * 8))
        .when(F.col("rate") != rate, F.format_string(f"expected {rate} Hz, got %d Hz", "rate"))
    )
    return headers.withColumn("reason", reason).where(F.col("reason").isNotNull())


def file_inventory(spark: SparkSession, paths: list[str] | str, suffix: str) -> DataFrame:
    """(stem, path) of the files ending in ``suffix`` below the folders; contents are not read.

    Where folders repeat a stem, the last path in name order stands for it.
    """
    raw = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")
        .load(paths)
    )
    return raw.groupBy(file_stem("path").alias("stem")).agg(F.max("path").alias("path"))


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(piece_id, piece, score) of a piece file; ids are line positions.

    A piece file is one small file (its size is the vocabulary's), read as one
    text so that line positions are certain.
    """
    raw = spark.read.text(path, wholetext=True)
    return (
        raw.select(F.posexplode(F.split("value", _LINE)).alias("piece_id", "__l"))
        .where(F.col("__l") != "")
        .select(
            "piece_id",
            F.regexp_extract("__l", "^(.*)\t([^\t]*)$", 1).alias("piece"),
            F.regexp_extract("__l", "^(.*)\t([^\t]*)$", 2).cast("double").alias("score"),
        )
    )
