"""Scans and sinks: tables written as the reference's file kinds and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators.segments import QC_FIELDS  # noqa: F401  (columns of the full report)
from lexiloom.operators.splits import split_groups
from lexiloom.plans.profile_queries import SQL_JUDGED, judged_lines
from lexiloom.plans.registry import query, table
from lexiloom.plans.text_queries import documents
from lexiloom.session import scratch_path
from lexiloom.sources import files as R
from lexiloom.sources import sinks as W


@query("report_round_trip", f"""
SELECT l_orderkey::VARCHAR AS segment, l_returnflag AS batch, qc_reasons, l_quantity AS duration_s, CASE WHEN l_tax > 0 THEN l_tax END AS snr FROM ({SQL_JUDGED})""")
def report_round_trip(spark, folder):
    """Verdicts as a CSV report and back; a zero tax is written as nan, which reads as no value."""
    report = judged_lines(spark, folder).select(
        F.col("l_orderkey").cast("string").alias("segment"), F.col("l_returnflag").alias("batch"), "qc_reasons",
        F.col("l_quantity").alias("duration_s"), F.when(F.col("l_tax") > 0, F.col("l_tax").cast("string")).otherwise("nan").alias("snr"),
    )
    path = scratch_path(spark, "report")
    W.write_report(report, path)
    return R.scan_delimited(spark, path, report.columns, ["duration_s", "snr"])


@query("dataset_round_trip", """
SELECT 'doc' || doc_id || '.wav' AS file_name, text, CASE WHEN source IN ('src3', 'src7') THEN 'validation' ELSE 'train' END AS split FROM documents""")
def dataset_round_trip(spark, folder):
    rows = documents(spark, folder, "doc_id", "text", "source").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file_name"), "text", "source"
    )
    path = scratch_path(spark, "dataset")
    W.write_dataset(split_groups(rows, "source", ["src3", "src7"]), path)
    return R.scan_delimited(spark, f"{path}/metadata", ["file_name", "text", "split"])


@query("line_corpus_round_trip", r"""
SELECT line, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY line""")
def line_corpus_round_trip(spark, folder):
    lines = R.split_lines(documents(spark, folder, "doc_id", "text"), ["doc_id"])
    path = scratch_path(spark, "lines")
    W.write_report(lines, path, ["line"], "lines")
    return R.scan_lines(spark, path).groupBy(F.col("text").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("transcript_scan", r"""
SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def transcript_scan(spark, folder):
    """Documents as numbered transcripts, every second line without its number."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit("\t"), l)).otherwise(l))
    raw = documents(spark, folder, "doc_id", "text").select("doc_id", F.concat(F.lit("﻿"), F.array_join(lines, "\n")).alias("raw"))
    return R.transcript_lines(raw, "doc_id", "raw")


@query("interval_scan", """
SELECT vec_id, unnest(range(0, len(embedding))) AS idx, unnest(range(0, len(embedding)))::DOUBLE AS xmin, unnest(range(1, len(embedding) + 1))::DOUBLE AS xmax,
  unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 'word' ELSE '' END)) AS text FROM embeddings""")
def interval_scan(spark, folder):
    """Embeddings as interval files of two tiers, a word wherever the value is positive."""
    row = lambda x, i: F.format_string(
        '        intervals [%d]:\n            xmin = %d\n            xmax = %d\n            text = "%s"\n',
        i + 1, i, i + 1, F.when(x > 0, "word").otherwise(""),
    )
    tier = lambda name: F.concat(
        F.lit(f'    item []:\n        class = "IntervalTier"\n        name = "{name}"\n        xmin = 0\n        xmax = 64\n        intervals: size = 64\n'),
        F.array_join(F.transform("embedding", row), ""),
    )
    raw = table(spark, folder, "embeddings").select(
        "vec_id", F.concat(F.lit('File type = "ooTextFile"\nxmin = 0\nxmax = 64\n'), tier("phones"), tier("words")).alias("raw")
    )
    return R.tier_intervals(raw, "vec_id", "raw")


@query("archive_round_trip", r"""
SELECT 'doc' || doc_id || '.txt' AS file, i - 1 AS line_no, regexp_replace(l[i], '\r+$', '') AS line FROM (
  SELECT doc_id, l, unnest(range(1, len(l) + (CASE WHEN l[len(l)] = '' THEN 0 ELSE 1 END))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def archive_round_trip(spark, folder):
    """Documents as members of zip archives, scanned line by line from their places in them."""
    docs = documents(spark, folder, "doc_id", "text").select(F.format_string("doc%d.txt", "doc_id").alias("file"), "text")
    path = scratch_path(spark, "archives")
    W.write_archives(docs, path)
    return R.scan_archive(spark, path, ["doc"]).select("file", "line_no", "line")


@query("archive_members", "SELECT 'doc' || doc_id || '.txt' AS file, 1::BIGINT AS n FROM documents WHERE doc_id % 3 = 1")
def archive_members(spark, folder):
    """Which members of archives a name picks, by the directories alone."""
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".xml"))
    path = scratch_path(spark, "archives")
    W.write_archives(documents(spark, folder, "doc_id", "text").select(name.alias("file"), "text"), path)
    return R.members(spark, path).where(F.endswith("file", F.lit(".txt"))).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def wav_files(spark, folder):
    """Embeddings as WAV files, every third one at half the rate."""
    rows = table(spark, folder, "embeddings").select(
        F.format_string("clip%d", "vec_id").alias("name"), "embedding", F.when(F.col("vec_id") % 3 == 0, 8000).otherwise(16000).alias("rate"))
    path = scratch_path(spark, "wavs")
    W.write_wavs(rows, path, "name", "embedding", "rate")
    return path


SQL_WAVS = "SELECT 'clip' || vec_id AS stem, CASE WHEN vec_id % 3 = 0 THEN 8000 ELSE 16000 END::BIGINT AS rate, len(embedding)::BIGINT AS frames FROM embeddings"


@query("wav_headers", f"SELECT stem, 1::BIGINT AS channels, 2::BIGINT AS sampwidth, rate, frames, round(frames / rate, 6) AS duration_s FROM ({SQL_WAVS})")
def wav_headers(spark, folder):
    heads = R.scan_wav_headers(spark, wav_files(spark, folder))
    return heads.select("stem", "channels", "sampwidth", "rate", "frames", F.round("duration_s", 6).alias("duration_s"))


@query("wav_violations", f"SELECT stem, 'expected 16000 Hz, got 8000 Hz' AS reason FROM ({SQL_WAVS}) WHERE rate = 8000")
def wav_violations(spark, folder):
    return R.wav_violations(R.scan_wav_headers(spark, wav_files(spark, folder))).select("stem", "reason")


@query("file_inventory", "SELECT 'clip' || vec_id AS stem, 'clip' || vec_id || '.wav' AS file FROM embeddings")
def file_inventory(spark, folder):
    out = R.file_inventory(spark, wav_files(spark, folder), ".wav")
    return out.select("stem", F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
