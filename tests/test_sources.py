import io
import os
import struct
import tracemalloc
import wave
import zipfile

import pytest

from lexiloom.sources import files as R
from lexiloom.sources import ranged
from lexiloom.sources import sinks as W


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("46-MATx.usfm", "\\id MAT\n\\v 1 एक\n")
        z.writestr("47-MRKx.usfm", "no\n")
        z.writestr("readme.txt", "hello")
    path = str(tmp_path / "a.zip")
    rows = R.scan_archive(spark, path, ["-MATx"], batch=1).orderBy("line_no").collect()
    assert [(r.file, r.line_no, r.line) for r in rows] == [("46-MATx.usfm", 0, "\\id MAT"), ("46-MATx.usfm", 1, "\\v 1 एक")]
    assert R.archive_member(spark, path, "readme.txt").first().text == "hello"
    assert R.archive_member(spark, path, "absent.txt").first().text is None


def test_transcripts_and_lines(spark, tmp_path):
    (tmp_path / "MAT_001.txt").write_text("﻿1\tfirst\ttab\nno tab\n3\tlast", encoding="utf-8")
    rows = R.scan_transcripts(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.chapter, r.line_no, r.text) for r in rows] == [("MAT_001", 0, "first\ttab"), ("MAT_001", 1, "no tab"), ("MAT_001", 2, "last")]
    other = tmp_path / "lines"
    other.mkdir()
    (other / "x.txt").write_text("é\n\n  \nb\n", encoding="utf-8")
    assert sorted(r.text for r in R.scan_lines(spark, str(other)).collect()) == ["b", "é"]


def test_delimited_null_texts(spark, tmp_path):
    (tmp_path / "r.csv").write_text('file,begin,snr,note\na,1.5,nan,"x, y"\nb,,NaN,\nc,oops,3,"q ""z"""\n')
    rows = R.scan_delimited(spark, str(tmp_path / "r.csv"), ["file", "begin", "snr", "note", "absent"], ["begin", "snr"]).orderBy("file").collect()
    assert [tuple(r) for r in rows] == [("a", 1.5, None, "x, y", None), ("b", None, None, "", None), ("c", None, 3.0, 'q "z"', None)]


GRID = '''File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 2
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "IntervalTier"
        name = "words"
        xmin = 0
        xmax = 2
        intervals: size = 2
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = ""
        intervals [2]:
            xmin = 0.5
            xmax = 2
            text = "शब्द"
    item [2]:
        class = "IntervalTier"
        name = "phones"
        xmin = 0
        xmax = 2
        intervals: size = 1
        intervals [1]:
            xmin = 0
            xmax = 2
            text = "p"
'''


def test_intervals_and_inventory(spark, tmp_path):
    deep = tmp_path / "speaker1"
    deep.mkdir()
    (deep / "A_seg_001.TextGrid").write_text(GRID, encoding="utf-8")
    (deep / "other.txt").write_text("x")
    rows = R.scan_intervals(spark, str(tmp_path)).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [("A_seg_001", 0, 0.0, 0.5, ""), ("A_seg_001", 1, 0.5, 2.0, "शब्द")]
    assert R.scan_intervals(spark, str(tmp_path), "phones").count() == 1
    assert [r.stem for r in R.file_inventory(spark, str(tmp_path), ".txt").collect()] == ["other"]


def wav(path, channels, width, rate, frames):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"\0" * channels * width * frames)


def test_wav_headers(spark, tmp_path):
    wav(tmp_path / "mono.wav", 1, 2, 16000, 8000)
    wav(tmp_path / "stereo.wav", 2, 2, 16000, 100)
    wav(tmp_path / "slow.wav", 1, 2, 8000, 100)
    (tmp_path / "broken.wav").write_bytes(b"not audio")
    # a chunk longer than any prefix stands before the samples
    data = (tmp_path / "mono.wav").read_bytes()
    note = b"LIST" + (200_001).to_bytes(4, "little") + b"x" * 200_002
    (tmp_path / "noted.wav").write_bytes(data[:4] + (len(data) + len(note) - 8).to_bytes(4, "little") + data[8:12] + note + data[12:])
    heads = R.scan_wav_headers(spark, str(tmp_path))
    got = {r.stem: (r.channels, r.sampwidth, r.rate, r.frames, r.duration_s) for r in heads.collect()}
    assert got["mono"] == (1, 2, 16000, 8000, 0.5)
    assert got["noted"] == got["mono"]
    assert got["broken"] == (None, None, None, None, 0.0)
    assert {r.stem: r.reason for r in R.wav_violations(heads).collect()} == {
        "stereo": "expected 1ch/16-bit, got 2ch/16-bit", "slow": "expected 16000 Hz, got 8000 Hz", "broken": "unreadable header"}


def test_vocab_and_sinks(spark, tmp_path):
    (tmp_path / "m.vocab").write_text('<pad>\t0\n<unk>\t0\n"\t-2.5\n▁a\t-3\n', encoding="utf-8")
    rows = R.scan_vocab(spark, str(tmp_path / "m.vocab")).orderBy("piece_id").collect()
    assert [tuple(r) for r in rows] == [(0, "<pad>", 0.0), (1, "<unk>", 0.0), (2, '"', -2.5), (3, "▁a", -3.0)]
    df = spark.createDataFrame([("a.wav", "x, y", "s1", "train"), ("b.wav", 'q "z"', "s2", "validation")], "file_name string, text string, segment string, split string")
    W.write_dataset(df, str(tmp_path / "d"))
    back = spark.read.csv(str(tmp_path / "d" / "metadata"), header=True, escape='"')
    assert sorted(tuple(r) for r in back.select("file_name", "text", "split").collect()) == [("a.wav", "x, y", "train"), ("b.wav", 'q "z"', "validation")]
    W.write_report(df, str(tmp_path / "j"), ["segment", "split"], "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lexicon = spark.createDataFrame([("क", ["k", "a"])], "word string, phones array<string>")
    W.write_lexicon(lexicon, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first().value == "क\tk a"


def test_cells_with_line_breaks_come_back(spark, tmp_path):
    texts = ["two\nlines", ' blanks around ', 'a "quoted",\n\n"cell"', "", "tab\there", "plain"]
    df = spark.createDataFrame([(f"{i}.wav", t, f"s{i}", "train") for i, t in enumerate(texts)], "file_name string, text string, segment string, split string")
    for fmt, sep in (("csv", ","), ("tsv", "\t")):
        W.write_report(df, str(tmp_path / fmt), fmt=fmt)
        back = R.scan_delimited(spark, str(tmp_path / fmt), df.columns, sep=sep)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    W.write_dataset(df, str(tmp_path / "d"))
    for part in ("manifest", "metadata"):
        rows = R.scan_delimited(spark, str(tmp_path / "d" / part), ["file_name", "text", "split"]).collect()
        assert sorted(r.text for r in rows) == sorted(texts)


def test_streams_read_files_and_folders(spark, tmp_path):
    from lexiloom.streaming import verdicts as X

    df = spark.range(1000).withColumnRenamed("id", "x")
    df.repartition(4).write.parquet(str(tmp_path / "t.parquet"))
    one = tmp_path / "one"
    df.coalesce(1).write.parquet(str(one))
    next(one.glob("part-*")).rename(tmp_path / "single.parquet")
    for name in ("t.parquet", "single.parquet"):
        assert X.drain(X.read_stream(spark, str(tmp_path), name, df.schema), "rows").count() == 1000


def test_lines_of_pieces():
    text = "one\r\ntwo\n\nlast é"
    data = text.encode()
    for size in (1, 2, 3, 7, 100):
        pieces = [data[i : i + size] for i in range(0, len(data), size)]
        assert list(ranged.lines_of(iter(pieces))) == ["one", "two", "", "last é"]
    assert list(ranged.lines_of(iter([]))) == list(ranged.lines_of(iter([b""]))) == [] and list(ranged.lines_of(iter([b"\n"]))) == [""]


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_members_by_their_place(tmp_path, monkeypatch, method):
    """Stored and packed members of any size, also such that unpack to far more than they are."""
    contents = {"empty": b"", "folder/small.txt": b"x\n", "zeros": b"0" * 3_000_000, "noise": os.urandom(2_500_000)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", method) as z:
        z.mkdir("folder")
        for name, data in contents.items():
            z.writestr(name, data)
    monkeypatch.setattr(ranged, "PIECE", 1 << 16)
    with ranged.open_ranged(str(tmp_path / "a.zip")) as stream:
        found = list(ranged.archive_members(stream))
        assert {m[0]: b"".join(ranged.member_bytes(stream, *m[1:])) for m in found} == contents
        assert all(len(p) <= 1 << 16 for m in found for p in ranged.member_bytes(stream, *m[1:]))
        with pytest.raises(ValueError, match="no member"):
            next(ranged.member_bytes(stream, found[2][1] + 1, 5, 0))


def test_archive_beyond_four_gigabytes(tmp_path):
    """Members behind a hole of five gigabytes are read without it: places need 64-bit fields."""
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate(5 << 30)
        f.seek(0, io.SEEK_END)
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("late-MATx.usfm", "\\id MAT\n" * 50_000)
    tracemalloc.start()
    with ranged.open_ranged(str(path)) as stream:
        ((name, offset, size, method),) = ranged.archive_members(stream)
        assert offset > 4 << 30 and sum(1 for _ in ranged.lines_of(ranged.member_bytes(stream, offset, size, method))) == 50_000
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()


def test_scan_of_a_large_archive(spark, tmp_path):
    path = tmp_path / "large.zip"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
        f.seek(0, io.SEEK_END)
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("a.txt", "one\ntwo")
            z.writestr("b.txt", "no")
    assert [(r.file, r.line_no, r.line) for r in R.scan_archive(spark, str(path), ["a."]).orderBy("line_no").collect()] == [("a.txt", 0, "one"), ("a.txt", 1, "two")]
    assert R.archive_member(spark, str(path), "b.txt").first().text == "no"


def test_wav_header_behind_a_chunk_of_gigabytes(tmp_path):
    """Of a file of 3 GB a few heads are read."""
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(struct.pack("<4sI4s", b"RIFF", 0xFFFFFFFF, b"WAVE") + struct.pack("<4sI", b"LIST", 3_000_000_001))
        f.seek(3_000_000_002, io.SEEK_CUR)
        f.write(struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 44100, 176400, 4, 16) + struct.pack("<4sI", b"data", 400))
    tracemalloc.start()
    with ranged.open_ranged(str(path)) as stream:
        assert ranged.wav_header(stream, path.stat().st_size) == (2, 2, 44100, 100)
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()
    assert ranged.wav_header(io.BytesIO(b"RIFF\0\0\0\0WAVE" + b"fmt "), 16) is None


def test_archives_written_and_read(spark, tmp_path):
    rows = [(f"m{i}", f"line {i}\nnext" if i % 5 else None) for i in range(40)]
    path = str(tmp_path / "out")
    W.write_archives(spark.createDataFrame(rows, "file string, text string"), path, members=7)
    assert all(n.endswith(".zip") for n in os.listdir(path) if not n.startswith("."))
    got = R.scan_archive(spark, path).select("file", "line_no", "line").collect()
    assert sorted(tuple(r) for r in got) == sorted((f"m{i}", n, l) for i in range(40) if i % 5 for n, l in enumerate((f"line {i}", "next")))
    assert R.members(spark, path).count() == 40
