import pytest
from pyspark.sql import functions as F

from lexiloom.operators import segments as S
from lexiloom.operators.ordered import ordered_scan, quantiles


def frames(spark, levels):
    rows = [(clip, i, float(v)) for clip, vs in levels.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "clip string, frame_no long, level double")


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_pauses_and_trim(spark, chunk):
    df = frames(spark, {"a": [0, 0, 9, 0, 0, 0, 9, 0, 9, 0], "b": [9, 0, 0, 0, 0, 0, 0, 9], "c": [0, 0]})
    got = sorted(map(tuple, S.detect_pauses(df, 5, 2, chunk=chunk).collect()))
    assert got == [("a", 0, 2), ("a", 3, 6), ("b", 1, 7), ("c", 0, 2)]
    trimmed = S.trim_edges(df, 5, chunk=chunk)
    assert [r.level for r in trimmed.where("clip = 'a'").orderBy("frame_no").collect()] == [9, 0, 0, 0, 9, 0, 9]
    assert trimmed.where("clip = 'c'").count() == 0


@pytest.mark.parametrize("chunk", [2, 100])
def test_ordered_scan_crosses_chunks(spark, chunk):
    rows = [(k, i, v) for k in ("x", "y") for i, v in enumerate([3, None, 5, 1, None, 4, 2])]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    out = ordered_scan(
        df, ["k"], ["i"], [F.floor(F.col("i") / chunk)], no=("number",), before=("sum_before", "v"), low=("min_before", "v"),
        seen=("last", "v"), prev=("lag", "v"), nxt=("lead", "v"), n=("count",), top=("max", "v"),
    )
    got = [tuple(r)[2:] for r in out.where("k = 'y'").orderBy("i").collect()]
    assert got == [
        (3, 1, 0, None, 3, None, None, 7, 5), (None, 2, 3, 3, 3, 3, 5, 7, 5), (5, 3, 3, 3, 5, None, 1, 7, 5),
        (1, 4, 8, 3, 1, 5, None, 7, 5), (None, 5, 9, 1, 1, 1, 4, 7, 5), (4, 6, 9, 1, 4, None, 2, 7, 5), (2, 7, 13, 1, 2, 4, None, 7, 5),
    ]


def test_quantiles_match_interpolation(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 10, 10, 50]], "v double")
    got = {r.prob: r.value for r in quantiles(df, [], "v", [0.0, 0.5, 0.9, 1.0], 4.0).collect()}
    assert got == {0.0: 1.0, 0.5: 2.0, 0.9: pytest.approx(26.0), 1.0: 50.0}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_boundaries_and_segments(spark, chunk):
    pauses = spark.createDataFrame(
        [("ok", 10, 21), ("ok", 40, 51), ("ok", 70, 75), ("ok", 90, 96), ("few", 5, 9)], "clip string, start long, end long")
    clips = spark.createDataFrame([("ok", 4, 120), ("few", 4, 30), ("one", 1, 9)], "clip string, n int, length long")
    status, cuts = S.rank_boundaries(pauses, clips, chunk=chunk)
    assert {r.clip: r.status for r in status.collect()} == {"ok": "ranked_ok", "few": "insufficient_pauses", "one": "single_sentence"}
    assert [r.cut for r in cuts.where("clip = 'ok'").orderBy("i").collect()] == [0, 15, 45, 93, 120]
    sentences = spark.createDataFrame([("ok", 1, "s1"), ("ok", 2, "s2"), ("few", 1, "f1")], "clip string, num long, text string")
    intros = spark.createDataFrame([("ok", "Book")], "clip string, intro string")
    rows = S.build_segments(status, cuts, sentences, intros, frame_s=0.5, chunk=chunk).orderBy("segment").collect()
    assert [(r.segment, r.type, r.duration_s, r.confidence, r.reason, r.text) for r in rows] == [
        ("few_seg_001", "whole_chapter_fallback", 15.0, "low", "insufficient_pauses", None),
        ("ok_seg_001", "sentence", 24.0, "low", "duration_outlier", "s1"),
        ("ok_seg_002", "sentence", 13.5, "high", "", "s2"),
        ("ok_seg_book", "book_intro", 7.5, "high", "", "Book"),
        ("ok_seg_chapter_excluded", "chapter_number_excluded", 15.0, "excluded", "chapter_number_text_unknown", None),
        ("one_seg_001", "whole_chapter_fallback", 4.5, "low", "single_sentence", None),
    ]


def test_confidence_bounds_are_inside(spark):
    clips = spark.createDataFrame([("a", 2, 430)], "clip string, n int, length long")
    pauses = spark.createDataFrame([("a", 25, 35)], "clip string, start long, end long")
    status, cuts = S.rank_boundaries(pauses, clips)
    sentences = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "clip string, num long, text string")
    rows = S.build_segments(status, cuts, sentences, frame_s=0.05).orderBy("segment").collect()
    assert [(r.duration_s, r.confidence) for r in rows] == [(1.5, "high"), (20.0, "high")]


def greedy(durations, lo, hi):
    out, cur, g = [], None, -1
    for d in durations:
        if cur is None or (cur >= lo and cur + d > hi):
            g, cur = g + 1, d
        else:
            cur += d
        out.append(g)
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100])
def test_greedy_merge_any_chunking(spark, chunk):
    clips = {
        "exact": [15000, 10000, 1], "long": [90000, 100, 100, 20000], "small": [400] * 90,
        "mixed": [(i * 7919) % 9000 + 100 for i in range(60)],
    }
    rows = [(c, i, d) for c, ds in clips.items() for i, d in enumerate(ds)]
    out = S.merge_runs(spark.createDataFrame(rows, "clip string, idx long, dur long"), chunk=chunk)
    for clip, ds in clips.items():
        assert [r.group_no for r in out.where(F.col("clip") == clip).orderBy("idx").collect()] == greedy(ds, 15000, 25000), clip


def test_greedy_merge_where_the_join_turns_into_a_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"]
    was = {n: spark.conf.get(n, None) for n in names}
    durations = {c: [(i * 7919 + c * 104729) % 30000 + 100 for i in range(40)] for c in range(60)}
    rows = [(c, i, d) for c, ds in durations.items() for i, d in enumerate(ds)]
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "20000")  # the sums fit, the pieces do not
        spark.conf.set(names[2], "false")
        out = S.merge_runs(spark.createDataFrame(rows, "clip int, idx long, dur long").repartition(5, "idx"), chunk=100)
        got = {}
        for r in out.orderBy("clip", "idx").collect():
            got.setdefault(r.clip, []).append(r.group_no)
    finally:
        for n, v in was.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert got == {c: greedy(ds, 15000, 25000) for c, ds in durations.items()}


def test_assign_words(spark):
    groups = spark.createDataFrame([("a", 0, 20000), ("a", 1, 100), ("a", 2, 20000), ("b", 0, 5), ("b", 1, 5)], "clip string, group_no long, dur long")
    words = spark.createDataFrame([("a", [f"w{i}" for i in range(10)]), ("b", ["x"])], "clip string, words array<string>")
    rows = S.assign_words(groups, words, chunk=2).orderBy("clip", "group_no").collect()
    # shares: 5, at least 1 (dropped: under 3 words), the rest
    assert [(r.clip, r.group_no, r.text) for r in rows] == [("a", 0, "w0 w1 w2 w3 w4"), ("a", 2, "w6 w7 w8 w9")]


def test_shift_pairs(spark):
    units = [("ok", i) for i in range(1, 6)] + [("gap", i) for i in (1, 2, 4)] + [("two", 1), ("two", 2)]
    out = S.shift_pairs(spark.createDataFrame(units, "chapter string, num int"), chunk=2)
    assert sorted(map(tuple, out.collect())) == [("ok", 3, 1), ("ok", 4, 2), ("ok", 5, 3)]


def test_silence_metrics(spark):
    rows = [
        ("a", 0, 0.0, 0.5, ""), ("a", 1, 0.5, 1.0, "x"), ("a", 2, 1.0, 3.25, ""), ("a", 3, 3.25, 4.0, "y"), ("a", 4, 4.0, 4.5, ""),
        ("none", 0, 0.0, 1.0, ""), ("late", 0, 1.0, 9.0, "z"),
    ]
    intervals = spark.createDataFrame(rows, "segment string, idx long, xmin double, xmax double, text string")
    durations = spark.createDataFrame([("a", 4.5), ("none", 1.0), ("late", 8.0)], "segment string, duration_s double")
    got = {r.segment: tuple(r)[1:] for r in S.silence_metrics(intervals, durations, chunk=2).collect()}
    assert got == {"a": (0.5, 4.0, 3.5, 0.5, 0.5, 2.25, 2), "late": (1.0, 9.0, 8.0, 1.0, 0.0, 0.0, 1)}


def test_judge(spark):
    fields = "segment string, aligned boolean, wav_path string, txt_path string, speech_duration_s double, overall_log_likelihood double, phone_duration_deviation double, snr double, leading_silence_s double, trailing_silence_s double, max_internal_silence_s double, n_words_aligned int, segmentation_confidence string"
    ok = [True, "w", "t", 5.0, -50.0, 3.0, -99.0, 9.0, 9.0, 1.0, 5, "low"]
    change = lambda **kw: [kw.get(n, v) for n, v in zip(["aligned", "wav", "txt", "dur", "ll", "dev", "snr", "lead", "trail", "gap", "words", "conf"], ok)]
    rows = {
        "pass": ok, "failed": change(aligned=False, dur=0.1), "nofile": change(wav=""), "edge": change(dur=1.5, ll=-70.0, dev=10.0, gap=3.5, words=3),
        "nulls": change(dur=None, ll=None, dev=None, gap=None, words=None), "many": change(dur=0.1, ll=-99.0, words=1), "long": change(dur=20.5, dev=11.0, gap=4.0),
    }
    df = spark.createDataFrame([[k, *v] for k, v in rows.items()], fields)
    got = {r.segment: (r.qc_pass, r.qc_reasons) for r in S.judge(df, S.QC_THRESHOLDS).collect()}
    assert got == {
        "pass": (True, ""), "failed": (False, "alignment_failed"), "nofile": (False, "missing_source_files"), "edge": (True, ""),
        "nulls": (True, ""), "many": (False, "too_short;low_likelihood;too_few_words"), "long": (False, "too_long;phone_duration_outlier;long_internal_silence"),
    }
    strict = {r.segment: r.qc_reasons for r in S.judge(df, {**S.QC_THRESHOLDS, "drop_low_confidence_segments": True, "min_snr": 0.0}).collect()}
    assert strict["pass"] == "low_snr;segmentation_low_confidence"


def test_manifest(spark):
    qc = spark.createDataFrame(
        [("A_1_seg_001", "A_1", "A", True, 1.0, 2.0), ("B_1_seg_001", "B_1", "B", True, 0.05, 9.0), ("B_1_seg_002", "B_1", "B", True, 5.0, 4.0),
         ("B_1_seg_003", "B_1", "B", True, 1.0, 2.0), ("B_1_seg_004", "B_1", "B", True, 1.0, 2.0), ("B_1_seg_005", "B_1", "B", False, 1.0, 2.0)],
        "segment string, chapter string, book string, qc_pass boolean, speech_begin_s double, speech_end_s double")
    texts = spark.createDataFrame(
        [("A_1_seg_001", "एक दुई तीन"), ("B_1_seg_001", "एक २ दुई तीन"), ("B_1_seg_002", "a b c"), ("B_1_seg_003", "a १२ b")], "segment string, text string")
    headers = spark.createDataFrame([(f"{c}_1_seg_00{i}", 80000) for c, i in (("A", 1), ("B", 1), ("B", 2), ("B", 3), ("B", 4))], "segment string, frames long")
    kept, skipped = S.build_manifest(qc, texts, headers, ["B_1"])
    assert sorted(tuple(r) for r in kept.collect()) == [
        ("A_1_seg_001.wav", "एक दुई तीन", "A_1_seg_001", "A_1", "A", 1.2, "train"),
        ("B_1_seg_001.wav", "एक दुई तीन", "B_1_seg_001", "B_1", "B", 5.0, "validation"),
    ]
    assert {r.segment: r.reason for r in skipped.collect()} == {
        "B_1_seg_002": "empty trim range 78400:65600", "B_1_seg_003": "under 3 words after cleaning", "B_1_seg_004": "source file missing"}
    with pytest.raises(ValueError):
        S.build_manifest(qc, texts, headers, ["missing"])


@pytest.mark.parametrize("chunk", [2, 50])
def test_best_epoch(spark, chunk):
    logs = {"stop": [5, 4, 4, 6, 3], "never": [3, 2, 1], "late": [5, 6, 4, 4, 9, 1]}
    rows = [(r, i + 1, float(v)) for r, vs in logs.items() for i, v in enumerate(vs)]
    out = S.best_epoch(spark.createDataFrame(rows, "run string, epoch int, val double"), 2, chunk=chunk)
    assert {r.run: (r.best_epoch, r.best_value, r.stopped_at) for r in out.collect()} == {
        "stop": (2, 4.0, 4), "never": (3, 1.0, None), "late": (3, 4.0, 5)}


def test_chapter_sentences(spark):
    lines = [("c", 0, "मत्ती."), ("c", 1, "१."), ("c", 2, "एक दुई"), ("c", 3, "तीन। चार"), ("c", 4, "मर्कूस."), ("c", 5, "पाँच॥ छ")]
    routed = S.route_lines(spark.createDataFrame(lines, "chapter string, line_no int, text string"))
    assert [r.intro for r in S.book_intros(routed).collect()] == ["मत्ती"]
    got = S.chapter_sentences(routed).orderBy("num").collect()
    assert [(r.num, r.text) for r in got] == [(1, "एक दुई तीन।"), (2, "चार पाँच॥"), (3, "छ")]


def test_quality_record_without_words_fails(spark):
    """Repeated report rows, a tier without words, and a segment without an interval file."""
    analysis = spark.createDataFrame(
        [("B_1_seg_1", 0.0, 9.0), ("B_1_seg_2", None, 9.0), ("B_1_seg_3", 0.0, 9.0)], "segment string, begin double, end double"
    ).selectExpr("*", "-50.0D AS overall_log_likelihood", "0.0D AS speech_log_likelihood", "1.0D AS phone_duration_deviation", "CAST(NULL AS DOUBLE) AS snr")
    report = spark.createDataFrame([("B_1_seg_1", "c", "low", "x"), ("B_1_seg_1", "c", "high", "")], "segment string, chapter string, confidence string, reason string").coalesce(1)
    files = spark.createDataFrame([("B_1_seg_1", "/1"), ("B_1_seg_2", "/2"), ("B_1_seg_3", "/3")], "stem string, path string")
    word = lambda s, i, t: (s, i, i * 1.0, i + 0.8, t)
    intervals = spark.createDataFrame(
        [word("B_1_seg_1", i, "w") for i in range(5)] + [word("B_1_seg_2", i, "") for i in range(5)] + [word("B_1_seg_3", i, "w") for i in range(5)],
        "segment string, idx long, xmin double, xmax double, text string")
    out = S.collect_record(analysis, report, files.where("stem <> 'B_1_seg_3'"), files, files, intervals, "b1")
    assert out.columns == S.QC_FIELDS
    rows = {r.segment: r for r in out.collect()}
    assert len(rows) == out.count() == 3
    assert (rows["B_1_seg_1"].qc_pass, rows["B_1_seg_1"].segmentation_confidence, rows["B_1_seg_1"].n_words_aligned) == (True, "high", 5)
    assert (rows["B_1_seg_2"].aligned, rows["B_1_seg_2"].qc_reasons, rows["B_1_seg_2"].duration_s) == (False, "alignment_failed", 9.0)
    assert (rows["B_1_seg_3"].aligned, rows["B_1_seg_3"].speech_begin_s, rows["B_1_seg_3"].chapter) == (False, None, "B_1")
