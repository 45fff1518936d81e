"""Frames, pauses, segments, word intervals, quality verdicts and the manifest.

Recordings appear as frame tables (clip, frame_no, level). A clip may be very
long, so ordered steps go through ``ordered_scan`` in chunks of frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.functions import text as T
from lexiloom.operators.joins import enrich_segments
from lexiloom.operators.ordered import ordered_scan
from lexiloom.session import cut_lineage

FRAME_CHUNK = 1 << 16


def _chunk(col: str, size: int = FRAME_CHUNK) -> list[Column]:
    return [F.floor(F.col(col) / size)]


# ---------------------------------------------------------------- headers

def route_lines(lines: DataFrame, key: str = "chapter", rules: T.TranscriptRules = T.DEVANAGARI_TRANSCRIPT) -> DataFrame:
    """Each line with ``kind`` (book, chapter, body), cleaned text and counts."""
    kind = F.when(T.book_line("text", rules), "book").when(T.chapter_line("text", rules), "chapter").otherwise("body")
    cleaned = T.clean_transcript("text", rules)
    return (
        lines.select(key, "line_no", "text", kind.alias("kind"), cleaned.alias("__c"))
        .select(
            key, "line_no", "kind", F.col("text").alias("raw"),
            F.when(F.col("kind") == "body", F.col("__c.text")).otherwise("").alias("text"),
            F.when(F.col("kind") == "body", F.col("__c.dropped")).otherwise(0).alias("dropped"),
            T.word_count("text").cast("long").alias("words_before"),
        )
    )


def book_intros(routed: DataFrame, key: str = "chapter", rules: T.TranscriptRules = T.DEVANAGARI_TRANSCRIPT) -> DataFrame:
    """The first book line of each chapter without its closing marks."""
    name = T.strip_space(F.rtrim(T.strip_space("raw"), F.lit(rules.terminal)))
    return routed.where(F.col("kind") == "book").groupBy(key).agg(F.min_by(name, "line_no").alias("intro"))


def chapter_sentences(routed: DataFrame, key: str = "chapter", terminators: str = T.DANDA) -> DataFrame:
    """Sentences of the chapter text as if its cleaned lines were joined by spaces.

    The chapter is never put together: a running count of terminators numbers
    the sentence each line piece belongs to, and only the pieces of one
    sentence meet.
    """
    ends = f"[{T.char_class(terminators)}]"
    body = routed.where(F.col("text") != "").select(
        key, "line_no", "text", F.regexp_count("text", F.lit(ends)).cast("long").alias("__ends")
    )
    numbered = ordered_scan(body, [key], ["line_no"], _chunk("line_no"), __before=("sum_before", "__ends"))
    pieces = numbered.select(
        key, "line_no", "__before", F.posexplode(F.split("text", f"(?<={ends})")).alias("__i", "piece")
    )
    joined = pieces.groupBy(key, (F.col("__before") + F.col("__i")).alias("__s")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "piece"))).alias("parts")
    )
    text = T.strip_space(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["piece"]), " "), " {2,}", " "))
    kept = cut_lineage(joined.select(key, "__s", text.alias("text")).where(F.col("text") != ""), "sentences")
    return ordered_scan(kept, [key], ["__s"], _chunk("__s"), num=("number",)).select(key, "num", "text")


# ---------------------------------------------------------------- pauses

def number_frames(df: DataFrame, clip: str, order: list[str], chunk: list[Column]) -> DataFrame:
    """Add ``frame_no`` from 0 within the clip."""
    out = ordered_scan(df, [clip], order, chunk, __n=("number",))
    return out.withColumn("frame_no", F.col("__n") - 1).drop("__n")


def detect_pauses(frames: DataFrame, threshold: float, min_len: int, clip: str = "clip", chunk: int = FRAME_CHUNK) -> DataFrame:
    """Maximal runs of frames below the threshold lasting ``min_len`` frames: (clip, start, end), end exclusive.

    Runs are found inside chunks of consecutive frames; the at most two runs
    of a chunk that touch its borders are stitched afterwards.
    """
    quiet = frames.where(F.col("level") < threshold).select(clip, "frame_no", F.floor(F.col("frame_no") / chunk).alias("__ch"))
    local = Window.partitionBy(clip, "__ch").orderBy("frame_no")
    runs = (
        quiet.withColumn("__island", F.col("frame_no") - F.row_number().over(local))
        .groupBy(clip, "__ch", "__island")
        .agg(F.min("frame_no").alias("start"), (F.max("frame_no") + 1).alias("end"))
    )
    border = (F.col("start") == F.col("__ch") * chunk) | (F.col("end") == (F.col("__ch") + 1) * chunk)
    inner = runs.where(~border).select(clip, "start", "end")
    by_clip = Window.partitionBy(clip).orderBy("start")
    fresh = F.when(F.lag("end").over(by_clip) == F.col("start"), 0).otherwise(1)
    stitched = (
        runs.where(border).withColumn("__fresh", fresh)
        .withColumn("__run", F.sum("__fresh").over(by_clip))
        .groupBy(clip, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select(clip, "start", "end")
    )
    return inner.unionByName(stitched).where(F.col("end") - F.col("start") >= min_len)


def trim_edges(frames: DataFrame, threshold: float, clip: str = "clip", chunk: int = FRAME_CHUNK) -> DataFrame:
    """Drop quiet frames before the first and after the last loud one; positions restart at 0."""
    loud = F.when(F.col("level") >= threshold, F.col("frame_no"))
    bounds = ordered_scan(
        frames, [clip], ["frame_no"], _chunk("frame_no", chunk), __lo=("min", loud), __hi=("max", loud)
    )
    kept = bounds.where((F.col("frame_no") >= F.col("__lo")) & (F.col("frame_no") <= F.col("__hi")))
    return kept.withColumn("frame_no", F.col("frame_no") - F.col("__lo")).drop("__lo", "__hi")


def clip_lengths(frames: DataFrame, clip: str = "clip") -> DataFrame:
    return frames.groupBy(clip).agg((F.max("frame_no") + 1).alias("length"))


def rank_boundaries(pauses: DataFrame, clips: DataFrame, clip: str = "clip", chunk: int = FRAME_CHUNK) -> tuple[DataFrame, DataFrame]:
    """Keep the n-1 longest pauses of each clip as cuts at their integer midpoints.

    ``clips`` is (clip, n, length). Returns the status per clip
    (``single_sentence``, ``insufficient_pauses``, ``ranked_ok``) and the cut
    points (clip, i, cut) from 0 to the clip length. Equal lengths go to the
    earlier pause.
    """
    found = pauses.groupBy(clip).agg(F.count(F.lit(1)).alias("pauses"))
    status = clips.join(found, clip, "left").fillna(0, ["pauses"]).withColumn(
        "status",
        F.when(F.col("n") <= 1, "single_sentence")
        .when(F.col("pauses") < F.col("n") - 1, "insufficient_pauses")
        .otherwise("ranked_ok"),
    )
    shortness = pauses.withColumn("__short", F.col("start") - F.col("end"))
    wanted = status.where(F.col("status") == "ranked_ok").select(clip, "n")
    ranked = ordered_scan(
        shortness, [clip], ["__short", "start"], [F.col("__short"), F.floor(F.col("start") / chunk)], wanted, __rank=("number",)
    )
    chosen = ranked.where(F.col("__rank") <= F.col("n") - 1)
    middles = chosen.select(clip, F.floor((F.col("start") + F.col("end")) / 2).alias("cut"))
    edges = status.select(clip, F.explode(F.array(F.lit(0).cast("long"), F.col("length").cast("long"))).alias("cut"))
    cuts = ordered_scan(middles.unionByName(edges), [clip], ["cut"], _chunk("cut", chunk), __i=("number",))
    return status, cuts.select(clip, (F.col("__i") - 1).alias("i"), "cut")


# Seconds between which a segment counts as plausible.
CONFIDENT_SECONDS = (1.5, 20.0)


def build_segments(
    status: DataFrame,
    cuts: DataFrame,
    sentences: DataFrame,
    intros: DataFrame | None = None,
    clip: str = "clip",
    frame_s: float = 0.001,
    confident: tuple[float, float] = CONFIDENT_SECONDS,
    chunk: int = FRAME_CHUNK,
) -> DataFrame:
    """Segment rows between consecutive cuts.

    ``sentences`` is (clip, num from 1, text), ``intros`` is (clip, intro). A
    clip with an intro gives its first two pieces to the intro and to the
    chapter number, which is excluded. A clip that could not be cut becomes
    one fallback row whose text stays in ``sentences``.
    """
    per_clip = sentences.groupBy(clip).agg(F.max("num").alias("n_sentences"))
    clips = status.join(per_clip, clip, "left").fillna(0, ["n_sentences"])
    if intros is not None:
        clips = clips.join(intros, clip, "left")
    else:
        clips = clips.withColumn("intro", F.lit(None).cast("string"))
    clips = clips.withColumn("__lead", F.when(F.coalesce("intro", F.lit("")) != "", 2).otherwise(0))

    pieces = ordered_scan(
        cuts, [clip], ["i"], _chunk("i", chunk),
        clips.where(F.col("status") == "ranked_ok").select(clip, "intro", "n_sentences", "__lead"),
        stop=("lead", "cut"),
    ).where(F.col("stop").isNotNull())
    kind = F.when(F.col("i") >= F.col("__lead"), "sentence").when(F.col("i") == 0, "book_intro").otherwise("chapter_number_excluded")
    exact = (F.col("stop") - F.col("cut")) * frame_s
    outlier = ~exact.between(*confident)
    body = (
        pieces.withColumn("type", kind)
        .withColumn("num", F.when(F.col("type") == "sentence", F.col("i") - F.col("__lead") + 1))
        .join(sentences, [clip, "num"], "left")
        .select(
            clip,
            F.when(F.col("type") == "sentence", F.format_string("_seg_%03d", "num"))
            .when(F.col("type") == "book_intro", "_seg_book").otherwise("_seg_chapter_excluded").alias("__tail"),
            "type",
            F.round(exact, 2).alias("duration_s"),
            F.col("n_sentences").alias("n_sentences_in_chapter"),
            F.when(F.col("type") == "chapter_number_excluded", "excluded").when(outlier, "low").otherwise("high").alias("confidence"),
            F.when(F.col("type") == "chapter_number_excluded", "chapter_number_text_unknown")
            .when(outlier, "duration_outlier").otherwise("").alias("reason"),
            F.when(F.col("type") == "sentence", F.col("text")).when(F.col("type") == "book_intro", F.col("intro")).alias("text"),
            F.col("cut").alias("start"), "stop",
        )
    )
    fallback = clips.where(F.col("status") != "ranked_ok").select(
        clip, F.lit("_seg_001").alias("__tail"), F.lit("whole_chapter_fallback").alias("type"),
        F.round(F.col("length") * frame_s, 2).alias("duration_s"),
        F.col("n_sentences").alias("n_sentences_in_chapter"),
        F.lit("low").alias("confidence"), F.col("status").alias("reason"),
        F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("stop"),
    )
    rows = body.unionByName(fallback)
    return rows.withColumn("segment", F.concat(F.col(clip).cast("string"), "__tail")).drop("__tail")


# ---------------------------------------------------------------- merging pieces

# Milliseconds a merged group aims for, and the fewest words it may hold.
MERGE_MIN_MS, MERGE_MAX_MS, MERGE_MIN_WORDS = 15_000, 25_000, 3


def _walk(durations: np.ndarray, open_ms: int | None, lo: int, hi: int) -> tuple[np.ndarray, int | None]:
    """Where groups start when entering with an open group of ``open_ms`` (None: nothing open)."""
    starts = np.zeros(len(durations), dtype=bool)
    for i, d in enumerate(durations.tolist()):
        if open_ms is None or (open_ms >= lo and open_ms + d > hi):
            starts[i], open_ms = True, d
        else:
            open_ms += d
    return starts, open_ms


def _head(d: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a chunk in which an entering group must close, and for each the sum left open at the
    chunk's end if a group starts there."""
    before = np.concatenate([[0], np.cumsum(d)])
    over = np.flatnonzero(before[1:] > hi)
    n = len(d) if not len(over) else min(len(d), int(over[0]) + 2)
    # first piece at which a group started at each position is closed
    closing = np.maximum.reduce([
        np.searchsorted(before, before[:-1] + lo, side="left"),
        np.searchsorted(before, before[:-1] + hi, side="right") - 1,
        np.arange(1, len(d) + 1),
    ])
    left = (before[-1] - before[:-1]).tolist()
    for p in range(len(d) - 1, -1, -1):
        if closing[p] < len(d):
            left[p] = left[closing[p]]
    return d[:n], np.array(left[:n], dtype=np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, value arrays) of each run of rows with one key, which may reach over batches; one run is in memory."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        columns = [batch.column(v).to_numpy(zero_copy_only=False) for v in values]
        borders = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for i, j in zip(borders, borders[1:]):
            if held and names[i] != at:
                yield at, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            at = names[i]
            held.append([c[i:j] for c in columns])
    if held:
        yield at, [np.concatenate(c) for c in zip(*held, strict=True)]


def _rows(types: dict, keys: tuple, n: int, **columns) -> pa.RecordBatch:
    names = [*list(types)[: len(keys)], *columns]
    arrays = [pa.array([k] * n, types[name]) for k, name in zip(keys, types)] + [pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def merge_runs(pieces: DataFrame, clip: str = "clip", lo: int = MERGE_MIN_MS, hi: int = MERGE_MAX_MS, chunk: int = 1 << 14) -> DataFrame:
    """Greedy groups of consecutive pieces: (clip, idx, dur, group_no) with idx from 0 without gaps.

    A group closes when it holds at least ``lo`` and the next piece would take
    it over ``hi``. The rule looks only at the open sum, so a chunk of pieces
    is a function from the sum it is entered with to the sum it is left with.
    A group entering a chunk must close within the first ``hi`` of it, hence
    each chunk lists that short head and, for every piece of the head, the sum
    left open if a group started there. One small fold per clip over these
    summaries gives every chunk its entering sum, and the chunks are then
    grouped independently.
    """
    keyed = cut_lineage(pieces.select(clip, F.col("idx").cast("long"), F.col("dur").cast("long").alias("dur")).withColumn(
        "__ch", F.floor(F.col("idx") / chunk)
    ), "pieces")
    clip_type = pieces.schema[clip].dataType
    fields = lambda *names: ", ".join(f"{n} {t}" for n, t in names)
    kt = (f"`{clip}`", clip_type.simpleString())

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (durations,) in _runs(batches, [clip, "__ch"], ["dur"]):
            ahead, left = _head(durations, lo, hi)
            yield _rows(batch_schema, keys, 1, head=[ahead.tolist()], left=[left.tolist()])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            entering = []
            for key, ahead, left in zip(*(batch.column(c).to_pylist() for c in (clip, "head", "left")), strict=True):
                if key != at:
                    at, state = key, None
                entering.append(-1 if state is None else state)
                for d, after in zip(ahead, left, strict=True):
                    if state is None or (state >= lo and state + d > hi):
                        state = after
                        break
                    state += d
            yield pa.RecordBatch.from_arrays([batch.column(clip), batch.column("__ch"), pa.array(entering, pa.int64())], names=[clip, "__ch", "__open"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, (index, durations, opened) in _runs(batches, [clip, "__ch"], ["idx", "dur", "__open"]):
            flags, _ = _walk(durations, None if opened[0] < 0 else int(opened[0]), lo, hi)
            yield _rows(batch_schema, keys[:1], len(index), idx=index, dur=durations, __start=flags.astype(np.int64))

    batch_schema = {clip: to_arrow_type(clip_type), "__ch": pa.int64()}
    placed = lambda df, by, *order: df.repartition(*by).sortWithinPartitions(*by, *order)
    heads = placed(keyed, [clip, "__ch"], "idx").mapInArrow(head, fields(kt, ("__ch", "long"), ("head", "array<long>"), ("left", "array<long>")))
    entered = placed(heads, [clip], "__ch").mapInArrow(carry, fields(kt, ("__ch", "long"), ("__open", "long")))
    # Dealt by a hash of the key: dealing by the join's own key would add no exchange, and a join that turns
    # into a broadcast as it runs leaves its rows where they were read, so a chunk's pieces would lie apart.
    joined = keyed.join(entered, [clip, "__ch"]).repartition(F.xxhash64(clip, "__ch")).sortWithinPartitions(clip, "__ch", "idx")
    flagged = cut_lineage(joined.mapInArrow(
        starts, fields(kt, ("idx", "long"), ("dur", "long"), ("__start", "long"))
    ), "groups")
    numbered = ordered_scan(flagged, [clip], ["idx"], _chunk("idx", chunk), __before=("sum_before", "__start"))
    return numbered.select(clip, "idx", "dur", (F.col("__before") + F.col("__start") - 1).alias("group_no"))


def merged_groups(merged: DataFrame, clip: str = "clip") -> DataFrame:
    return merged.groupBy(clip, "group_no").agg(
        F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("pieces"), F.sum("dur").alias("dur")
    )


def assign_words(groups: DataFrame, words: DataFrame, clip: str = "clip", min_words: int = MERGE_MIN_WORDS, chunk: int = 1 << 14) -> DataFrame:
    """Each group's slice of the clip's words by its share of the duration.

    ``groups`` is (clip, group_no, dur), ``words`` is (clip, words). A group
    takes at least one word and leaves one for each later group; the last
    takes the rest; slices under ``min_words`` are dropped. The capped running
    offset needs no fold: shares never fall below one, so the offset of group
    i is ``i + min(sum of earlier (share - 1), words - groups)``. A text with
    fewer words than groups fills no slice.
    """
    sizes = words.select(clip, F.size("words").cast("long").alias("__w"))
    sized = ordered_scan(
        groups, [clip], ["group_no"], _chunk("group_no", chunk), sizes,
        __i=("number",), __g=("count",), __total=("sum", "dur"),
    )
    share = F.greatest(F.bround(F.col("__w") * (F.col("dur") / F.col("__total"))), F.lit(1.0)).cast("long")
    shared = ordered_scan(
        sized.withColumn("__extra", share - 1), [clip], ["group_no"], _chunk("group_no", chunk), __s=("sum_before", "__extra"),
    )
    spare = F.col("__w") - F.col("__g")
    start = F.col("__i") - 1 + F.least(F.col("__s"), spare)
    stop = F.when(F.col("__i") == F.col("__g"), F.col("__w")).otherwise(
        F.col("__i") + F.least(F.col("__s") + F.col("__extra"), spare)
    )
    slices = (
        shared.where(spare >= 0)
        .withColumn("__from", start).withColumn("n_words", stop - start)
        .where(F.col("n_words") >= min_words)
    )
    # a clip has fewer slices than words, so its slices fit where its words do
    lists = slices.groupBy(clip).agg(F.collect_list(F.struct("group_no", "dur", "n_words", "__from")).alias("__s"))
    text = lambda g: F.array_join(F.slice("words", (g["__from"] + 1).cast("int"), g["n_words"].cast("int")), " ")
    cut = lambda g: F.struct(g["group_no"].alias("group_no"), g["dur"].alias("dur"), g["n_words"].alias("n_words"), text(g).alias("text"))
    return lists.join(words.select(clip, "words"), clip).select(clip, F.explode(F.transform("__s", cut)).alias("g")).select(clip, "g.*")


def shift_pairs(units: DataFrame, key: str = "chapter", k: int = 2, chunk: int = 1 << 16) -> DataFrame:
    """Re-pair unit ``i`` with the label of unit ``i - k``; chapters with gaps or under k+1 units are skipped."""
    checked = ordered_scan(units, [key], ["num"], _chunk("num", chunk), __n=("count",), __max=("max", "num"))
    good = checked.where((F.col("__n") == F.col("__max")) & (F.col("__n") > k) & (F.col("num") > k))
    return good.select(key, F.col("num").alias("unit"), (F.col("num") - k).alias("label"))


# ---------------------------------------------------------------- intervals and verdicts

def silence_metrics(intervals: DataFrame, durations: DataFrame, key: str = "segment", chunk: int = 1 << 16) -> DataFrame:
    """Speech span, silences and word count per segment; no row when no word was spoken."""
    spoken = intervals.where(F.coalesce("text", F.lit("")) != "")
    gaps = ordered_scan(spoken, [key], ["idx"], _chunk("idx", chunk), __prev=("lag", "xmax"))
    spans = gaps.groupBy(key).agg(
        F.min_by("xmin", "idx").alias("begin"),
        F.max_by("xmax", "idx").alias("end"),
        F.greatest(F.max(F.col("xmin") - F.col("__prev")), F.lit(0.0)).alias("internal"),
        F.count(F.lit(1)).alias("n_words_aligned"),
    )
    return spans.join(durations.select(key, "duration_s"), key, "left").select(
        key,
        F.round("begin", 3).alias("speech_begin_s"),
        F.round("end", 3).alias("speech_end_s"),
        F.round(F.col("end") - F.col("begin"), 3).alias("speech_duration_s"),
        F.round("begin", 3).alias("leading_silence_s"),
        F.round(F.greatest(F.lit(0.0), F.col("duration_s") - F.col("end")), 3).alias("trailing_silence_s"),
        F.round("internal", 3).alias("max_internal_silence_s"),
        "n_words_aligned",
    )


# The thresholds in force and the order and names of the tests.
QC_THRESHOLDS = {
    "min_duration_s": 1.5,
    "max_duration_s": 20.0,
    "min_words": 3,
    "min_overall_log_likelihood": -70.0,
    "max_phone_duration_deviation": 10.0,
    "min_snr": None,
    "max_leading_silence_s": None,
    "max_trailing_silence_s": None,
    "max_internal_silence_s": 3.5,
    "drop_low_confidence_segments": False,
}
QC_TESTS = (
    ("under", "speech_duration_s", "min_duration_s", "too_short"),
    ("over", "speech_duration_s", "max_duration_s", "too_long"),
    ("under", "overall_log_likelihood", "min_overall_log_likelihood", "low_likelihood"),
    ("over", "phone_duration_deviation", "max_phone_duration_deviation", "phone_duration_outlier"),
    ("under", "snr", "min_snr", "low_snr"),
    ("over", "leading_silence_s", "max_leading_silence_s", "long_leading_silence"),
    ("over", "trailing_silence_s", "max_trailing_silence_s", "long_trailing_silence"),
    ("over", "max_internal_silence_s", "max_internal_silence_s", "long_internal_silence"),
    ("under", "n_words_aligned", "min_words", "too_few_words"),
)


def judge(df: DataFrame, thresholds: dict, tests=QC_TESTS, aligned: str = "aligned") -> DataFrame:
    """Add ``qc_reasons`` (joined by ';') and ``qc_pass``; nulls and null limits never fail a test."""
    checks = []
    if {"wav_path", "txt_path"} <= set(df.columns):
        checks.append(F.when((F.coalesce("wav_path", F.lit("")) == "") | (F.coalesce("txt_path", F.lit("")) == ""), "missing_source_files"))
    for side, metric, limit, reason in tests:
        bound = thresholds.get(limit)
        if bound is not None:
            fails = F.col(metric) < bound if side == "under" else F.col(metric) > bound
            checks.append(F.when(fails, reason))
    if thresholds.get("drop_low_confidence_segments"):
        checks.append(F.when(F.col("segmentation_confidence") == "low", "segmentation_low_confidence"))
    judged = F.array_join(F.array_compact(F.array(*checks)), ";") if checks else F.lit("")
    reasons = F.when(F.coalesce(F.col(aligned), F.lit(False)), judged).otherwise("alignment_failed")
    return df.withColumn("qc_reasons", reasons).withColumn("qc_pass", F.col("qc_reasons") == "")


# The report's columns in order.
QC_FIELDS = [
    "segment", "batch", "book", "chapter", "qc_pass", "qc_reasons",
    "duration_s", "speech_duration_s", "speech_begin_s", "speech_end_s",
    "leading_silence_s", "trailing_silence_s", "max_internal_silence_s", "n_words_aligned",
    "overall_log_likelihood", "speech_log_likelihood", "phone_duration_deviation", "snr",
    "aligned", "segmentation_confidence", "segmentation_reason",
    "wav_path", "txt_path", "textgrid_path",
]


def collect_record(
    analysis: DataFrame, report: DataFrame, textgrids: DataFrame, wavs: DataFrame, texts: DataFrame, intervals: DataFrame,
    batch: str, thresholds: dict = QC_THRESHOLDS, chunk: int = 1 << 16, report_order: str | None = None,
) -> DataFrame:
    """The quality record, QC_FIELDS in order: alignment rows (segment, begin, end, four scores) joined
    with the segmentation report, the file inventories and the silence metrics of the word intervals.

    The duration is end less begin, an absent one counting 0. A segment whose tier holds no spoken
    word is not aligned, whatever files it has, so it fails; one without an interval file has no metrics.
    """
    begin, end = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("begin", "end"))
    rows = enrich_segments(analysis.withColumn("duration_s", F.round(end - begin, 3)), report, textgrids, wavs, texts, report_order)
    metrics = silence_metrics(intervals, rows.select("segment", "duration_s"), "segment", chunk)
    seen = rows.join(metrics, "segment", "left")
    aligned = F.col("aligned") & F.col("n_words_aligned").isNotNull()
    for c in [c for c in metrics.columns if c != "segment"]:
        seen = seen.withColumn(c, F.when(F.col("aligned"), F.col(c)))
    return judge(seen.withColumn("aligned", aligned).withColumn("batch", F.lit(batch)), thresholds).select(*QC_FIELDS)


def trim_bounds(df: DataFrame, begin: str = "speech_begin_s", end: str = "speech_end_s", frames: str = "frames", pad_s: float = 0.1, rate: int = 16000) -> DataFrame:
    """Padded frame range clamped to the file; an empty range is an error row."""
    start = F.greatest(F.lit(0).cast("long"), ((F.col(begin) - pad_s) * rate).cast("long"))
    stop = F.least(F.col(frames).cast("long"), ((F.col(end) + pad_s) * rate).cast("long"))
    out = df.withColumn("start", start).withColumn("stop", stop)
    empty = F.col("stop") <= F.col("start")
    return out.withColumn("trim_error", F.when(empty, F.concat_ws("", F.lit("empty trim range "), "start", F.lit(":"), "stop"))).withColumn(
        "trimmed_s", F.when(~empty, (F.col("stop") - F.col("start")) / rate)
    )


# The manifest's columns in order.
MANIFEST_FIELDS = ["file_name", "text", "segment", "chapter", "book", "duration_s", "split"]


def build_manifest(
    qc: DataFrame,
    texts: DataFrame,
    headers: DataFrame,
    held_out: list[str],
    pad_s: float = 0.1,
    rate: int = 16000,
    min_words: int = 3,
    rules: T.TranscriptRules = T.DEVANAGARI_TRANSCRIPT,
) -> tuple[DataFrame, DataFrame]:
    """Training manifest and the skipped segments with their reason.

    ``texts`` is (segment, text) and ``headers`` (segment, frames); a segment
    without either has lost its source file.
    """
    from lexiloom.operators.splits import split_groups

    passed = qc.where("qc_pass").select("segment", "chapter", "book", "speech_begin_s", "speech_end_s")
    cleaned = texts.select("segment", T.strip_numerals("text", rules)["text"].alias("text"))
    rows = passed.join(cleaned, "segment", "left").join(headers.select("segment", "frames"), "segment", "left")
    rows = trim_bounds(rows, pad_s=pad_s, rate=rate)
    reason = F.coalesce(
        T.skip_reason("text", F.col("text").isNull() | F.col("frames").isNull(), min_words), F.col("trim_error")
    )
    rows = split_groups(rows.withColumn("reason", reason), "chapter", held_out)
    kept = rows.where(F.col("reason").isNull()).select(
        F.concat("segment", F.lit(".wav")).alias("file_name"), "text", "segment", "chapter", "book",
        F.round("trimmed_s", 3).alias("duration_s"), "split",
    )
    return kept, rows.where(F.col("reason").isNotNull()).select("segment", "reason")


def best_epoch(log: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", metric: str = "val", chunk: int = 1 << 16) -> DataFrame:
    """Best epoch per run under early stopping: strict improvement, stop after ``patience`` epochs without.

    Returns (run, best_epoch, best_value, stopped_at); ``stopped_at`` is null
    for a run that was never stopped.
    """
    steps = ordered_scan(log, [run], [epoch], _chunk(epoch, chunk), __i=("number",), __best=("min_before", metric))
    better = F.coalesce(F.col(metric) < F.col("__best"), F.lit(True))
    steps = steps.withColumn("__hit", F.when(better, F.col("__i")))
    since = ordered_scan(steps, [run], [epoch], _chunk(epoch, chunk), __last=("last", "__hit"))
    late = F.col("__i") - F.col("__last") >= patience
    flagged = ordered_scan(
        since.withColumn("__stop", F.when(late, F.col("__i"))), [run], [epoch], _chunk(epoch, chunk), __first=("min", "__stop")
    )
    alive = flagged.where(F.col("__first").isNull() | (F.col("__i") <= F.col("__first")))
    return alive.groupBy(run).agg(
        F.max_by(F.col(epoch), F.col("__hit")).alias("best_epoch"),
        F.max_by(F.col(metric), F.col("__hit")).alias("best_value"),
        F.max(F.when(F.col("__i") == F.col("__first"), F.col(epoch))).alias("stopped_at"),
    )
