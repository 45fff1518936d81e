"""Frames, pauses, segments and records, with users' events standing in for recordings.

A user is a clip, an event a frame, the event's value the level or duration.
The numbered frames and the merged pieces are written once, as the stages of a
recording's preparation are, and the queries read them from there. Tests lower
``CHUNK`` so that chunk borders are crossed on small tables too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import profile as P
from lexiloom.operators import segments as S
from lexiloom.operators.ordered import ordered_scan
from lexiloom.plans.registry import query, sql_sentences, sql_tokens, table
from lexiloom.plans.text_queries import STOP, documents
from lexiloom.session import cut_lineage

CHUNK = 1 << 14
SQL_FRAMES = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no FROM events"


def frames(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")
    numbered = S.number_frames(events, "user_id", ["ts", "event_id"], [F.to_date("ts")])
    return cut_lineage(numbered.select("user_id", "event_id", "event_type", "frame_no", F.col("value").alias("level")), "frames")


@query("frame_numbers", f"SELECT user_id, event_id, frame_no FROM ({SQL_FRAMES})")
def frame_numbers(spark, folder):
    return frames(spark, folder).select("user_id", "event_id", "frame_no")


def sql_pauses(threshold: float, min_len: int) -> str:
    return f"""
SELECT user_id, min(frame_no) AS "start", max(frame_no) + 1 AS "end" FROM (
  SELECT user_id, frame_no, frame_no - row_number() OVER (PARTITION BY user_id ORDER BY frame_no) AS island
  FROM ({SQL_FRAMES}) WHERE value < {threshold}) GROUP BY user_id, island HAVING count(*) >= {min_len}"""


@query("pause_detection", sql_pauses(15, 2))
def pause_detection(spark, folder):
    return S.detect_pauses(frames(spark, folder), 15, 2, "user_id", CHUNK)


@query("edge_trim", f"""
WITH f AS ({SQL_FRAMES}), b AS (SELECT user_id, min(frame_no) AS lo, max(frame_no) AS hi FROM f WHERE value >= 15 GROUP BY user_id)
SELECT user_id, event_id, frame_no - lo AS frame_no FROM f JOIN b USING (user_id) WHERE frame_no BETWEEN lo AND hi""")
def edge_trim(spark, folder):
    return S.trim_edges(frames(spark, folder), 15, "user_id", CHUNK).select("user_id", "event_id", "frame_no")


SQL_RANKED = f"""
WITH f AS ({SQL_FRAMES}), p AS ({sql_pauses(15, 1)}),
s AS (SELECT doc_id AS user_id, count(*) AS n FROM ({sql_sentences('doc_id')}) GROUP BY doc_id),
c AS (SELECT user_id, coalesce(any_value(n), 0) AS n, max(frame_no) + 1 AS length FROM f LEFT JOIN s USING (user_id) GROUP BY user_id),
k AS (SELECT user_id, count(*) AS pauses FROM p GROUP BY user_id),
st AS (SELECT user_id, n, length, coalesce(pauses, 0) AS pauses, CASE WHEN n <= 1 THEN 'single_sentence' WHEN coalesce(pauses, 0) < n - 1 THEN 'insufficient_pauses' ELSE 'ranked_ok' END AS status
  FROM c LEFT JOIN k USING (user_id)),
r AS (SELECT user_id, "start", "end", row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, "start") AS rk FROM p),
m AS (SELECT user_id, ("start" + "end") // 2 AS cut FROM r JOIN st USING (user_id) WHERE status = 'ranked_ok' AND rk <= n - 1
  UNION ALL SELECT user_id, 0 FROM st UNION ALL SELECT user_id, length FROM st),
x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY cut) - 1 AS i, cut FROM m)"""


def ranked(spark, folder):
    fr = frames(spark, folder)
    spoken = P.sentences(documents(spark, folder, "doc_id", "text"), ["doc_id"], terminators=STOP)
    counts = spoken.groupBy(F.col("doc_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    clips = S.clip_lengths(fr, "user_id").join(counts, "user_id", "left").fillna(0, ["n"])
    pauses = cut_lineage(S.detect_pauses(fr, 15, 1, "user_id", CHUNK), "pauses")
    status, cuts = S.rank_boundaries(pauses, cut_lineage(clips, "clips"), "user_id", CHUNK)
    return status, cut_lineage(cuts, "cuts")


@query("boundary_status", f"{SQL_RANKED} SELECT user_id, n, length, pauses, status FROM st")
def boundary_status(spark, folder):
    return ranked(spark, folder)[0].select("user_id", "n", "length", "pauses", "status")


@query("ranked_boundaries", f"{SQL_RANKED} SELECT user_id, i, cut FROM x")
def ranked_boundaries(spark, folder):
    return ranked(spark, folder)[1]


@query("segment_table", f"""{SQL_RANKED},
t AS (SELECT doc_id AS user_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS num, text FROM ({sql_sentences('doc_id')})),
g AS (SELECT user_id, i + 1 AS num, cut AS a, lead(cut) OVER (PARTITION BY user_id ORDER BY i) AS b FROM x)
SELECT user_id || '_seg_' || lpad(g.num::VARCHAR, greatest(3, len(g.num::VARCHAR))::INT, '0') AS segment, 'sentence' AS type, round((b - a) * 1.0::DOUBLE, 2) AS duration_s, n AS n_sentences_in_chapter,
  CASE WHEN (b - a) BETWEEN 1.5 AND 20 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN (b - a) BETWEEN 1.5 AND 20 THEN '' ELSE 'duration_outlier' END AS reason, t.text AS text
FROM g JOIN st USING (user_id) LEFT JOIN t ON t.user_id = g.user_id AND t.num = g.num WHERE status = 'ranked_ok' AND b IS NOT NULL
UNION ALL SELECT user_id || '_seg_001', 'whole_chapter_fallback', round(length * 1.0::DOUBLE, 2), n, 'low', status, NULL FROM st WHERE status <> 'ranked_ok'""")
def segment_table(spark, folder):
    status, cuts = ranked(spark, folder)
    spoken = P.sentences(documents(spark, folder, "doc_id", "text"), ["doc_id"], terminators=STOP)
    numbered = ordered_scan(spoken, ["doc_id"], ["sent_no"], [F.floor(F.col("sent_no") / CHUNK)], num=("number",))
    sentences = numbered.select(F.col("doc_id").alias("user_id"), "num", "text")
    out = S.build_segments(status, cuts, cut_lineage(sentences, "sentences"), clip="user_id", frame_s=1.0, chunk=CHUNK)
    return out.select("segment", "type", "duration_s", "n_sentences_in_chapter", "confidence", "reason", "text")


SQL_MERGE = f"""
WITH RECURSIVE p AS (SELECT user_id, frame_no AS idx, (value * 1000)::BIGINT AS dur FROM ({SQL_FRAMES})),
r AS (SELECT user_id, idx, dur, dur AS cur, 0 AS group_no FROM p WHERE idx = 0
  UNION ALL SELECT p.user_id, p.idx, p.dur, CASE WHEN r.cur >= 15000 AND r.cur + p.dur > 25000 THEN p.dur ELSE r.cur + p.dur END,
    r.group_no + CASE WHEN r.cur >= 15000 AND r.cur + p.dur > 25000 THEN 1 ELSE 0 END FROM r JOIN p ON p.user_id = r.user_id AND p.idx = r.idx + 1)"""


def merged(spark, folder):
    pieces = frames(spark, folder).select("user_id", F.col("frame_no").alias("idx"), F.round(F.col("level") * 1000).cast("long").alias("dur"))
    return cut_lineage(S.merge_runs(pieces, "user_id", chunk=CHUNK), "merged")


@query("greedy_merge", f"{SQL_MERGE} SELECT user_id, idx, dur, group_no::BIGINT AS group_no FROM r")
def greedy_merge(spark, folder):
    return merged(spark, folder)


@query("word_assignment", f"""{SQL_MERGE},
g AS (SELECT user_id, group_no, sum(dur) AS dur, row_number() OVER (PARTITION BY user_id ORDER BY group_no) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS g,
  sum(sum(dur)) OVER (PARTITION BY user_id) AS total FROM r GROUP BY user_id, group_no),
w AS (SELECT doc_id AS user_id, {sql_tokens('text')} AS w FROM documents),
a AS (SELECT g.*, w, len(w) AS n FROM g JOIN w USING (user_id) WHERE len(w) >= g.g),
c AS (SELECT *, CASE WHEN i = g - 1 THEN n ELSE least(greatest(round_even(n * (dur::DOUBLE / total::DOUBLE), 0), 1), n - 0 - (g - i - 1)) END::BIGINT AS cnt FROM a WHERE i = 0
  UNION ALL SELECT a.*, CASE WHEN a.i = a.g - 1 THEN a.n ELSE c.cnt + least(greatest(round_even(a.n * (a.dur::DOUBLE / a.total::DOUBLE), 0), 1), a.n - c.cnt - (a.g - a.i - 1)) END::BIGINT
    FROM c JOIN a ON a.user_id = c.user_id AND a.i = c.i + 1),
o AS (SELECT *, coalesce(lag(cnt) OVER (PARTITION BY user_id ORDER BY i), 0) AS lo FROM c)
SELECT user_id, group_no::BIGINT AS group_no, dur::BIGINT AS dur, cnt - lo AS n_words, array_to_string(w[lo + 1:cnt], ' ') AS text FROM o WHERE cnt - lo >= 3""")
def word_assignment(spark, folder):
    groups = S.merged_groups(merged(spark, folder), "user_id").select("user_id", "group_no", "dur")
    words = documents(spark, folder, "doc_id", "text").select(F.col("doc_id").alias("user_id"), T.tokens("text").alias("words"))
    return S.assign_words(groups, words, "user_id", chunk=CHUNK)


@query("label_shift", """
WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber AS num FROM lineitem),
c AS (SELECT l_orderkey FROM u GROUP BY l_orderkey HAVING count(*) = max(num) AND count(*) >= 3)
SELECT l_orderkey, num AS unit, num - 2 AS label FROM u JOIN c USING (l_orderkey) WHERE num > 2""")
def label_shift(spark, folder):
    units = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("num")).distinct()
    return S.shift_pairs(units, "l_orderkey", 2, CHUNK)


@query("silence_metrics", f"""
WITH i AS (SELECT user_id, frame_no AS idx, frame_no * 10.0::DOUBLE AS xmin, frame_no * 10.0::DOUBLE + least(value, 10.0) AS xmax, event_type = 'error' AS quiet FROM ({SQL_FRAMES})),
d AS (SELECT user_id, count(*) * 10.0::DOUBLE AS duration_s FROM i GROUP BY user_id),
g AS (SELECT *, xmin - lag(xmax) OVER (PARTITION BY user_id ORDER BY idx) AS gap FROM i WHERE NOT quiet),
s AS (SELECT user_id, min(xmin) AS b, max(xmax) AS e, greatest(coalesce(max(gap), 0), 0) AS m, count(*)::BIGINT AS n_words_aligned FROM g GROUP BY user_id)
SELECT user_id, round(b, 3) AS speech_begin_s, round(e, 3) AS speech_end_s, round(e - b, 3) AS speech_duration_s, round(b, 3) AS leading_silence_s,
  round(greatest(0, duration_s - e), 3) AS trailing_silence_s, round(m, 3) AS max_internal_silence_s, n_words_aligned FROM s JOIN d USING (user_id)""")
def silence_metrics(spark, folder):
    start = F.col("frame_no") * 10.0
    intervals = frames(spark, folder).select(
        "user_id", F.col("frame_no").alias("idx"), start.alias("xmin"), (start + F.least("level", F.lit(10.0))).alias("xmax"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"),
    )
    durations = intervals.groupBy("user_id").agg((F.count(F.lit(1)) * 10.0).alias("duration_s"))
    return S.silence_metrics(intervals, durations, "user_id", CHUNK)


@query("trim_bounds", """
WITH b AS (SELECT event_id, greatest(0, trunc((value / 10 - 0.1::DOUBLE) * 16000))::BIGINT AS "start", least(event_id % 20 * 16000, trunc((value / 5 + 0.1::DOUBLE) * 16000))::BIGINT AS stop FROM events)
SELECT event_id, "start", stop, CASE WHEN stop <= "start" THEN 'empty trim range ' || "start" || ':' || stop END AS trim_error,
  CASE WHEN stop > "start" THEN round((stop - "start") / 16000, 7) END AS trimmed_s FROM b""")
def trim_bounds(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", (F.col("value") / 10).alias("speech_begin_s"), (F.col("value") / 5).alias("speech_end_s"),
        (F.col("event_id") % 20 * 16000).alias("frames"),
    )
    return S.trim_bounds(rows).select("event_id", "start", "stop", "trim_error", F.round("trimmed_s", 7).alias("trimmed_s"))


@query("best_epoch", f"""
WITH f AS (SELECT user_id, frame_no + 1 AS e, value AS v FROM ({SQL_FRAMES})),
m AS (SELECT *, min(v) OVER (PARTITION BY user_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f),
h AS (SELECT *, max(CASE WHEN b IS NULL OR v < b THEN e END) OVER (PARTITION BY user_id ORDER BY e) AS last FROM m),
s AS (SELECT user_id, min(e) FILTER (e - last >= 5) AS stop FROM h GROUP BY user_id),
k AS (SELECT h.*, stop FROM h JOIN s USING (user_id) WHERE stop IS NULL OR e <= stop)
SELECT user_id, max(last) AS best_epoch, arg_max(v, CASE WHEN last = e THEN e END) AS best_value, any_value(stop) AS stopped_at FROM k GROUP BY user_id""")
def best_epoch(spark, folder):
    log = frames(spark, folder).select("user_id", (F.col("frame_no") + 1).alias("epoch"), F.col("level").alias("val"))
    return S.best_epoch(log, 5, "user_id", chunk=CHUNK)


@query("dataset_manifest", rf"""
WITH q AS (SELECT d.doc_id, 'seg' || d.doc_id AS segment, source AS chapter, {sql_tokens(r"regexp_replace(text, '\S*[0-9]\S*', ' ', 'g')")} AS w, n_chars,
  greatest(0, trunc((1.0::DOUBLE - 0.1::DOUBLE) * 16000))::BIGINT AS a, least(n_chars * 1000, trunc((n_chars / 15.0::DOUBLE + 0.1::DOUBLE) * 16000))::BIGINT AS b
  FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1)
SELECT segment || '.wav' AS file_name, array_to_string(w, ' ') AS text, segment, chapter, lang AS book, round(((b - a) / 16000)::DECIMAL(18, 7), 3)::DOUBLE AS duration_s,
  CASE WHEN chapter IN ('src3', 'src7') THEN 'validation' ELSE 'train' END AS split
FROM q JOIN documents USING (doc_id) WHERE len(w) >= 3 AND b > a""")
def dataset_manifest(spark, folder):
    docs = documents(spark, folder, "doc_id", "text", "source", "lang", "n_chars").withColumn("segment", F.concat(F.lit("seg"), F.col("doc_id").cast("string")))
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("qc_pass"))
    qc = docs.join(labels, "doc_id").select(
        "segment", "qc_pass", F.col("source").alias("chapter"), F.col("lang").alias("book"),
        F.lit(1.0).alias("speech_begin_s"), (F.col("n_chars") / F.lit(15.0)).alias("speech_end_s"),
    )
    headers = docs.select("segment", (F.col("n_chars") * 1000).alias("frames"))
    return S.build_manifest(qc, docs.select("segment", "text"), headers, ["src3", "src7"])[0]
