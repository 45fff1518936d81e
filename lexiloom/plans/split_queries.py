"""Splits, samples, joins and set operations over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import joins as J
from lexiloom.operators import profile as P
from lexiloom.operators import segments as SG
from lexiloom.operators import splits as S
from lexiloom.plans.profile_queries import SQL_TOKENS
from lexiloom.plans.registry import SQL_PAIRS, query, sql_tokens, sql_uniform, table, turn_pairs
from lexiloom.plans.text_queries import documents


@query("row_split", f"SELECT doc_id, CASE WHEN {sql_uniform('doc_id', 42)} < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents")
def row_split(spark, folder):
    return S.split_rows(documents(spark, folder, "doc_id"), ["doc_id"], 0.1, 42)


@query("group_split", "SELECT doc_id, source, CASE WHEN source IN ('src3', 'src7', 'src11') THEN 'validation' ELSE 'train' END AS split FROM documents")
def group_split(spark, folder):
    return S.split_groups(documents(spark, folder, "doc_id", "source"), "source", ["src3", "src7", "src11"])


@query("group_split_fraction", """
WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':42'), source) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, CASE WHEN i <= greatest(1, round_even(n * 0.15, 0)) THEN 'validation' ELSE 'train' END AS split FROM documents JOIN g USING (source)""")
def group_split_fraction(spark, folder):
    return S.split_groups_frac(documents(spark, folder, "doc_id", "source"), "source", 0.15, 42)


@query("pair_split", f"""
WITH p AS (SELECT conv_id, turn, CASE WHEN {sql_uniform("conv_id || ':' || turn", 42)} < 1 - 0.9 THEN 'test' ELSE 'train' END AS split, a_text, b_text FROM ({SQL_PAIRS}))
SELECT conv_id, turn, split, 'a2b' AS direction, a_text AS source, b_text AS target FROM p
UNION ALL SELECT conv_id, turn, split, 'b2a', b_text, a_text FROM p""")
def pair_split(spark, folder):
    return S.split_pairs(turn_pairs(spark, folder), ["conv_id", "turn"], "a_text", "b_text", 0.9, 42)


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 25")
def seeded_sample(spark, folder):
    return S.sample_n(documents(spark, folder, "doc_id", "lang"), ["doc_id"], 25, 7)


SQL_SHINGLES = rf"""
WITH w AS (SELECT doc_id, {sql_uniform('doc_id', 42)} < 0.1 AS held, {sql_tokens('text')} AS w FROM documents),
s AS (SELECT doc_id, held, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, held, len(g) AS n, unnest(g) AS g FROM s),
m AS (SELECT DISTINCT a.doc_id FROM (
  SELECT a.doc_id, b.doc_id AS other, a.n AS na, b.n AS nb, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.held AND NOT b.held GROUP BY ALL) a
  WHERE common >= 0.8 * (na + nb - common))"""


@query("leakage_flags", f"{SQL_SHINGLES} SELECT doc_id, doc_id IN (SELECT doc_id FROM m) AS leaked FROM s WHERE held")
def leakage_flags(spark, folder):
    docs = S.split_rows(documents(spark, folder, "doc_id", "text"), ["doc_id"], 0.1, 42)
    return S.leakage(docs.where("split = 'train'"), docs.where("split = 'test'"), "doc_id")


@query("leakage_share", f"""{SQL_SHINGLES}
SELECT count(*)::BIGINT AS held_out, count(*) FILTER (doc_id IN (SELECT doc_id FROM m)) AS leaked,
  round(count(*) FILTER (doc_id IN (SELECT doc_id FROM m)) / count(*) * 100, 6) AS leaked_pct FROM s WHERE held""")
def leakage_share(spark, folder):
    return S.leakage_share(leakage_flags(spark, folder)).withColumn("leaked_pct", F.round("leaked_pct", 6))


@query("verse_join", """
WITH u AS (SELECT conv_id, turn, text AS a_text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS b_text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, a_text, b_text, CASE WHEN a_text IS NULL THEN 'b_only' WHEN b_text IS NULL THEN 'a_only' ELSE 'both' END AS side
FROM u FULL JOIN a USING (conv_id, turn)""")
def verse_join(spark, folder):
    turns = table(spark, folder, "conversations")
    return J.verse_join(
        turns.where("role = 'user'"), turns.where("role = 'assistant'").withColumn("turn", F.col("turn") - 1),
        ["conv_id", "turn"], "text", "text",
    )


@query("join_coverage", """
WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant'),
j AS (SELECT CASE WHEN u.conv_id IS NULL THEN 'b_only' WHEN a.conv_id IS NULL THEN 'a_only' ELSE 'both' END AS side FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn)
SELECT side, count(*)::BIGINT AS n FROM j GROUP BY side""")
def join_coverage(spark, folder):
    return J.coverage_counts(verse_join(spark, folder))


# Orders stand in for alignment rows: 'B<nation>_<customer>_seg_<order>'.
SEGMENT_SQL = "'B' || c_nationkey || '_' || o_custkey || '_seg_' || o_orderkey"


@query("segment_enrichment", f"""
WITH s AS (SELECT {SEGMENT_SQL} AS segment, o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, c_acctbal, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT segment, o_totalprice AS duration_s,
  coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN 'given_' || o_custkey END, 'B' || c_nationkey || '_' || o_custkey) AS chapter,
  'B' || c_nationkey AS book,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_totalprice < 50000 THEN 'low' ELSE 'high' END ELSE '' END AS segmentation_confidence,
  CASE WHEN o_orderpriority <> '5-LOW' AND o_totalprice < 50000 THEN 'duration_outlier' ELSE '' END AS segmentation_reason,
  CASE WHEN o_orderstatus <> 'P' THEN '/grids/' || segment ELSE '' END AS textgrid_path,
  CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN '/wavs/' || segment ELSE '' END AS wav_path,
  CASE WHEN c_acctbal > 0 THEN '/texts/' || segment ELSE '' END AS txt_path, o_orderstatus <> 'P' AS aligned FROM s""")
def segment_enrichment(spark, folder):
    rows = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).withColumn("segment", F.concat_ws("", F.lit("B"), "c_nationkey", F.lit("_"), "o_custkey", F.lit("_seg_"), "o_orderkey"))
    low = F.col("o_totalprice") < 50000
    report = rows.where("o_orderpriority <> '5-LOW'").select(
        "segment", F.concat(F.lit("given_"), F.col("o_custkey").cast("string")).alias("chapter"),
        F.when(low, "low").otherwise("high").alias("confidence"), F.when(low, "duration_outlier").otherwise("").alias("reason"),
        F.lit(2).alias("line"),
    )
    # every segment has an older report row, which its later one replaces
    report = report.unionByName(report.withColumns({"chapter": F.lit("zz"), "confidence": F.lit("medium"), "line": F.lit(1)}))
    files = lambda df, root: df.select(F.col("segment").alias("stem"), F.concat(F.lit(root), "segment").alias("path"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.enrich_segments(
        rows.select("segment", F.col("o_totalprice").alias("duration_s")), report,
        files(rows.where("o_orderstatus <> 'P'"), "/grids/"),
        files(rows.join(lines, "o_orderkey", "left_semi"), "/wavs/"),
        files(rows.where("c_acctbal > 0"), "/texts/"), order="line",
    )


# The lines of an order are the words of its tier; a returned line is a silence, so some tiers hold no word.
@query("quality_record", f"""
WITH s AS (SELECT {SEGMENT_SQL} AS segment, o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, c_acctbal, c_nationkey,
  round(15.0::DOUBLE - CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0 ELSE 0.5 END, 3) AS duration_s FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS idx, l_linenumber * 2.0::DOUBLE AS xmin, l_linenumber * 2.0::DOUBLE + least(max(l_quantity) / 25, 1.9::DOUBLE) AS xmax FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING min(l_returnflag) <> 'R'),
g AS (SELECT *, xmin - lag(xmax) OVER (PARTITION BY o_orderkey ORDER BY idx) AS gap FROM w),
m AS (SELECT o_orderkey, arg_min(xmin, idx) AS b, arg_max(xmax, idx) AS e, greatest(coalesce(max(gap), 0), 0) AS q, count(*)::BIGINT AS n FROM g GROUP BY o_orderkey),
r AS (SELECT s.*, o_orderstatus <> 'P' AS grid, o_orderstatus <> 'P' AND n IS NOT NULL AS aligned, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.o_orderkey AND l_linenumber = 2) AS wav,
  CASE WHEN o_orderstatus <> 'P' THEN b END AS b, CASE WHEN o_orderstatus <> 'P' THEN e END AS e, CASE WHEN o_orderstatus <> 'P' THEN q END AS q, CASE WHEN o_orderstatus <> 'P' THEN n END AS n
  FROM s LEFT JOIN m USING (o_orderkey)),
j AS (SELECT *, CASE WHEN NOT aligned THEN 'alignment_failed' ELSE array_to_string(list_filter([
  CASE WHEN NOT wav OR c_acctbal <= 0 THEN 'missing_source_files' END, CASE WHEN round(e - b, 3) < 1.5 THEN 'too_short' END, CASE WHEN round(e - b, 3) > 20 THEN 'too_long' END,
  CASE WHEN -o_totalprice / 4000 < -70 THEN 'low_likelihood' END, CASE WHEN o_totalprice / 20000 > 10 THEN 'phone_duration_outlier' END,
  CASE WHEN round(q, 3) > 3.5 THEN 'long_internal_silence' END, CASE WHEN n < 3 THEN 'too_few_words' END], lambda x: x IS NOT NULL), ';') END AS qc_reasons FROM r)
SELECT segment, 'orders' AS batch, 'B' || c_nationkey AS book, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN 'given_' || o_custkey END, 'B' || c_nationkey || '_' || o_custkey) AS chapter,
  qc_reasons = '' AS qc_pass, qc_reasons, duration_s, round(e - b, 3) AS speech_duration_s, round(b, 3) AS speech_begin_s, round(e, 3) AS speech_end_s, round(b, 3) AS leading_silence_s,
  CASE WHEN e IS NOT NULL THEN round(greatest(0, duration_s - e), 3) END AS trailing_silence_s, round(q, 3) AS max_internal_silence_s, n AS n_words_aligned, -o_totalprice / 4000 AS overall_log_likelihood,
  NULL::DOUBLE AS speech_log_likelihood, o_totalprice / 20000 AS phone_duration_deviation, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS snr, aligned,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CASE WHEN o_totalprice < 50000 THEN 'low' ELSE 'high' END ELSE '' END AS segmentation_confidence,
  CASE WHEN o_orderpriority <> '5-LOW' AND o_totalprice < 50000 THEN 'duration_outlier' ELSE '' END AS segmentation_reason,
  CASE WHEN wav THEN '/wavs/' || segment ELSE '' END AS wav_path, CASE WHEN c_acctbal > 0 THEN '/texts/' || segment ELSE '' END AS txt_path, CASE WHEN grid THEN '/grids/' || segment ELSE '' END AS textgrid_path
FROM j""")
def quality_record(spark, folder):
    rows = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).withColumn("segment", F.concat_ws("", F.lit("B"), "c_nationkey", F.lit("_"), "o_custkey", F.lit("_seg_"), "o_orderkey"))
    low = F.col("o_totalprice") < 50000
    report = rows.where("o_orderpriority <> '5-LOW'").select(
        "segment", F.concat(F.lit("given_"), F.col("o_custkey").cast("string")).alias("chapter"),
        F.when(low, "low").otherwise("high").alias("confidence"), F.when(low, "duration_outlier").otherwise("").alias("reason"),
    )
    lines = table(spark, folder, "lineitem")
    spoken = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"), F.min("l_returnflag").alias("flag"))
    words = spoken.join(rows.select(F.col("o_orderkey").alias("l_orderkey"), "segment"), "l_orderkey").select(
        "segment", F.col("l_linenumber").alias("idx"), (F.col("l_linenumber") * 2.0).alias("xmin"),
        (F.col("l_linenumber") * 2.0 + F.least(F.col("quantity") / 25, F.lit(1.9))).alias("xmax"),
        F.when(F.col("flag") == "R", "").otherwise("word").alias("text"),
    )
    analysis = rows.select(
        "segment", F.when(F.col("o_orderpriority") != "1-URGENT", 0.5).alias("begin"), F.lit(15.0).alias("end"),
        (-F.col("o_totalprice") / 4000).alias("overall_log_likelihood"), F.lit(None).cast("double").alias("speech_log_likelihood"),
        (F.col("o_totalprice") / 20000).alias("phone_duration_deviation"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("snr"),
    )
    files = lambda df, root: df.select(F.col("segment").alias("stem"), F.concat(F.lit(root), "segment").alias("path"))
    second = lines.where("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return SG.collect_record(
        analysis, report, files(rows.where("o_orderstatus <> 'P'"), "/grids/"), files(rows.join(second, "o_orderkey", "left_semi"), "/wavs/"),
        files(rows.where("c_acctbal > 0"), "/texts/"), words, "orders",
    )


@query("expected_inventory", """
WITH e AS (SELECT o_orderkey AS book, unnest(range(1, 8))::INT AS num FROM orders),
l AS (SELECT DISTINCT l_orderkey AS book, l_linenumber AS num FROM lineitem WHERE l_linestatus = 'O'),
r AS (SELECT DISTINCT l_orderkey AS book, l_linenumber AS num FROM lineitem WHERE l_returnflag <> 'N'),
f AS (SELECT l.book IS NOT NULL AS hl, r.book IS NOT NULL AS hr FROM e LEFT JOIN l USING (book, num) LEFT JOIN r USING (book, num))
SELECT count(*)::BIGINT AS expected, count(*) FILTER (hl AND hr) AS pairs, count(*) FILTER (NOT (hl AND hr)) AS missing_pairs,
  count(*) FILTER (NOT hl) AS missing_left, count(*) FILTER (NOT hr) AS missing_right FROM f""")
def expected_inventory(spark, folder):
    books = table(spark, folder, "orders").select(F.col("o_orderkey").alias("book"), F.lit(7).alias("n"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("num"), "l_linestatus", "l_returnflag"
    )
    return J.inventory_counts(J.expected_present(books, lines.where("l_linestatus = 'O'"), lines.where("l_returnflag <> 'N'")))


@query("prefix_attestation", f"""
WITH h AS (SELECT DISTINCT unnest({sql_tokens('text')}) AS headword FROM benchmark),
v AS (SELECT DISTINCT token FROM ({SQL_TOKENS}))
SELECT headword FROM h WHERE len(headword) >= 3 AND EXISTS (SELECT 1 FROM v WHERE starts_with(token, headword))""")
def prefix_attestation(spark, folder):
    heads = P.vocabulary(table(spark, folder, "benchmark"), T.tokens("text")).select(F.col("token").alias("headword"))
    return J.attested(heads, P.vocabulary(documents(spark, folder, "text"), T.tokens("text")))


@query("unseen_words", f"""
SELECT DISTINCT tok AS token FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM conversations)
WHERE tok NOT IN (SELECT token FROM ({SQL_TOKENS}))""")
def unseen_words(spark, folder):
    asked = table(spark, folder, "conversations").select(F.explode(T.tokens("text")).alias("token"))
    return J.missing_values(asked, P.vocabulary(documents(spark, folder, "text"), T.tokens("text")), ["token"])


@query("batch_union", """
SELECT event_type AS batch, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def batch_union(spark, folder):
    events = table(spark, folder, "events").select("event_type", "user_id", "value")
    # one batch per kind of event
    kinds = [r["event_type"] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    union = J.union_batches({k: events.where(F.col("event_type") == k) for k in kinds})
    return union.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total")
    )
