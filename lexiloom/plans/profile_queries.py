"""Profiles of the text tables and reports over record tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import profile as P
from lexiloom.plans.registry import SQL_PAIRS, query, sql_pieces, sql_sentences, sql_tokens, table, turn_pairs
from lexiloom.plans.text_queries import STOP, documents

SQL_TOKENS = f"SELECT doc_id, lang, source, unnest({sql_tokens('text')}) AS token FROM documents"


@query("vocabulary", f"SELECT token, count(*)::BIGINT AS n FROM ({SQL_TOKENS}) GROUP BY token")
def vocabulary(spark, folder):
    return P.vocabulary(documents(spark, folder, "text"), T.tokens("text"))


SQL_CHARS = r"SELECT lang, unnest(string_split(regexp_replace(text, '\s+', '', 'g'), '')) AS ch FROM documents"


@query("character_inventory", f"""
SELECT ch, count(*)::BIGINT AS n, 'U+' || printf('%04X', unicode(ch)) AS label FROM ({SQL_CHARS}) WHERE ch <> '' GROUP BY ch""")
def character_inventory(spark, folder):
    return P.charset(documents(spark, folder, "text"))


@query("inventory_coverage", f"""
WITH c AS (SELECT lang, ch, count(*) AS n FROM ({SQL_CHARS}) WHERE ch <> '' GROUP BY ALL),
a AS (SELECT ch, sum(n) AS n FROM c GROUP BY ch),
v AS (SELECT lang AS candidate, ch FROM c WHERE n >= 20),
r AS (SELECT candidate, sum(a.n)::BIGINT AS covered, count(*) AS kinds FROM v JOIN a USING (ch) GROUP BY candidate)
SELECT candidate, covered, (SELECT sum(n) FROM a)::BIGINT AS total, round(covered / (SELECT sum(n) FROM a) * 100, 6) AS covered_pct,
  (SELECT count(*) FROM a) - kinds AS missing_kinds, rank() OVER (ORDER BY covered DESC)::BIGINT AS rank FROM r""")
def inventory_coverage(spark, folder):
    from pyspark.sql import Window

    by_lang = P.charset(documents(spark, folder, "lang", "text"), by=["lang"])
    chars = by_lang.groupBy("ch").agg(F.sum("n").alias("n"))
    inventories = by_lang.where("n >= 20").select(F.col("lang").alias("candidate"), "ch")
    out = P.coverage(chars, inventories)
    # one row per candidate inventory
    rank = F.rank().over(Window.orderBy(F.desc("covered"))).cast("long")
    return out.select("candidate", "covered", "total", F.round("covered_pct", 6).alias("covered_pct"), "missing_kinds", rank.alias("rank"))


@query("missing_characters", f"""
WITH c AS (SELECT lang, ch, count(*) AS n FROM ({SQL_CHARS}) WHERE ch <> '' GROUP BY ALL),
a AS (SELECT ch, sum(n)::BIGINT AS n FROM c GROUP BY ch)
SELECT l.lang AS candidate, a.ch, a.n FROM (SELECT DISTINCT lang FROM c) l CROSS JOIN a
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = l.lang AND c.ch = a.ch)""")
def missing_characters(spark, folder):
    by_lang = P.charset(documents(spark, folder, "lang", "text"), by=["lang"])
    chars = by_lang.groupBy("ch").agg(F.sum("n").alias("n"))
    # one row per language
    names = [r["lang"] for r in by_lang.select("lang").distinct().orderBy("lang").collect()]
    return P.missing_characters(chars, by_lang.select(F.col("lang").alias("candidate"), "ch"), names)


@query("reduction_report", rf"""
WITH k AS (SELECT lang, text, regexp_replace(text, '\S*[0-9]\S*', ' ', 'g') AS t FROM documents)
SELECT lang, count(*)::BIGINT AS rows, sum(len({sql_tokens('text')}))::BIGINT AS words_before, sum(len({sql_tokens('t')}))::BIGINT AS words_after,
  round(100 * (1 - sum(len({sql_tokens('t')})) / sum(len({sql_tokens('text')}))), 6) AS reduction_pct FROM k GROUP BY lang""")
def reduction_report(spark, folder):
    docs = documents(spark, folder, "lang", "text")
    out = P.reduction(docs, T.word_count("text"), T.word_count(T.strip_numerals("text")["text"]), ["lang"])
    return out.withColumn("reduction_pct", F.round("reduction_pct", 6))


@query("oov_rate", f"""
WITH v AS (SELECT token FROM ({SQL_TOKENS}) WHERE source <> 'src0' GROUP BY token HAVING count(*) >= 2),
e AS (SELECT DISTINCT token FROM ({SQL_TOKENS}) WHERE source = 'src0')
SELECT count(*)::BIGINT AS types, count(*) FILTER (token NOT IN (SELECT token FROM v)) AS oov,
  round(count(*) FILTER (token NOT IN (SELECT token FROM v)) / count(*) * 100, 6) AS oov_pct FROM e""")
def oov_rate(spark, folder):
    docs = documents(spark, folder, "source", "text")
    known = P.vocabulary(docs.where("source <> 'src0'"), T.tokens("text"))
    held = docs.where("source = 'src0'").select(F.explode(T.tokens("text")).alias("token"))
    return P.oov_rate(known, held, 2).withColumn("oov_pct", F.round("oov_pct", 6))


@query("length_ratio_profile", f"""
WITH r AS (SELECT len(a_text) / len(b_text) AS r FROM ({SQL_PAIRS}))
SELECT unnest(['min', 'p5', 'p25', 'median', 'p75', 'p95', 'max']) AS point,
  round(unnest(quantile_cont(r, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])), 6) AS value FROM r""")
def length_ratio_profile(spark, folder):
    pairs = turn_pairs(spark, folder)
    return P.ratio_profile(pairs, F.try_divide(F.length("a_text"), F.length("b_text"))).select("point", F.round("value", 6).alias("value"))


@query("sentence_packing", f"""
WITH c AS (SELECT len(regexp_extract_all(a_text, '[.]')) AS a, len(regexp_extract_all(b_text, '[.]')) AS b FROM ({SQL_PAIRS})),
x AS (SELECT 'a' AS side, CASE WHEN a >= 2 THEN '2+' ELSE a::VARCHAR END AS bucket FROM c
  UNION ALL SELECT 'b', CASE WHEN b >= 2 THEN '2+' ELSE b::VARCHAR END FROM c
  UNION ALL SELECT 'both_multi', (a >= 2 AND b >= 2)::VARCHAR FROM c
  UNION ALL SELECT 'either_multi', (a >= 2 OR b >= 2)::VARCHAR FROM c)
SELECT side, bucket, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM c) * 100, 6) AS pct FROM x GROUP BY ALL""")
def sentence_packing(spark, folder):
    ends = lambda c: F.regexp_count(c, F.lit("[.]"))
    out = P.sentence_packing(turn_pairs(spark, folder), ends(F.col("a_text")), ends(F.col("b_text")))
    return out.withColumn("pct", F.round("pct", 6))


@query("split_report", f"""
WITH d AS (SELECT CASE WHEN source IN ('src3', 'src7') THEN 'validation' ELSE 'train' END AS split, text, n_chars / 15.0 AS duration_s FROM documents),
u AS (SELECT * FROM d UNION ALL SELECT 'total', text, duration_s FROM d),
t AS (SELECT split, count(DISTINCT tok) AS types FROM (SELECT split, unnest({sql_tokens('text')}) AS tok FROM u) GROUP BY split)
SELECT split, count(*)::BIGINT AS clips, round(sum(duration_s) / 3600, 6) AS hours, sum(len({sql_tokens('text')}))::BIGINT AS tokens,
  any_value(types)::BIGINT AS types, round(list_sort(list(duration_s))[count(*) // 2 + 1], 6) AS median
FROM u JOIN t USING (split) GROUP BY split""")
def split_report(spark, folder):
    from lexiloom.operators.splits import split_groups

    docs = documents(spark, folder, "source", "text", "n_chars").withColumn("duration_s", F.col("n_chars") / 15.0)
    out = P.split_report(split_groups(docs, "source", ["src3", "src7"]))
    return out.select("split", "clips", F.round("hours", 6).alias("hours"), "tokens", "types", F.round("median", 6).alias("median"))


# ---- quality records: order lines stand in for aligned segments

LINE_TESTS = (
    ("under", "l_quantity", "min_quantity", "too_short"),
    ("over", "l_quantity", "max_quantity", "too_long"),
    ("under", "l_extendedprice", "min_price", "low_likelihood"),
    ("over", "l_discount", "max_discount", "phone_duration_outlier"),
    ("over", "l_tax", "max_tax", "long_internal_silence"),
    ("under", "l_linenumber", "min_line", "too_few_words"),
)
LINE_LIMITS = {"min_quantity": 3.0, "max_quantity": 48.0, "min_price": 2000.0, "max_discount": 0.095, "max_tax": None, "min_line": 2}
SQL_JUDGED = """
SELECT *, CASE WHEN l_returnflag = 'R' THEN 'alignment_failed' ELSE array_to_string(list_filter([
  CASE WHEN l_quantity < 3.0 THEN 'too_short' END, CASE WHEN l_quantity > 48.0 THEN 'too_long' END,
  CASE WHEN l_extendedprice < 2000.0 THEN 'low_likelihood' END, CASE WHEN l_discount > 0.095 THEN 'phone_duration_outlier' END,
  CASE WHEN l_linenumber < 2 THEN 'too_few_words' END], lambda x: x IS NOT NULL), ';') END AS qc_reasons FROM lineitem"""


def judged_lines(spark, folder):
    from lexiloom.operators.segments import judge

    lines = table(spark, folder, "lineitem").withColumn("aligned", F.col("l_returnflag") != "R")
    return judge(lines, LINE_LIMITS, LINE_TESTS)


@query("quality_verdict", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, qc_reasons, qc_reasons = '' AS qc_pass FROM ({SQL_JUDGED})")
def quality_verdict(spark, folder):
    out = judged_lines(spark, folder)
    return out.select("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "qc_reasons", "qc_pass")


@query("reason_counts", f"""
WITH j AS ({SQL_JUDGED}), r AS (SELECT unnest(string_split(qc_reasons, ';')) AS reason FROM j)
SELECT reason, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM j), 6) AS share FROM r WHERE reason <> '' GROUP BY reason""")
def reason_counts(spark, folder):
    return P.reason_counts(judged_lines(spark, folder)).withColumn("share", F.round("share", 6))


@query("lowest_yield", f"""
SELECT l_suppkey, count(*)::BIGINT AS total, count(*) FILTER (qc_reasons = '') AS passed, round(count(*) FILTER (qc_reasons = '') / count(*), 6) AS pass_rate
FROM ({SQL_JUDGED}) GROUP BY l_suppkey ORDER BY count(*) FILTER (qc_reasons = '') / count(*), l_suppkey LIMIT 5""")
def lowest_yield(spark, folder):
    return P.yield_by(judged_lines(spark, folder), "l_suppkey", "qc_pass", 5).withColumn("pass_rate", F.round("pass_rate", 6))


@query("kept_share", f"""
SELECT round(sum(CASE WHEN qc_reasons = '' THEN l_quantity ELSE 0 END), 2) AS kept, round(sum(l_quantity), 2) AS total,
  round(sum(CASE WHEN qc_reasons = '' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share FROM ({SQL_JUDGED})""")
def kept_share(spark, folder):
    out = P.kept_share(judged_lines(spark, folder), F.col("qc_pass"), F.col("l_quantity"), F.col("l_quantity"))
    return out.select(F.round("kept", 2).alias("kept"), F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("threshold_calibration", """
SELECT 'l_quantity' AS metric, 0.05::DOUBLE AS prob, round(quantile_cont(l_quantity, 0.05), 6) AS value FROM lineitem
UNION ALL SELECT 'l_extendedprice', 0.95, round(quantile_cont(l_extendedprice, 0.95), 6) FROM lineitem
UNION ALL SELECT 'l_discount', 0.95, round(quantile_cont(l_discount, 0.95), 6) FROM lineitem""")
def threshold_calibration(spark, folder):
    lines = table(spark, folder, "lineitem")
    out = P.calibrate(lines, {"l_quantity": 0.05, "l_extendedprice": 0.95, "l_discount": 0.95}, resolution=100.0)
    return out.withColumn("value", F.round("value", 6))


@query("outcome_rate", """
SELECT o_orderpriority, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F') AS hits, round(avg((o_orderstatus = 'F')::INT), 6) AS rate
FROM orders GROUP BY o_orderpriority""")
def outcome_rate(spark, folder):
    out = P.rate_by(table(spark, folder, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")
    return out.withColumn("rate", F.round("rate", 6))


@query("outcome_correlation", """
SELECT 'o_totalprice' AS metric, round(corr(o_totalprice, (o_orderstatus = 'F')::INT), 6) AS corr FROM orders
UNION ALL SELECT 'o_custkey', round(corr(o_custkey, (o_orderstatus = 'F')::INT), 6) FROM orders""")
def outcome_correlation(spark, folder):
    out = P.corr_with_outcome(table(spark, folder, "orders"), ["o_totalprice", "o_custkey"], F.col("o_orderstatus") == "F")
    return out.withColumn("corr", F.round("corr", 6))


def _sql_context(suffix: str) -> str:
    has = f"len(list_filter(w, lambda x: ends_with(x, '{suffix}'))) > 0"
    return f"""SELECT '{suffix}' AS suffix, count(*) FILTER ({has}) AS sentences, count(*) FILTER ({has} AND m) AS with_marker,
  round(count(*) FILTER ({has} AND m) / count(*) FILTER ({has}), 6) AS rate FROM c"""


@query("context_rate", f"""
WITH c AS (SELECT w, list_has_any(w, ['the', 'la', 'der', 'un']) AS m FROM (SELECT {sql_tokens('text')} AS w FROM ({sql_sentences('doc_id')})))
{_sql_context('ing')} UNION ALL {_sql_context('tion')} UNION ALL {_sql_context('en')}""")
def context_rate(spark, folder):
    sentences = P.sentences(documents(spark, folder, "doc_id", "text"), ["doc_id"], terminators=STOP)
    out = P.context_rate(sentences, ["ing", "tion", "en"], ["the", "la", "der", "un"])
    return out.withColumn("rate", F.round("rate", 6))
