"""Evaluation-set mining, pronunciation and sequence metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import metrics as Q
from lexiloom.operators import mining as M
from lexiloom.operators import profile as P
from lexiloom.operators import pronounce as G
from lexiloom.plans.profile_queries import SQL_TOKENS
from lexiloom.plans.registry import query, sql_tokens, table
from lexiloom.plans.text_queries import documents
from lexiloom.session import cut_lineage

SQL_COUNTS = f"SELECT token, count(*)::BIGINT AS n FROM ({SQL_TOKENS}) GROUP BY token"


def counts(spark, folder):
    return P.vocabulary(documents(spark, folder, "text"), T.tokens("text"))


@query("dictionary_filter", f"""
SELECT ltrim(token, '#*') AS headword, n FROM ({SQL_COUNTS}) WHERE len(ltrim(token, '#*')) > 1 AND NOT regexp_matches(ltrim(token, '#*'), '[0-9]') AND n > 1""")
def dictionary_filter(spark, folder):
    """Words as headwords; a word seen once has no gloss."""
    words = counts(spark, folder).select(
        F.col("token").alias("headword"), "n", F.when(F.col("n") > 1, F.array("token")).otherwise(F.array().cast("array<string>")).alias("glosses")
    )
    return M.filter_dictionary(words, "#*").select("headword", "n")


SQL_BAGS = f"""
WITH e AS (SELECT item_id, list_sort(list_distinct({sql_tokens('text')})) AS g FROM benchmark),
i AS (SELECT w, ln((SELECT count(*) FROM e) / count(*)) AS idf FROM (SELECT unnest(g) AS w FROM e) GROUP BY w),
x AS (SELECT item_id AS bag, unnest(g) AS w FROM e), y AS (SELECT bag, w, idf FROM x JOIN i USING (w) WHERE idf > 0),
t AS (SELECT bag, sum(idf) AS s FROM y GROUP BY bag),
o AS (SELECT p.bag AS a, q.bag AS b, sum(p.idf) AS c FROM y p JOIN y q ON p.w = q.w AND p.bag < q.bag GROUP BY ALL),
s AS (SELECT a, b, c / (ta.s + tb.s - c) AS score FROM o JOIN t ta ON ta.bag = a JOIN t tb ON tb.bag = b)"""


def similar_items(spark, folder):
    items = table(spark, folder, "benchmark").select("item_id", T.tokens("text").alias("glosses"))
    return M.idf_jaccard(items, "item_id", "glosses")


@query("gloss_similarity", f"{SQL_BAGS} SELECT a, b, round(score, 6) AS score FROM s")
def gloss_similarity(spark, folder):
    return similar_items(spark, folder).withColumn("score", F.round("score", 6))


SQL_HEADS = f"SELECT item_id, ({sql_tokens('text')})[1] AS head FROM benchmark"
SQL_STEMS = f"""{SQL_BAGS}, h AS ({SQL_HEADS}),
k AS (SELECT ha.head AS word1, hb.head AS word2, score FROM s JOIN h ha ON ha.item_id = a JOIN h hb ON hb.item_id = b
  WHERE substr(ha.head, 1, ceil(least(len(ha.head), len(hb.head)) * 0.6::DOUBLE - 1e-9)::INT) <> substr(hb.head, 1, ceil(least(len(ha.head), len(hb.head)) * 0.6::DOUBLE - 1e-9)::INT))"""


def distinct_stems(spark, folder):
    """Similar items named by their first word, without pairs of one stem."""
    heads = table(spark, folder, "benchmark").select("item_id", F.get(T.tokens("text"), F.lit(0)).alias("head"))
    end = lambda side, name: heads.select(F.col("item_id").alias(side), F.col("head").alias(name))
    pairs = similar_items(spark, folder).join(end("a", "word1"), "a").join(end("b", "word2"), "b")
    return M.exclude_same_stem(pairs.select("word1", "word2", "score"))


@query("stem_exclusion", f"{SQL_STEMS} SELECT word1, word2, round(score, 6) AS score FROM k")
def stem_exclusion(spark, folder):
    return distinct_stems(spark, folder).withColumn("score", F.round("score", 6))


@query("similarity_set", f"""{SQL_STEMS}
SELECT word1, word2, coalesce(round((score - (SELECT min(score) FROM k)) / nullif((SELECT max(score) FROM k) - (SELECT min(score) FROM k), 0), 6), 0) AS score FROM k""")
def similarity_set(spark, folder):
    return M.minmax(cut_lineage(distinct_stems(spark, folder), "pairs"), "score").withColumn("score", F.round("score", 6))


SQL_CLUSTERS = f"""
WITH v AS ({SQL_COUNTS}), c AS (SELECT token, n, unnest(range(1, least(5, len(token) - 1) + 1)) AS k FROM v WHERE len(token) > 1),
f AS (SELECT substr(token, 1, len(token) - k) AS stem, substr(token, len(token) - k + 1) AS suffix, token AS form, n FROM c WHERE len(token) - k >= 3),
cl AS (SELECT *, count(*) OVER (PARTITION BY stem) AS n_forms FROM f),
q AS (SELECT * FROM cl WHERE n_forms >= 3),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, suffix) AS r FROM q) WHERE r <= 8),
pp AS (SELECT a.stem, a.suffix AS s1, b.suffix AS s2, a.form AS f1, b.form AS f2, a.n AS n1, b.n AS n2 FROM tp a JOIN tp b ON a.stem = b.stem AND a.suffix < b.suffix),
sp AS (SELECT s1, s2, count(*)::BIGINT AS paradigms FROM pp GROUP BY s1, s2 HAVING count(*) >= 3)"""


def clusters(spark, folder):
    return M.stem_clusters(counts(spark, folder))


@query("stem_clusters", f"{SQL_CLUSTERS} SELECT stem, suffix, form, n, n_forms FROM q")
def stem_clusters(spark, folder):
    return clusters(spark, folder)


@query("suffix_pairs", f"{SQL_CLUSTERS} SELECT s1, s2, paradigms FROM sp")
def suffix_pairs(spark, folder):
    return M.suffix_pairs(clusters(spark, folder))


@query("analogy_set", f"""{SQL_CLUSTERS},
g AS (SELECT s1, s2, stem, f1, f2, n1 + n2 AS s FROM pp JOIN sp USING (s1, s2) WHERE n1 >= 5 AND n2 >= 5)
SELECT x.s1, x.s2, x.stem AS stem1, y.stem AS stem2, x.f1 AS a, x.f2 AS b, y.f1 AS c, y.f2 AS d, (x.s + y.s)::BIGINT AS total
FROM g x JOIN g y ON x.s1 = y.s1 AND x.s2 = y.s2 AND x.stem < y.stem ORDER BY total DESC, x.s1, x.s2, stem1, stem2 LIMIT 30""")
def analogy_set(spark, folder):
    words = cut_lineage(clusters(spark, folder), "clusters")
    return M.cap_and_trim(M.quadruples(words, M.suffix_pairs(words)))


# ---- pronunciation with a plain Latin table

LATIN_SOUNDS = G.SoundRules(
    independent_vowels={c: c for c in "aeiou"},
    matras={},
    consonants={c: c for c in "bcdfghjklmnpqrstvwxyz"},
    strip=".,;:!?#$%&*",
)
SQL_SPOKEN = f"""
WITH w AS (SELECT DISTINCT trim(token, '.,;:!?#$%&*') AS word FROM (SELECT DISTINCT token FROM ({SQL_TOKENS}))),
s AS (SELECT word, string_split(word, '') AS c FROM w WHERE word <> ''),
p AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]+$') THEN array_to_string(list_transform(c, lambda x: x), '') END AS ok,
  array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN NOT regexp_matches(c[i], '[a-z]') THEN (i - 1) || c[i] END), lambda x: x IS NOT NULL), ' ') AS unmapped FROM s)"""


def spoken(spark, folder):
    words = G.pronunciation_vocabulary(documents(spark, folder, "text"), rules=LATIN_SOUNDS)
    return cut_lineage(G.pronounce(words, LATIN_SOUNDS), "lexicon")


# consonants take the inherent vowel, vowels stand for themselves
SQL_PHONES = r"trim(regexp_replace(regexp_replace(regexp_replace(ok, '([b-df-hj-np-tv-z])', ' \1+', 'g'), '([aeiou])', ' \1', 'g'), '[+]', ' a', 'g'))"


@query("pronunciations", f"{SQL_SPOKEN} SELECT word, {SQL_PHONES} AS phones, unmapped FROM p")
def pronunciations(spark, folder):
    bad = F.transform("unmapped", lambda u: F.concat(u["idx"].cast("string"), u["ch"]))
    return spoken(spark, folder).select("word", F.array_join("phones", " ").alias("phones"), F.array_join(bad, " ").alias("unmapped"))


@query("pronunciation_summary", f"""{SQL_SPOKEN}
SELECT count(*)::BIGINT AS words, count(ok)::BIGINT AS mapped, count(*) FILTER (ok IS NULL) AS unmapped, round(100 * count(ok) / count(*), 6) AS coverage_pct FROM p""")
def pronunciation_summary(spark, folder):
    return G.lexicon_summary(spoken(spark, folder)).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("phone_inventory", f"""{SQL_SPOKEN},
f AS (SELECT unnest(string_split({SQL_PHONES}, ' ')) AS phone FROM p WHERE ok IS NOT NULL)
SELECT phone, count(*)::BIGINT AS n FROM f GROUP BY phone""")
def phone_inventory(spark, folder):
    return G.phone_inventory(spoken(spark, folder))


# ---- sequence metrics: an embedding is a clip of 16 frames of 4 values

def clips(spark, folder):
    frames = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    vecs = table(spark, folder, "embeddings").select("vec_id", frames.alias("frames"), "embedding")
    following = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("frames").alias("syn"), F.col("embedding").alias("syn_f0"))
    return vecs.select("vec_id", F.col("frames").alias("ref"), F.col("embedding").alias("ref_f0")).join(following, "vec_id")


@query("warping_path")
def warping_path(spark, folder):
    return Q.dtw(clips(spark, folder), ["vec_id"])


@query("warped_distance")
def warped_distance(spark, folder):
    pairs = clips(spark, folder)
    rows = Q.on_path(Q.dtw(pairs, ["vec_id"]), pairs, ["vec_id"], a_i="ref", b_j="syn")
    return Q.aligned_db(rows, ["vec_id"], "a_i", "b_j").withColumn("mcd_db", F.round("mcd_db", 4))


# A frame of the identity path is position i of both clips.
@query("frame_distance", """
WITH f AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, unnest(range(0, 16)) AS i FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(avg(10 / ln(10.0) * sqrt(2.0) * sqrt(list_sum(list_transform(range(1, 5), lambda k: pow(x[i * 4 + k] - y[i * 4 + k], 2))))), 5) AS mcd_db FROM f GROUP BY vec_id""")
def frame_distance(spark, folder):
    rows = clips(spark, folder).select("vec_id", F.explode(F.arrays_zip("ref", "syn")).alias("f")).select("vec_id", "f.ref", "f.syn")
    return Q.aligned_db(rows, ["vec_id"], "ref", "syn").withColumn("mcd_db", F.round("mcd_db", 5))


SQL_VOICED = """
SELECT a.user_id, round(sqrt(avg(pow((a.value - 20) - (b.value - 20), 2)) FILTER (a.value > 20 AND b.value > 20)), 5) AS f0_rmse_hz
FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY a.user_id"""


def voiced(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", (F.col("value") - 20).alias("x"))
    following = events.select((F.col("event_id") - 1).alias("event_id"), F.col("x").alias("y"))
    return Q.voiced_rmse(events.join(following, "event_id"), ["user_id"], "x", "y").withColumn("f0_rmse_hz", F.round("f0_rmse_hz", 5))


@query("voiced_rmse", SQL_VOICED)
def voiced_rmse(spark, folder):
    return voiced(spark, folder)


@query("clip_summary", f"SELECT count(*)::BIGINT AS n_clips, round(avg(f0_rmse_hz), 5) AS mean_f0_rmse_hz FROM ({SQL_VOICED})")
def clip_summary(spark, folder):
    return Q.clip_summary(voiced(spark, folder), ["f0_rmse_hz"]).withColumn("mean_f0_rmse_hz", F.round("mean_f0_rmse_hz", 5))
