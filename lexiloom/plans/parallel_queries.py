"""Parallel corpus over conversation turns: a user turn and its reply are the two sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import joins as J
from lexiloom.operators import ngrams as L
from lexiloom.operators import parallel as A
from lexiloom.operators.splits import split_pairs
from lexiloom.plans.registry import SQL_PAIRS, query, sql_marks, sql_pieces, sql_tokens, sql_trim, table, turn_pairs
from lexiloom.plans.text_queries import documents
from lexiloom.session import cut_lineage, scratch_path
from lexiloom.sources import files as R
from lexiloom.sources import sinks as W

KEY = ["conv_id", "turn"]
ENDS = ".?!"
SQL_SIDES = f"SELECT conv_id, turn, {sql_pieces('a_text', ENDS)} AS a, {sql_pieces('b_text', ENDS)} AS b FROM ({SQL_PAIRS})"
SQL_EVEN = f"""SELECT conv_id, turn, unnest(range(len(a))) AS pos, unnest(a) AS a_sentence, unnest(b) AS b_sentence FROM ({SQL_SIDES}) WHERE len(a) = len(b)"""


def sides(spark, folder):
    pairs = turn_pairs(spark, folder)
    return pairs.select(*KEY, T.split_quoted("a_text", ENDS).alias("a_sentences"), T.split_quoted("b_text", ENDS).alias("b_sentences"))


def even_pairs(spark, folder):
    """Sentence pairs of turns with equally many sentences, in order."""
    return A.align_in_order(sides(spark, folder), KEY)


def constants(rows):
    single = rows.where((F.size("a_sentences") == 1) & (F.size("b_sentences") == 1))
    return A.estimate_constants(single, F.length(F.get("a_sentences", F.lit(0))), F.length(F.get("b_sentences", F.lit(0))))


def aligned(spark, folder):
    # written, as each use of a column of sentences would split the text anew
    rows = cut_lineage(sides(spark, folder), "sides")
    c = constants(rows).first()
    usable = c["pairs"] > 1
    return A.align_sentences(rows, KEY, c["c"] if usable else 1.0, c["s2"] if usable and c["s2"] > 0 else 6.8)


# ---- the chain from marked-up books in archives to rated verse pairs

def verse_text(col: str) -> str:
    return rf"array_to_string(list_filter(list_transform(string_split({col}, chr(10)), lambda s: {sql_trim('s')}), lambda s: s <> ''), ' ')"


SQL_VERSES = f"""
WITH t AS (SELECT lpad((conv_id % 1000)::VARCHAR, 3, '0') AS book, (conv_id // 1000 + 1)::INT AS chapter, turn::INT AS turn, role, conv_id, {verse_text('text')} AS text FROM conversations),
a AS (SELECT book, chapter, turn + 1 AS verse, text FROM t WHERE role = 'user'),
b AS (SELECT book, chapter, turn AS verse, text FROM t WHERE role = 'assistant' UNION ALL SELECT book, chapter, turn + 1, text FROM t WHERE role = 'assistant' AND conv_id % 7 = 0),
j AS (SELECT book, chapter, verse, a.text AS a_text, b.text AS b_text FROM a FULL JOIN b USING (book, chapter, verse))"""


def marked_books(spark, folder, role, first, bridges=None):
    """(file, text): a marked-up book for each conversation, a verse for each turn of one role, some over two verses."""
    turns = table(spark, folder, "conversations").where(F.col("role") == role)
    number = F.col("turn").cast("int") + first
    verse = F.when(bridges, F.format_string("%d-%d", number, number + 1)).otherwise(number.cast("string")) if bridges is not None else number.cast("string")
    lines = turns.select("conv_id", "turn", F.concat(F.lit("\\v "), verse, F.lit(" "), F.coalesce("text", F.lit(""))).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    head = F.format_string("\\id %s\n\\c %d\n", F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0"), F.floor(F.col("conv_id") / 1000) + 1)
    # a book is one member of an archive, so one row
    return lines.groupBy("conv_id").agg(body.alias("body")).select(F.format_string("%09d-%s.usfm", "conv_id", F.lit(role)).alias("file"), F.concat(head, "body").alias("text"))


def verse_pairs(spark, folder):
    path = scratch_path(spark, "books")
    W.write_archives(marked_books(spark, folder, "user", 1), f"{path}/a")
    W.write_archives(marked_books(spark, folder, "assistant", 0, F.col("conv_id") % 7 == 0), f"{path}/b")
    read = lambda side, role: R.scan_archive(spark, f"{path}/{side}", [role]).select("file", "line_no", "line")
    a, b = A.verse_units(read("a", "-user"), "a"), A.verse_units(read("b", "-assistant"), "b")
    return J.verse_join(A.expand_bridges(a), A.expand_bridges(b), ["book", "chapter", "verse"], "text", "text")


@query("parallel_corpus", f"""{SQL_VERSES}
SELECT book, chapter, verse, a_text, b_text, len(a_text) / len(b_text) BETWEEN 0.3 AND 3.0 AS kept FROM j WHERE a_text IS NOT NULL AND b_text IS NOT NULL""")
def parallel_corpus(spark, folder):
    """Books from archives, their verses joined, rated by length."""
    both = verse_pairs(spark, folder).where("side = 'both'")
    return A.with_ratio(both).select("book", "chapter", "verse", "a_text", "b_text", "kept")


@query("verse_coverage", f"""{SQL_VERSES}
SELECT CASE WHEN a_text IS NULL THEN 'b_only' WHEN b_text IS NULL THEN 'a_only' ELSE 'both' END AS side, count(*)::BIGINT AS n FROM j GROUP BY 1""")
def verse_coverage(spark, folder):
    return J.coverage_counts(verse_pairs(spark, folder))


@query("ratio_kept", f"SELECT conv_id, turn, a_text, b_text FROM ({SQL_PAIRS}) WHERE len(a_text) / len(b_text) BETWEEN 0.3 AND 3.0")
def ratio_kept(spark, folder):
    return A.ratio_filter(turn_pairs(spark, folder))[0]


@query("ratio_excluded", f"SELECT conv_id, turn, a_text, b_text FROM ({SQL_PAIRS}) WHERE NOT coalesce(len(a_text) / len(b_text) BETWEEN 0.3 AND 3.0, false)")
def ratio_excluded(spark, folder):
    return A.ratio_filter(turn_pairs(spark, folder))[1]


@query("alignment_constants", f"""
WITH p AS (SELECT len(a_text) AS a, len(b_text) AS b FROM ({SQL_PAIRS})), c AS (SELECT avg(b / a) AS c FROM p)
SELECT count(*)::BIGINT AS pairs, round(any_value(c), 6) AS c, round(var_samp((b - c * a) / sqrt(a)), 3) AS s2 FROM p, c""")
def alignment_constants(spark, folder):
    out = A.estimate_constants(turn_pairs(spark, folder), F.length("a_text"), F.length("b_text"))
    return out.select("pairs", F.round("c", 6).alias("c"), F.round("s2", 3).alias("s2"))


@query("alignment_in_order", f"SELECT conv_id, turn, pos, a_sentence, b_sentence, '1:1' AS alignment_type, 'length_only' AS confidence_signal FROM ({SQL_EVEN})")
def alignment_in_order(spark, folder):
    return even_pairs(spark, folder)


@query("sentence_alignment")
def sentence_alignment(spark, folder):
    return A.matched(aligned(spark, folder))


@query("alignment_unmatched")
def alignment_unmatched(spark, folder):
    return A.unmatched(aligned(spark, folder))


# Every pair of equal counts is one row per sentence, every other row covers its sentences once.
@query("alignment_coverage", f"""
SELECT conv_id, turn, array_to_string(a, ' ') AS a_text, array_to_string(b, ' ') AS b_text FROM ({SQL_SIDES}) WHERE len(a) + len(b) > 0""")
def alignment_coverage(spark, folder):
    """Both sides read back from the aligned chain."""
    back = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), lambda t: t != ""), " ")
    return aligned(spark, folder).groupBy(*KEY).agg(back("a_sentence").alias("a_text"), back("b_sentence").alias("b_text"))


SQL_CELLS = f"""
SELECT conv_id, turn, pos, s, t, ns, nt, total FROM (
  SELECT conv_id, turn, pos, s, count(*) AS ns FROM (SELECT conv_id, turn, pos, unnest({sql_marks('a_sentence')}) AS s FROM ({SQL_EVEN})) GROUP BY ALL)
JOIN (SELECT conv_id, turn, pos, t, count(*) AS nt FROM (SELECT conv_id, turn, pos, unnest({sql_marks('b_sentence')}) AS t FROM ({SQL_EVEN})) GROUP BY ALL) USING (conv_id, turn, pos)
JOIN (SELECT conv_id, turn, pos, len({sql_marks('a_sentence')}) AS total FROM ({SQL_EVEN})) USING (conv_id, turn, pos)"""


def cells(spark, folder):
    pairs = even_pairs(spark, folder)
    return A.alignment_cells(pairs, [*KEY, "pos"], T.tokenize_punct("a_sentence"), T.tokenize_punct("b_sentence"))


@query("first_round_counts", f"""SELECT s AS source, t AS target, round(sum(nt * ns / total), 6) AS expected FROM ({SQL_CELLS}) GROUP BY s, t""")
def first_round_counts(spark, folder):
    out = A.first_counts(cells(spark, folder))
    return out.select(F.col("s").alias("source"), F.col("t").alias("target"), F.round("c", 6).alias("expected"))


@query("word_alignment")
def word_alignment(spark, folder):
    """Link counts after three EM rounds over all matched sentence pairs."""
    pairs = cut_lineage(A.matched(aligned(spark, folder)), "sentence-pairs")
    links, _ = A.align_words(pairs, [*KEY, "pos"], T.tokenize_punct("a_sentence"), T.tokenize_punct("b_sentence"), 3)
    return links


SQL_TOGETHER = f"SELECT s AS source, t AS target, count(*)::BIGINT AS frequency FROM ({SQL_CELLS}) GROUP BY s, t"
SQL_CLEAN = f"SELECT * FROM ({SQL_TOGETHER}) WHERE NOT (regexp_matches(source, '^[\\p{{P}}\\p{{S}}]+$') AND regexp_matches(target, '^[\\p{{P}}\\p{{S}}]+$'))"


def together(spark, folder):
    """Word pairs with the number of sentence pairs they occur in."""
    return cells(spark, folder).groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count(F.lit(1)).alias("frequency"))


@query("filtered_lexicon", f"SELECT * FROM ({SQL_CLEAN}) WHERE frequency >= 3")
def filtered_lexicon(spark, folder):
    return A.filter_lexicon(together(spark, folder))


@query("threshold_sweep", f"""
WITH c AS ({SQL_CLEAN}), k AS (SELECT unnest([2, 3, 5])::BIGINT AS threshold)
SELECT threshold, (SELECT count(*) FROM c WHERE frequency >= threshold) AS pairs, round((SELECT count(*) FROM c WHERE frequency >= threshold) / (SELECT count(*) FROM c) * 100, 6) AS pct FROM k""")
def threshold_sweep(spark, folder):
    return A.threshold_sweep(together(spark, folder)).withColumn("pct", F.round("pct", 6))


@query("frequency_distribution", f"WITH c AS ({SQL_CLEAN}) SELECT frequency, count(*)::BIGINT AS pairs, round(count(*) / (SELECT count(*) FROM c) * 100, 6) AS pct FROM c GROUP BY frequency")
def frequency_distribution(spark, folder):
    return A.frequency_distribution(together(spark, folder)).withColumn("pct", F.round("pct", 6))


# Bigrams stand in for a dictionary: a word's glosses are its three commonest followers.
def _sql_bigrams(source: str) -> str:
    return f"SELECT context, next, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(['<s>'], w)) AS context, unnest(list_concat(w, ['</s>'])) AS next FROM (SELECT {sql_tokens('text')} AS w FROM {source})) GROUP BY ALL"


SQL_JUDGED_PAIRS = f"""
WITH ref AS (SELECT context AS source, list(next) AS glosses FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS r FROM ({_sql_bigrams('documents')})) WHERE r <= 3 GROUP BY context),
p AS (SELECT context AS source, next AS target, n AS frequency FROM ({_sql_bigrams('conversations')})),
j AS (SELECT source, target, frequency, CASE WHEN glosses IS NULL THEN 'not_in_ref' WHEN list_contains(glosses, target) THEN 'agree' ELSE 'disagree' END AS status FROM p LEFT JOIN ref USING (source))"""


def dictionary(spark, folder):
    model = L.ngram_model(documents(spark, folder, "text"), T.tokens("text"), 2)
    top = L.commonest_next(model, 3)
    return top.groupBy(F.col("context").alias("headword")).agg(F.collect_list("next").alias("glosses"))


def candidate_pairs(spark, folder):
    model = L.ngram_model(table(spark, folder, "conversations"), T.tokens("text"), 2)
    return model.select(F.col("context").alias("source"), F.col("next").alias("target"), F.col("n").alias("frequency"))


@query("lexicon_status", f"{SQL_JUDGED_PAIRS} SELECT * FROM j")
def lexicon_status(spark, folder):
    return J.judge_lexicon(candidate_pairs(spark, folder), dictionary(spark, folder))


@query("lexicon_quality", f"""{SQL_JUDGED_PAIRS}
SELECT count(*)::BIGINT AS pairs, count(*) FILTER (status <> 'not_in_ref') AS in_reference, count(*) FILTER (status = 'agree') AS agree,
  round(count(*) FILTER (status = 'agree') / count(*) FILTER (status <> 'not_in_ref') * 100, 6) AS precision_pct, (SELECT count(*) FROM ref) AS headwords,
  count(DISTINCT source) FILTER (status <> 'not_in_ref') AS covered, round(count(DISTINCT source) FILTER (status <> 'not_in_ref') / (SELECT count(*) FROM ref) * 100, 6) AS coverage_pct FROM j""")
def lexicon_quality(spark, folder):
    out = A.lexicon_quality(candidate_pairs(spark, folder), dictionary(spark, folder))
    return out.withColumn("precision_pct", F.round("precision_pct", 6)).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("lexicon_overlap", f"""
WITH ref AS (SELECT context AS source, unnest(list(next)) AS gloss FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS r FROM ({_sql_bigrams('documents')})) WHERE r <= 3 GROUP BY context),
i AS (SELECT gloss, ln((SELECT count(DISTINCT source) FROM ref) / count(DISTINCT source)) AS idf FROM ref GROUP BY gloss),
w AS (SELECT DISTINCT conv_id, turn, unnest({sql_marks('a_text')}) AS source FROM ({SQL_PAIRS})),
g AS (SELECT DISTINCT conv_id, turn, gloss FROM w JOIN ref USING (source)),
t AS (SELECT DISTINCT conv_id, turn, unnest({sql_marks('b_text')}) AS gloss FROM ({SQL_PAIRS})),
s AS (SELECT conv_id, turn, sum(idf) AS score FROM g JOIN t USING (conv_id, turn, gloss) JOIN i USING (gloss) GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(score, 0), 5) AS lexicon_score FROM ({SQL_PAIRS}) LEFT JOIN s USING (conv_id, turn)""")
def lexicon_overlap(spark, folder):
    ref = cut_lineage(dictionary(spark, folder), "dictionary")
    out = A.lexicon_overlap(turn_pairs(spark, folder), ref, KEY, "a_text", "b_text")
    return out.withColumn("lexicon_score", F.round("lexicon_score", 5))


# ---- scores: the reply as hypothesis for the user turn, and the other way round

def hypotheses(spark, folder):
    out = split_pairs(turn_pairs(spark, folder), KEY, "a_text", "b_text")
    return out.select(*KEY, "direction", F.col("source").alias("ref"), F.col("target").alias("hyp"))


SQL_HYP = f"""SELECT conv_id, turn, 'a2b' AS direction, a_text AS ref, b_text AS hyp FROM ({SQL_PAIRS}) UNION ALL SELECT conv_id, turn, 'b2a', b_text, a_text FROM ({SQL_PAIRS})"""


def _sql_13a(col: str) -> str:
    line = f"' ' || replace(replace(replace(replace(replace(replace({col}, '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
    line = rf"regexp_replace({line}, '([\{{-~\[-` -&\(-+:-@/])', ' \1 ', 'g')"
    line = rf"regexp_replace({line}, '([^0-9])([.,])', '\1 \2 ', 'g')"
    line = rf"regexp_replace({line}, '([.,])([^0-9])', ' \1 \2', 'g')"
    line = rf"regexp_replace({line}, '([0-9])(-)', '\1 \2 ', 'g')"
    return sql_tokens(line)


def _sql_overlap(hyp: str, ref: str, orders: int) -> str:
    return f"""
h AS ({SQL_HYP}), k AS (SELECT conv_id, turn, direction, {hyp} AS h, {ref} AS r FROM h), o AS (SELECT unnest(range(1, {orders} + 1)) AS n),
gh AS (SELECT conv_id, turn, direction, n, g, count(*) AS c FROM (SELECT conv_id, turn, direction, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], chr(1)))) AS g FROM k, o) GROUP BY ALL),
gr AS (SELECT conv_id, turn, direction, n, g, count(*) AS c FROM (SELECT conv_id, turn, direction, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1)))) AS g FROM k, o) GROUP BY ALL),
m AS (SELECT conv_id, turn, direction, n, sum(least(gh.c, gr.c)) AS m FROM gh JOIN gr USING (conv_id, turn, direction, n, g) GROUP BY ALL),
s AS (SELECT conv_id, turn, direction, n, coalesce(m, 0) AS m, greatest(len(h) - n + 1, 0) AS h, greatest(len(r) - n + 1, 0) AS r FROM k CROSS JOIN o LEFT JOIN m USING (conv_id, turn, direction, n))"""


SQL_BLEU = f"""WITH {_sql_overlap(_sql_13a('hyp'), _sql_13a('ref'), 4)},
t AS (SELECT direction, n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM s GROUP BY ALL),
z AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY direction ORDER BY n) AS zeros FROM t),
b AS (SELECT direction, max(h) AS h, max(r) AS r, max(m) AS hits, min(h) AS fewest, avg(ln(CASE WHEN m > 0 THEN 100.0 * m / h ELSE 100.0 / (pow(2, zeros) * h) END)) AS p FROM z GROUP BY direction)
SELECT direction, (SELECT count(*) FROM ({SQL_PAIRS}))::BIGINT AS n, round(CASE WHEN hits = 0 OR fewest = 0 THEN 0 ELSE CASE WHEN h < r THEN exp(1 - r / h) ELSE 1 END * exp(p) END, 6)::DOUBLE AS bleu FROM b"""


@query("corpus_bleu", SQL_BLEU)
def corpus_bleu(spark, folder):
    return A.corpus_bleu(hypotheses(spark, folder), [*KEY, "direction"]).withColumn("bleu", F.round("bleu", 6))


_CHARS = lambda c: rf"list_filter(string_split(regexp_replace({c}, '\s+', '', 'g'), ''), lambda x: x <> '')"
SQL_CHRF = f"""WITH {_sql_overlap(_CHARS('hyp'), _CHARS('ref'), 6)},
t AS (SELECT direction, n, sum(m) AS m, sum(h) AS h, sum(r) AS r FROM s GROUP BY ALL),
b AS (SELECT direction, avg(m / h) FILTER (h > 0 AND r > 0) AS p, avg(m / r) FILTER (h > 0 AND r > 0) AS q FROM t GROUP BY direction)
SELECT direction, (SELECT count(*) FROM ({SQL_PAIRS}))::BIGINT AS n, round(coalesce(100 * 5 * p * q / nullif(4 * p + q, 0), 0), 6) AS chrf FROM b"""


@query("corpus_chrf", SQL_CHRF)
def corpus_chrf(spark, folder):
    return A.corpus_chrf(hypotheses(spark, folder), [*KEY, "direction"]).withColumn("chrf", F.round("chrf", 6))


@query("direction_average", f"SELECT round(b.bleu, 5) AS bleu, round(c.chrf, 5) AS chrf FROM (SELECT avg(bleu) AS bleu FROM ({SQL_BLEU})) b, (SELECT avg(chrf) AS chrf FROM ({SQL_CHRF})) c")
def direction_average(spark, folder):
    rows = hypotheses(spark, folder)
    key = [*KEY, "direction"]
    scores = A.corpus_bleu(rows, key).join(A.corpus_chrf(rows, key).drop("n"), "direction")
    out = A.direction_average(scores, ["bleu", "chrf"])
    return out.select(F.round("bleu", 5).alias("bleu"), F.round("chrf", 5).alias("chrf"))


@query("score_divergence")
def score_divergence(spark, folder):
    key = [*KEY, "direction"]
    scores = A.sentence_scores(hypotheses(spark, folder), key)
    out = A.score_divergence(scores, KEY, "direction", 3)
    return out.select("direction", "side", "rank", *KEY, F.round("bleu", 4).alias("bleu"), F.round("chrf", 4).alias("chrf"))
