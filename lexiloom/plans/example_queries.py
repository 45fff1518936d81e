"""Subword vocabularies and training examples from the text tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import profile as P
from lexiloom.operators import subword as U
from lexiloom.operators.splits import split_pairs
from lexiloom.plans.profile_queries import SQL_CHARS, SQL_TOKENS
from lexiloom.plans.registry import (
    SQL_PAIRS, query, sql_sentences, sql_tokens, sql_uniform, table, turn_pairs,
)
from lexiloom.plans.text_queries import STOP, documents


def word_counts(spark, folder):
    return P.vocabulary(documents(spark, folder, "text"), T.tokens("text"))


SQL_COUNTS = f"SELECT token, count(*)::BIGINT AS n FROM ({SQL_TOKENS}) GROUP BY token"


@query("subword_seeds", f"""
WITH v AS (SELECT '▁' || token AS token, n FROM ({SQL_COUNTS})),
l AS (SELECT token, n, unnest(range(1, len(token) + 1)) AS i FROM v),
p AS (SELECT token, n, i, unnest(range(2, least(16, len(token) - i + 1) + 1)) AS k FROM l)
SELECT substr(token, i, k) AS piece, sum(n)::BIGINT AS n, (sum(n) * any_value(k))::BIGINT AS score FROM p GROUP BY 1 HAVING sum(n) >= 2""")
def subword_seeds(spark, folder):
    return U.seed_substrings(U.marked_words(word_counts(spark, folder)))


@query("kept_characters", f"""
WITH c AS (SELECT ch, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split('▁' || token, '')) AS ch, n FROM ({SQL_COUNTS})) GROUP BY ch),
r AS (SELECT ch, n, coalesce(sum(n) OVER (ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
SELECT ch, n FROM r WHERE b < 0.9995::DOUBLE * (SELECT sum(n) FROM c)""")
def kept_characters(spark, folder):
    return U.kept_characters(U.marked_words(word_counts(spark, folder)))


def trained(spark, folder):
    return U.train_unigram(word_counts(spark, folder), 2000, rounds=2, shrink=0.5)


@query("unigram_vocabulary")
def unigram_vocabulary(spark, folder):
    return trained(spark, folder)[0]


@query("subword_encoding")
def subword_encoding(spark, folder):
    """Every document as pieces of a vocabulary trained on all of them, with its fertility."""
    vocab, _ = trained(spark, folder)
    out = U.encode(documents(spark, folder, "doc_id", "text"), vocab)
    return out.select(
        "doc_id", T.word_count("text").alias("words"), F.size("pieces").alias("n_pieces"),
        F.array_join("pieces", " ").alias("pieces"),
    )


@query("tokeniser_report", rf"""
WITH v AS (SELECT lang, token, count(*) AS n FROM ({SQL_TOKENS}) GROUP BY ALL),
w AS (SELECT lang, n, len(token) AS p, len(regexp_replace(token, '[A-Za-z.,]', '', 'g')) AS u FROM v)
SELECT lang, sum(n)::BIGINT AS words, sum(n * p)::BIGINT AS pieces, sum(n * u)::BIGINT AS unks, round(sum(n * p) / sum(n), 6) AS fertility, round(sum(n * u) / sum(n * p), 6) AS unk_rate
FROM w GROUP BY lang""")
def tokeniser_report(spark, folder):
    words = P.vocabulary(documents(spark, folder, "lang", "text"), T.tokens("text"), ["lang"])
    pieces = words.select(
        "lang", "n", F.length("token").alias("n_pieces"), F.length(F.regexp_replace("token", "[A-Za-z.,]", "")).alias("n_unk")
    )
    out = U.tokeniser_report(pieces, ["lang"])
    return out.withColumn("fertility", F.round("fertility", 6)).withColumn("unk_rate", F.round("unk_rate", 6))


@query("vocabulary_size_choice", f"""
WITH v AS (SELECT token, n FROM ({SQL_COUNTS})), k AS (SELECT unnest([1, 2, 3]) AS k),
p AS (SELECT k, n, unnest(list_transform(range(0, len(token), k), lambda i: substr(token, i + 1, k))) AS piece FROM v CROSS JOIN k),
r AS (SELECT k, count(DISTINCT piece)::BIGINT AS vocab_size, round(sum(n) / (SELECT sum(n) FROM v), 6) AS fertility FROM p GROUP BY k),
s AS (SELECT *, fertility BETWEEN 2.5 AND 4.0 AS ok FROM r), c AS (SELECT count(*) FILTER (ok) AS k FROM s)
SELECT vocab_size, fertility, CASE WHEN c.k >= 2 THEN 'several_in_range' WHEN c.k = 1 THEN 'one_in_range' ELSE 'nearest_middle' END AS reason FROM s, c
ORDER BY CASE WHEN c.k >= 2 THEN 0 WHEN c.k = 1 THEN (NOT ok)::INT ELSE abs(fertility - 3.25) END, vocab_size LIMIT 1""")
def vocabulary_size_choice(spark, folder):
    """Candidate vocabularies cut words into pieces of one, two or three characters."""
    words = word_counts(spark, folder)
    chop = lambda k: F.regexp_extract_all("token", F.lit(f"(?s).{{1,{k}}}"), F.lit(0))
    sizes = words.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), chop(k).alias("p")) for k in (1, 2, 3)])).alias("x"))
    pieces = sizes.select("n", "x.k", F.explode("x.p").alias("piece"))
    total = words.agg(F.sum("n")).scalar()
    report = pieces.groupBy("k").agg(
        F.countDistinct("piece").alias("vocab_size"), F.round(F.sum("n") / total, 6).alias("fertility")
    )
    return U.choose_vocab(report)


def _side_vocab(spark, folder, role):
    """Characters of one side's turns as pieces: (piece_id, piece), four native specials first."""
    chars = P.charset(table(spark, folder, "conversations").where(F.col("role") == role).select("text"))
    # one row per character of Unicode at most
    ranked = chars.select("ch", (F.row_number().over(Window.orderBy(F.desc("n"), "ch")) + 3).alias("piece_id"))
    return ranked.select("piece_id", F.col("ch").alias("piece")).unionByName(
        spark.range(4).select(F.col("id").cast("int").alias("piece_id"), F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")).alias("piece"))
    )


def _sql_side(role: str) -> str:
    return f"""SELECT ch, row_number() OVER (ORDER BY n DESC, ch) + 3 AS piece_id FROM (
  SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '\\s+', '', 'g'), '')) AS ch FROM conversations WHERE role = '{role}') WHERE ch <> '' GROUP BY ch)"""


@query("joint_vocabulary", f"""
WITH a AS ({_sql_side('user')}), b AS ({_sql_side('assistant')})
SELECT joint_id, 'special' AS side, NULL::INT AS native_id, piece FROM (VALUES (0, '<pad>'), (1, '<unk>'), (2, '<s>'), (3, '</s>'), (4, '<2b>'), (5, '<2a>')) s(joint_id, piece)
UNION ALL SELECT piece_id - 4 + 6, 'a', piece_id, ch FROM a
UNION ALL SELECT piece_id - 4 + 6 + (SELECT count(*) FROM a), 'b', piece_id, ch FROM b""")
def joint_vocabulary(spark, folder):
    return U.joint_vocab(_side_vocab(spark, folder, "user"), _side_vocab(spark, folder, "assistant"))


@query("id_decoding", r"""
WITH d AS (SELECT doc_id, text AS t FROM documents), x AS (SELECT doc_id, ltrim(regexp_replace(t, '[^\x00-\x7F]', '', 'g'), ' ') AS text,
  len(regexp_replace(t, '[\x00-\x7F]', '', 'g'))::BIGINT AS dropped, regexp_replace(t, '[^\x00-\x7F]', '', 'g') AS kept FROM d)
SELECT doc_id, CASE WHEN kept = '' THEN '(empty output)' ELSE text END AS text, dropped FROM x""")
def id_decoding(spark, folder):
    """Documents as code points; side a holds the ASCII ones, so the others are dropped and counted."""
    docs = documents(spark, folder, "doc_id", "text")
    first = 6  # ids below are special
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    ids = docs.select("doc_id", F.lit("a").alias("side"), F.transform(chars, lambda c: F.ascii(c) + first).alias("ids"))
    seen = docs.select(F.explode(chars).alias("ch")).distinct()
    joint = seen.select(
        (F.ascii("ch") + first).alias("joint_id"), F.when(F.ascii("ch") < 128, "a").otherwise("b").alias("side"),
        F.when(F.col("ch") == " ", U.SPACE_MARK).otherwise(F.col("ch")).alias("piece"),
    )
    return U.decode_ids(ids, joint, ["doc_id"])


VOCAB, MAX_LEN, BUCKET, MASK = 1000, 128, 16, 4


def _token_id(t):
    return (F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("long") % (VOCAB - 5) + 5).cast("int")


def packed(spark, folder):
    sentences = P.sentences(documents(spark, folder, "doc_id", "text"), ["doc_id"], terminators=STOP)
    ids = sentences.select("doc_id", "sent_no", F.transform(T.tokens("text"), _token_id).alias("ids"))
    return U.pack(ids, max_len=MAX_LEN, bucket=BUCKET)


_IDS = f"list_transform({sql_tokens('text')}, lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT % {VOCAB - 5} + 5)"
SQL_PACKED = f"""
WITH w AS (SELECT doc_id, sent_no, list_concat(list_concat([2], {_IDS}), [3])[1:{MAX_LEN}] AS w FROM ({sql_sentences('doc_id')})),
p AS (SELECT doc_id, sent_no, list_concat(w, list_transform(range(0, (least(ceil(len(w) / {BUCKET}) * {BUCKET}, {MAX_LEN}) - len(w))::BIGINT), lambda i: 0)) AS ids FROM w)"""


@query("packed_sequences", f"""{SQL_PACKED}
SELECT doc_id, sent_no, array_to_string(ids, ' ') AS input, array_to_string(list_transform(ids, lambda i: (i <> 0)::INT), ' ') AS attention FROM p""")
def packed_sequences(spark, folder):
    return packed(spark, folder).select(
        "doc_id", "sent_no", F.array_join(F.transform("input", lambda i: i.cast("string")), " ").alias("input"),
        F.array_join(F.transform("attention", lambda i: i.cast("string")), " ").alias("attention"),
    )


@query("next_token_examples", f"""{SQL_PACKED}
SELECT doc_id, sent_no, array_to_string(ids[1:len(ids) - 1], ' ') AS source, array_to_string(list_transform(ids[2:], lambda i: CASE WHEN i = 0 THEN -100 ELSE i END), ' ') AS labels FROM p""")
def next_token_examples(spark, folder):
    out = U.shift_examples(packed(spark, folder))
    return out.select(
        "doc_id", "sent_no", F.array_join(F.transform("source", lambda i: i.cast("string")), " ").alias("source"),
        F.array_join(F.transform("labels", lambda i: i.cast("string")), " ").alias("labels"),
    )


def _sql_draw(what: str) -> str:
    return sql_uniform("doc_id || ':' || sent_no || ':' || (i - 1)", f"42:0:{what}")


@query("masked_examples", f"""{SQL_PACKED},
e AS (SELECT doc_id, sent_no, unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS i FROM p),
m AS (SELECT *, id NOT IN (0, 2, 3) AND {_sql_draw('pick')} < 0.15 AS hit FROM e)
SELECT doc_id, sent_no,
  string_agg(CASE WHEN NOT hit THEN id WHEN {_sql_draw('kind')} < 0.8 THEN {MASK} WHEN {_sql_draw('kind')} < 0.8::DOUBLE + 0.1::DOUBLE THEN floor({_sql_draw('id')} * {VOCAB - 4})::BIGINT + 4 ELSE id END::VARCHAR, ' ' ORDER BY i) AS masked,
  string_agg((CASE WHEN hit THEN id ELSE -100 END)::VARCHAR, ' ' ORDER BY i) AS labels FROM m GROUP BY ALL""")
def masked_examples(spark, folder):
    out = U.mask_examples(packed(spark, folder), ["doc_id", "sent_no"], VOCAB, MASK)
    return out.select(
        "doc_id", "sent_no", F.array_join(F.transform("masked", lambda i: i.cast("string")), " ").alias("masked"),
        F.array_join(F.transform("labels", lambda i: i.cast("string")), " ").alias("labels"),
    )


def _sql_ids(col: str, offset: int) -> str:
    return f"list_transform({sql_tokens(col)}, lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT % {VOCAB - 5} + 5 - 4 + {offset})"


SIZE_A = VOCAB
_A, _B = 6, 6 + SIZE_A - 4


@query("bilingual_examples", f"""
WITH p AS (SELECT conv_id, turn, CASE WHEN {sql_uniform("conv_id || ':' || turn", 42)} < 1 - 0.9 THEN 'test' ELSE 'train' END AS split, a_text, b_text FROM ({SQL_PAIRS}))
SELECT conv_id, turn, split, 'a2b' AS direction, array_to_string(list_concat([4], {_sql_ids('a_text', _A)})[1:{MAX_LEN}], ' ') AS src,
  array_to_string(list_concat(list_concat([2], {_sql_ids('b_text', _B)}), [3])[1:{MAX_LEN}], ' ') AS tgt FROM p
UNION ALL SELECT conv_id, turn, split, 'b2a', array_to_string(list_concat([5], {_sql_ids('b_text', _B)})[1:{MAX_LEN}], ' '),
  array_to_string(list_concat(list_concat([2], {_sql_ids('a_text', _A)}), [3])[1:{MAX_LEN}], ' ') FROM p""")
def bilingual_examples(spark, folder):
    doubled = split_pairs(turn_pairs(spark, folder), ["conv_id", "turn"], "a_text", "b_text", 0.9, 42)
    ids = lambda c: F.transform(T.tokens(c), _token_id)
    native = doubled.withColumn("source_ids", ids("source")).withColumn("target_ids", ids("target"))
    out = U.bilingual_examples(native, SIZE_A, MAX_LEN)
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ").alias(c)
    return out.select("conv_id", "turn", "split", "direction", text("src"), text("tgt"))
