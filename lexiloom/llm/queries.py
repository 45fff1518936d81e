"""Registered queries of the training-data operators over the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import chat, decontaminate, filter_audit, minhash, mixing, secret_scan, sharding, spotsigs, substring_dedup, token_files, toxicity, warc, whitening
from lexiloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, folder, "pages"))


@query
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = turns.unionByName(trap).select("conv_id", "turn", "role", chat.text_part(F.coalesce("text", F.lit(""))).alias("parts"))
    return chat.conversation_digests(chat.format_conversations(rows))


@query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, folder, "documents"), width=2, percent=80)


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, folder, "documents"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")).drop("key")


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_lexicon(docs, read_table(spark, folder, "labels")))


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, folder, "documents"), shards=16)


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.scan_secrets(read_table(spark, folder, "documents")))


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(read_table(spark, folder, "documents"), word_tokenizer(), end_id=1)


@query
def op10_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return spotsigs.edited_fingerprints(docs, spotsigs.common_words(docs))


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


@query
def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, folder, "documents"))


# ---- SQL that the queries must agree with

_CONTROL = ("<|", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _sql_escaped(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in _CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL["op2_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(26 + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS attachment_tokens
FROM t GROUP BY conv_id"""


SQL_ROUNDS = 20  # raking of the given tables ends before


def _sql_mix() -> str:
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in mixing.TOPICS)
    bare = r"regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
    keys, even, most = ", ".join(mixing.MARGINALS), mixing.TOWARDS_EVEN, mixing.KEEP ** (-1 / 3)
    same = lambda m, a, b: f"{a}.{m} IS NOT DISTINCT FROM {b}.{m}"
    steps = [
        f"d AS (SELECT doc_id, source, lang, CASE {topic} ELSE 'prose' END AS topic, "
        rf"CASE WHEN {bare} = '' THEN 0 ELSE len(regexp_split_to_array({bare}, '[\x20\x09-\x0D]+')) END AS n_tokens FROM documents)",
        f"c AS MATERIALIZED (SELECT {keys}, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in mixing.MARGINALS:
        steps.append(
            f"a_{m} AS (SELECT {m}, now, {1 - even} * now + {even} / count(*) OVER () AS aim FROM (SELECT {m}, sum(tokens) / (SELECT sum(tokens) FROM c) AS now FROM c GROUP BY {m})), "
            f"t_{m} AS MATERIALIZED (SELECT {m}, now + more - less * (CASE WHEN sum(less) OVER () > 0 THEN sum(more) OVER () / sum(less) OVER () ELSE 0 END) AS share "
            f"FROM (SELECT {m}, now, greatest(least(aim, now * {most}) - now, 0) AS more, greatest(now - aim, 0) AS less FROM a_{m}))")
    steps.append(f"w0 AS MATERIALIZED (SELECT {keys}, tokens, tokens AS weight FROM c)")
    at, ends = 0, []
    for nth in range(1, SQL_ROUNDS + 1):
        moved = []
        for m in mixing.MARGINALS:
            # materialised, or each step would be expanded into the next one twice
            steps.append(
                f"n{at} AS MATERIALIZED (SELECT t.{m}, share, now FROM (SELECT {m}, sum(weight) AS now FROM w{at} GROUP BY {m}) s JOIN t_{m} t ON {same(m, 's', 't')}), "
                f"w{at + 1} AS MATERIALIZED (SELECT w.* REPLACE (weight * share / now AS weight) FROM w{at} w JOIN n{at} n ON {same(m, 'w', 'n')})")
            moved.append(f"(SELECT max(abs(now / share - 1)) FROM n{at})")
            at += 1
        ends.append((nth, at, f"SELECT {nth} AS nth, greatest({', '.join(moved)}) AS moved"))
    # the round after which raking stops
    steps.append(
        f"e AS MATERIALIZED (SELECT coalesce(min(nth), {SQL_ROUNDS}) AS nth FROM ({' UNION ALL '.join(q for _, _, q in ends)}) WHERE nth >= {mixing.ROUNDS} AND moved <= {mixing.TOLERANCE})")
    steps.append("w AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM w{i} WHERE (SELECT nth FROM e) = {nth}" for nth, i, _ in ends) + ")")
    unit = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{mixing.SEED}'), 1, 8))::BIGINT / 4294967296.0)"
    on = " AND ".join(same(m, "d", "w") for m in mixing.MARGINALS)
    picked = ", ".join(f"d.{m}" for m in mixing.MARGINALS)
    steps.append(
        f"p AS MATERIALIZED (SELECT doc_id, {picked}, n_tokens::BIGINT AS n_tokens, coalesce(round(weight / tokens / (SELECT max(weight / tokens) FROM w), 6), 1.0) AS probability "
        f"FROM d LEFT JOIN w ON {on})")
    steps.append(f"u AS MATERIALIZED (SELECT *, {unit} < probability AS drawn FROM p)")
    joins, shares = "", ""
    for m in mixing.MARGINALS:
        steps.append(f"s_{m} AS (SELECT {m}, round(coalesce(sum(n_tokens) FILTER (drawn), 0) / (SELECT sum(n_tokens) FROM u WHERE drawn), 6) AS part FROM u WHERE n_tokens > 0 GROUP BY {m})")
        joins += f" LEFT JOIN t_{m} ON {same(m, 'u', f't_{m}')} LEFT JOIN s_{m} ON {same(m, 'u', f's_{m}')}"
        # a cell without tokens has no shares
        shares += f", CASE WHEN has THEN round(t_{m}.share, 6) END AS wanted_{m}, CASE WHEN has THEN s_{m}.part END AS drawn_{m}"
    has = f"SELECT u.*, EXISTS (SELECT 1 FROM c WHERE {' AND '.join(same(m, 'u', 'c') for m in mixing.MARGINALS)}) AS has FROM u"
    return f"WITH {', '.join(steps)} SELECT doc_id, {', '.join(f'u.{m}' for m in mixing.MARGINALS)}, n_tokens, probability, drawn{shares} FROM ({has}) u{joins}"


SQL["op4_mixing"] = _sql_mix()

SQL["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    CAST(len(w) < 200 AS INT) + CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) * 2 + CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS INT) * 4
      + CAST(regexp_matches(t, '[#$%&*|]') AS INT) * 8 + CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INT) * 16 AS fails
  FROM d LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM l p, l q, l r, l s, l t
  WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1]) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (fails & (coalesce(earlier, 0)::INT | own) = 0) AS kept,
    sum(n) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0)::INT = 0) AS removed,
    sum(n) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0)::INT > 0) AS redundant,
    sum(n) FILTER (fails = own) AS unique_fails,
    sum(g) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0)::INT = 0) AS good_lost,
    sum(b) FILTER (fails & own > 0 AND fails & coalesce(earlier, 0)::INT = 0) AS toxic_lost
  FROM c, k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM m"""
