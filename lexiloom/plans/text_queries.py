"""Cleaning, segmenting and tokenising the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import profile as P
from lexiloom.plans.registry import (
    query, sql_marks, sql_pieces, sql_sentences, sql_tokens, sql_trim, table,
)
from lexiloom.session import cut_lineage
from lexiloom.sources.files import split_lines

STOP = "."
LATIN_SQL = r"\x00-\x7F\x{00C0}-\x{024F}"


def documents(spark, folder, *cols):
    return table(spark, folder, "documents").select(*cols)


def corpus(spark, folder, *keep):
    """Composed, segmented and script-filtered sentences of the documents."""
    docs = documents(spark, folder, "doc_id", *keep, "text").withColumn("text", T.nfc("text"))
    return P.sentences(docs, ["doc_id", *keep], terminators=STOP).where(T.passes_script("text", T.LATIN_RANGES))


def sql_corpus(keep: str) -> str:
    return f"""SELECT * FROM ({sql_sentences(keep)})
WHERE len(regexp_replace(text, '[{LATIN_SQL}]', '', 'g')) <= 0.20 * len(regexp_replace(text, '[ \\t\\n]', '', 'g'))"""


@query("corpus_statistics", f"""
WITH s AS ({sql_corpus('doc_id, lang')}),
t AS (SELECT lang, count(DISTINCT tok) AS types FROM (SELECT lang, unnest({sql_tokens('text')}) AS tok FROM s) GROUP BY lang)
SELECT lang, count(*)::BIGINT AS sentences, sum(len({sql_tokens('text')}))::BIGINT AS tokens, any_value(types)::BIGINT AS types,
  round(avg(len({sql_tokens('text')})), 6) AS mean_length, median(len({sql_tokens('text')}))::DOUBLE AS median_length,
  round(sum(len(regexp_replace(text, '[^\\x{{00C0}}-\\x{{024F}}]', '', 'g'))) / sum(len(regexp_replace(text, '[ \\t\\n]', '', 'g'))) * 100, 6) AS script_pct,
  round(any_value(types) / sum(len({sql_tokens('text')})), 6) AS type_token_ratio
FROM s JOIN t USING (lang) GROUP BY lang""")
def corpus_statistics(spark, folder):
    out = P.corpus_stats(corpus(spark, folder, "lang"), "lang", ranges=T.LATIN_RANGES)
    return out.select(
        "lang", "sentences", "tokens", "types", F.round("mean_length", 6).alias("mean_length"), "median_length",
        F.round("script_pct", 6).alias("script_pct"), F.round("type_token_ratio", 6).alias("type_token_ratio"),
    )


@query("line_scan", f"""
SELECT doc_id, line_no, nfc_normalize(line) AS line FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
  FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM documents))
WHERE {sql_trim('line')} <> ''""")
def line_scan(spark, folder):
    return split_lines(documents(spark, folder, "doc_id", "text"), ["doc_id"])


HTML = T.MarkupRules(
    discard=("<!--",),
    steps=(
        (r"(?s)<script.*?</script>", ""),
        (r"(?s)<style.*?</style>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"(?s)<nav>.*?</nav>", ""),
        (r"<[^>]*>", " "),
    ),
)


@query("markup_cleaner", f"""
SELECT page_id, CASE WHEN starts_with({sql_trim('html')}, '<!--') THEN '' ELSE {sql_trim("nfc_normalize(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + sql_trim('html') + r", '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<nav>.*?</nav>', '', 'g'), '<[^>]*>', ' ', 'g'))")} END AS text
FROM pages""")
def markup_cleaner(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.clean_markup("html", HTML).alias("text"))


# The tables hold composed text only, so accents are first spelled apart.
APART = (("é", "é"), ("è", "è"), ("ü", "ü"), ("ó", "ó"), ("ä", "ä"), ("ñ", "ñ"))


def _apart_sql() -> str:
    out = "text"
    for a, b in APART:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query("nfc_normalise", f"SELECT doc_id, nfc_normalize({_apart_sql()}) AS text, len(nfc_normalize({_apart_sql()}))::BIGINT AS chars FROM documents")
def nfc_normalise(spark, folder):
    apart = F.col("text")
    for a, b in APART:
        apart = F.replace(apart, F.lit(a), F.lit(b))
    return documents(spark, folder, "doc_id", "text").select("doc_id", T.nfc(apart).alias("text")).withColumn("chars", F.length("text").cast("long"))


@query("sentence_segments", sql_sentences("doc_id"))
def sentence_segments(spark, folder):
    return P.sentences(documents(spark, folder, "doc_id", "text"), ["doc_id"], terminators=STOP)


@query("sentence_split", sql_sentences("doc_id", min_tokens=0))
def sentence_split(spark, folder):
    return P.sentences(documents(spark, folder, "doc_id", "text"), ["doc_id"], terminators=STOP, min_tokens=0)


@query("quote_aware_split", sql_sentences("conv_id, turn", "conversations", ends=".?!", min_tokens=0))
def quote_aware_split(spark, folder):
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(T.split_quoted("text", ".?!")).alias("sent_no", "text")).withColumn(
        "sent_no", F.col("sent_no").cast("long")
    )


@query("script_filter", f"""
WITH c AS (SELECT doc_id, len(regexp_replace(text, '[ \\t\\n]', '', 'g')) AS n,
  len(regexp_replace(text, '[\\x00-\\x7F\\x{{0900}}-\\x{{097F}}]', '', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN round(f / n, 6) END AS ratio, coalesce(f <= 0.05 * n AND n > 0, false) AS kept FROM c""")
def script_filter(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select(
        "doc_id", F.round(T.script_ratio("text"), 6).alias("ratio"),
        T.passes_script("text", max_foreign=0.05).alias("kept"),
    )


def _sql_transcript(col: str) -> str:
    ref = r"(?:[0-9]+[ ]+)?(?:[A-Za-z\x{00C0}-\x{024F}]+[ ]+){0,3}[0-9]+[:][0-9]+(?:[;,][ ]*(?:[0-9]+[:][0-9]+|[0-9]+))*"
    return rf"regexp_replace(regexp_replace({col}, '{ref}', ' ', 'g'), '[^A-Za-z\x{{00C0}}-\x{{024F}}0-9.\s]', ' ', 'g')"


@query("transcript_cleaner", rf"""
WITH k AS (SELECT doc_id, {_sql_transcript('text')} AS t FROM documents)
SELECT doc_id, {sql_trim(r"regexp_replace(regexp_replace(t, '\S*[0-9]\S*', ' ', 'g'), ' {2,}', ' ', 'g')")} AS text,
  len(regexp_extract_all(t, '\S*[0-9]\S*'))::BIGINT AS dropped FROM k""")
def transcript_cleaner(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", T.clean_transcript("text", T.LATIN_TRANSCRIPT).alias("c")).select("doc_id", "c.text", "c.dropped")


@query("numeral_strip", rf"""
SELECT doc_id, {sql_trim(r"regexp_replace(regexp_replace(text, '\S*[0-9]\S*', ' ', 'g'), '\s+', ' ', 'g')")} AS text,
  len(regexp_extract_all(text, '\S*[0-9]\S*'))::BIGINT AS removed FROM documents""")
def numeral_strip(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", T.strip_numerals("text").alias("c")).select("doc_id", "c.text", "c.removed")


@query("whitespace_tokens", f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS words, array_to_string({sql_tokens('text')}, '|') AS tokens FROM documents")
def whitespace_tokens(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", T.word_count("text").cast("long").alias("words"), F.array_join(T.tokens("text"), "|").alias("tokens"))


@query("punctuation_tokens", f"SELECT doc_id, len({sql_marks('text')})::BIGINT AS words, array_to_string({sql_marks('text')}, ' ') AS tokens FROM documents")
def punctuation_tokens(spark, folder):
    docs = documents(spark, folder, "doc_id", "text").withColumn("t", T.tokenize_punct("text"))
    return docs.select("doc_id", F.size("t").cast("long").alias("words"), F.array_join("t", " ").alias("tokens"))


EDGE = ".,;:!?()#$%&*"


@query("boundary_strip", f"""
SELECT tok AS token, trim(tok, '{EDGE}') AS stripped, count(*)::BIGINT AS n
FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM documents) GROUP BY 1, 2""")
def boundary_strip(spark, folder):
    words = P.vocabulary(documents(spark, folder, "text"), T.tokens("text"))
    return words.select("token", T.strip_chars("token", EDGE).alias("stripped"), "n")


MISSING = list("éèêçäöüßñóíá$#%&*")
POLICY = {"é": "e", "è": "e", "ê": "e", "ç": "c", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ñ": "n", "ó": "o", "&": "and"}


def _sql_adapt() -> str:
    out = "text"
    for ch in MISSING:
        out = f"replace({out}, '{ch}', '{POLICY.get(ch, '')}')"
    return rf"{sql_trim(rf'''regexp_replace({out}, '\s+', ' ', 'g')''')}"


@query("inventory_adaptation", f"""
WITH a AS (SELECT doc_id, text AS raw, {_sql_adapt()} AS text FROM documents)
SELECT doc_id, text, raw <> text AS changed, text = '' AS emptied FROM a""")
def inventory_adaptation(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    return docs.select("doc_id", F.col("text").alias("raw"), T.adapt_text("text", MISSING, POLICY).alias("text")).select(
        "doc_id", "text", (F.col("raw") != F.col("text")).alias("changed"), (F.col("text") == "").alias("emptied")
    )


@query("validity_reasons", f"""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'source file missing' WHEN text = '' THEN 'empty transcript'
  WHEN len({sql_tokens('text')}) < 20 THEN 'under 20 words after cleaning' ELSE 'kept' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def validity_reasons(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("present"))
    reason = T.skip_reason("text", F.col("present").isNull(), 20)
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(reason, F.lit("kept")).alias("reason"))


def routed(spark, folder):
    from lexiloom.operators.segments import route_lines

    lines = split_lines(documents(spark, folder, "doc_id", "text"), ["doc_id"]).withColumnRenamed("line", "text")
    return cut_lineage(route_lines(lines, "doc_id", T.LATIN_TRANSCRIPT), "transcripts")


SQL_ROUTED = rf"""
SELECT doc_id, line_no, raw, kind, CASE WHEN kind = 'body' THEN {sql_trim(r"regexp_replace(regexp_replace(t, '\S*[0-9]\S*', ' ', 'g'), ' {2,}', ' ', 'g')")} ELSE '' END AS text
FROM (SELECT doc_id, line_no, line AS raw, {_sql_transcript('line')} AS t,
  CASE WHEN regexp_matches({sql_trim('line')}, '^[A-Za-z\x{{00C0}}-\x{{024F}}0-9]+(?:\s+[A-Za-z\x{{00C0}}-\x{{024F}}0-9]+){{0,2}}\.\s*$') THEN 'book'
    WHEN regexp_matches({sql_trim('line')}, '^[0-9]+\.\s*$') THEN 'chapter' ELSE 'body' END AS kind
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
    FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents)) WHERE {sql_trim('line')} <> '')"""


@query("header_routing", f"""
WITH r AS ({SQL_ROUTED})
SELECT doc_id, count(*) FILTER (kind = 'book') AS book_lines, count(*) FILTER (kind = 'body') AS body_lines,
  {sql_trim("rtrim(arg_min(" + sql_trim('raw') + ", line_no) FILTER (kind = 'book'), '. ')")} AS intro FROM r GROUP BY doc_id""")
def header_routing(spark, folder):
    from lexiloom.operators.segments import book_intros

    lines = routed(spark, folder)
    counts = lines.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "book").alias("book_lines"), F.count_if(F.col("kind") == "body").alias("body_lines")
    )
    return counts.join(book_intros(lines, "doc_id", T.LATIN_TRANSCRIPT), "doc_id", "left")


@query("chapter_sentences", f"""
WITH r AS ({SQL_ROUTED}),
c AS (SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text FROM r WHERE text <> '' GROUP BY doc_id),
p AS (SELECT doc_id, {sql_pieces("regexp_replace(text, ' {2,}', ' ', 'g')")} AS p FROM c)
SELECT doc_id, unnest(p) AS text, unnest(range(len(p))) + 1 AS num FROM p""")
def chapter_sentences(spark, folder):
    from lexiloom.operators.segments import chapter_sentences as split

    return split(routed(spark, folder), "doc_id", STOP)
