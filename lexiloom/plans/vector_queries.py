"""Vectors, labels, classification and the counting language model."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators import ngrams as L
from lexiloom.operators import profile as P
from lexiloom.operators import vectors as E
from lexiloom.operators.neighbours import InvertedFile
from lexiloom.operators.splits import split_rows
from lexiloom.plans.registry import query, sql_sentences, sql_tokens, sql_uniform, table
from lexiloom.plans.text_queries import STOP, documents
from lexiloom.session import cut_lineage


def embeddings(spark, folder):
    return table(spark, folder, "embeddings").withColumnRenamed("embedding", "vec")


def centroids(spark, folder):
    return E.mean_vectors(embeddings(spark, folder), ["label"])


SQL_DIMS = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings"
SQL_CENTROIDS = f"SELECT label, list(m ORDER BY dim) AS vec FROM (SELECT label, dim, avg(x) AS m FROM ({SQL_DIMS}) GROUP BY label, dim) GROUP BY label"


@query("pooled_vectors", f"SELECT label, dim, round(avg(x), 6) AS mean FROM ({SQL_DIMS}) GROUP BY label, dim")
def pooled_vectors(spark, folder):
    out = centroids(spark, folder).select("label", F.posexplode("mean").alias("dim", "mean"))
    return out.select("label", (F.col("dim") + 1).cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("nearest_neighbours", f"""
WITH c AS ({SQL_CENTROIDS}),
s AS (SELECT c.label AS query, vec_id AS word, list_cosine_similarity(c.vec, embedding::DOUBLE[]) AS cos FROM c CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cos DESC, word) AS rank FROM s)
SELECT query, rank, word, round(cos, 6) AS cosine FROM r WHERE rank <= 10""")
def nearest_neighbours(spark, folder):
    """The ten vectors nearest to each label's mean vector."""
    queries = centroids(spark, folder).select(F.col("label").alias("query"), F.col("mean").alias("vec"))
    out = E.nearest(queries, embeddings(spark, folder), 10, vector_id="vec_id")
    return out.withColumn("cosine", F.round("cosine", 6))


SQL_FIFTIETH = """
WITH s AS (SELECT a.vec_id AS query, b.vec_id AS word, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cos, 12) DESC, word) AS rank FROM s)
SELECT query, rank, word, round(cos, 6) AS cosine FROM r WHERE rank <= 5"""


@query("indexed_neighbours", SQL_FIFTIETH)
def indexed_neighbours(spark, folder):
    """The five vectors nearest to every fiftieth one, by the inverted file, visiting all cells that may matter."""
    vectors = embeddings(spark, folder)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "vec")
    out = InvertedFile(vectors, "vec_id").nearest(queries, 5, certain=True)
    return out.withColumn("cosine", F.round("cosine", 6))


@query("pair_cosine", """
SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_cosine(spark, folder):
    vecs = embeddings(spark, folder)
    following = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("vec").alias("vec2"))
    return vecs.join(following, "vec_id").select("vec_id", "other", F.round(V.cosine("vec", "vec2"), 6).alias("cosine"))


@query("similarity_evaluation", """
WITH p AS (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c, 1.0 / (1 + abs(a.label - b.label)) AS s
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
r AS (SELECT c, s, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS rc, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rs FROM p)
SELECT count(*)::BIGINT AS pairs, count(*)::BIGINT AS found, round(corr(rs, rc), 6) AS spearman, round(corr(s, c), 6) AS pearson FROM r""")
def similarity_evaluation(spark, folder):
    vecs = embeddings(spark, folder)
    words = vecs.select(F.col("vec_id").cast("string").alias("word"), "vec")
    following = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("label").alias("label2"))
    pairs = vecs.join(following, "vec_id").select(
        F.col("vec_id").cast("string").alias("word1"), F.col("other").cast("string").alias("word2"),
        (1.0 / (1 + F.abs(F.col("label") - F.col("label2")))).alias("score"),
    )
    out = E.eval_similarity(pairs, words)
    return out.select("pairs", "found", F.round("spearman", 6).alias("spearman"), F.round("pearson", 6).alias("pearson"))


@query("analogy_evaluation", f"""
WITH v AS (SELECT label, vec FROM ({SQL_CENTROIDS})),
q AS (SELECT a.label AS a, b.label AS b, c.label AS c, d.label AS d, list_transform(range(1, len(a.vec) + 1), lambda i: b.vec[i] - a.vec[i] + c.vec[i]) AS t
  FROM v a JOIN v b ON b.label = a.label + 1 JOIN v c ON c.label = a.label + 2 JOIN v d ON d.label = a.label + 3),
s AS (SELECT a, b, c, d, label AS w, row_number() OVER (PARTITION BY a ORDER BY list_cosine_similarity(t, vec) DESC, label) AS r FROM q CROSS JOIN v WHERE label NOT IN (a, b, c))
SELECT a, b, c, d, w AS answer, w = d AS correct FROM s WHERE r = 1""")
def analogy_evaluation(spark, folder):
    means = cut_lineage(centroids(spark, folder).select(F.col("label").alias("word"), F.col("mean").alias("vec")), "centroids")
    quads = means.select(
        F.col("word").alias("a"), (F.col("word") + 1).alias("b"), (F.col("word") + 2).alias("c"), (F.col("word") + 3).alias("d")
    ).join(means.select(F.col("word").alias("d")), "d", "left_semi")
    return E.eval_analogy(quads, means)


@query("word_vectors")
def word_vectors(spark, folder):
    out = E.train_vectors(documents(spark, folder, "text"), dim=32, iterations=1)
    return out.select("word", F.round(V.norm("vec"), 4).alias("norm"))


@query("composed_vectors")
def composed_vectors(spark, folder):
    """Vectors for the conversations' words, from character n-grams of the documents' words."""
    docs = documents(spark, folder, "text")
    vectors = cut_lineage(E.train_vectors(docs, dim=32, iterations=1), "vectors")
    asked = P.vocabulary(table(spark, folder, "conversations"), T.tokens("text")).select(F.col("token").alias("word"))
    out = E.compose_vectors(asked, vectors, P.vocabulary(docs, T.tokens("text")))
    return out.select("word", F.round(V.norm("vec"), 4).alias("norm"))


@query("document_vectors", f"""
WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS tok FROM documents),
v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings),
w AS (SELECT DISTINCT tok FROM t), n AS (SELECT count(*) AS n FROM embeddings),
k AS (SELECT tok, ('0x' || substr(md5(tok), 1, 6))::BIGINT % (SELECT n FROM n) AS vec_id FROM w)
SELECT doc_id, round(avg(x) FILTER (dim = 1), 6) AS first, round(avg(x) FILTER (dim = 64), 6) AS last FROM t JOIN k USING (tok) JOIN v USING (vec_id) WHERE dim IN (1, 64) GROUP BY doc_id""")
def document_vectors(spark, folder):
    """Documents as means of their known words' vectors; a word's hash picks its vector, if there is one."""
    docs = documents(spark, folder, "doc_id", "text")
    key = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 6), 16, 10).cast("long") % F.lit(embeddings(spark, folder).count())
    words = P.vocabulary(docs, T.tokens("text")).select(F.col("token").alias("word"), key.alias("name"))
    out = E.pool(docs, embeddings(spark, folder).select(F.col("vec_id").alias("name"), "vec"), "doc_id", shared=words)
    return out.select("doc_id", F.round(F.get("mean", F.lit(0)), 6).alias("first"), F.round(F.get("mean", F.lit(63)), 6).alias("last"))


# ---- labels and classification

@query("group_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS label FROM documents")
def group_labels(spark, folder):
    return E.labels_by_group(documents(spark, folder, "doc_id", "lang"), "lang", {"en": 0, "fr": 1, "de": 2}).select("doc_id", "label")


@query("position_labels", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents),
c AS (SELECT *, floor(n * 0.60::DOUBLE) AS a, floor(n * 0.35::DOUBLE) AS b FROM r)
SELECT doc_id, CASE WHEN i <= a THEN 0 WHEN i <= a + b THEN 1 ELSE 2 END AS label FROM c""")
def position_labels(spark, folder):
    docs = documents(spark, folder, "doc_id")
    return E.labels_by_position(docs, "doc_id", F.floor(F.col("doc_id") / 100_000)).select("doc_id", "label")


@query("class_weights", """
SELECT quality AS label, count(*)::BIGINT AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality""")
def class_weights(spark, folder):
    out = E.class_weights(table(spark, folder, "labels").select(F.col("quality").alias("label")))
    return out.withColumn("weight", F.round("weight", 6))


@query("scaled_vectors", f"""
WITH d AS ({SQL_DIMS}), t AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM d WHERE {sql_uniform('vec_id', 42)} >= 0.2 GROUP BY dim)
SELECT vec_id, dim, round((x - m) / s, 5) AS x FROM d JOIN t USING (dim) WHERE {sql_uniform('vec_id', 42)} < 0.2""")
def scaled_vectors(spark, folder):
    vecs = split_rows(embeddings(spark, folder), ["vec_id"], 0.2, 42)
    scaled = E.fit_scaler(vecs.where("split = 'train'")).apply(vecs.where("split = 'test'"))
    out = scaled.select("vec_id", F.posexplode("vec").alias("dim", "x"))
    return out.select("vec_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("x", 5).alias("x"))


def predicted_labels(spark, folder):
    """Quality labels against a length rule."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = documents(spark, folder, "doc_id", "n_chars")
    return labels.join(docs, "doc_id").withColumn("prediction", (F.col("n_chars") % 5 != 0).cast("int"))


@query("f1_report", """
WITH p AS (SELECT quality AS t, (n_chars % 5 <> 0)::INT AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT unnest([0, 1]) AS k),
s AS (SELECT k::VARCHAR AS class, (SELECT count(*) FROM p WHERE t = k) AS support, (SELECT 2.0 * count(*) FROM p WHERE t = k AND p.p = k) / ((SELECT count(*) FROM p WHERE t = k) + (SELECT count(*) FROM p WHERE p.p = k)) AS f FROM c)
SELECT class, support::BIGINT AS support, round(f, 6)::DOUBLE AS f1 FROM s UNION ALL SELECT 'macro', sum(support)::BIGINT, round(avg(f), 6)::DOUBLE FROM s""")
def f1_report(spark, folder):
    return E.f1_report(predicted_labels(spark, folder)).withColumn("f1", F.round("f1", 6))


@query("vector_classifier")
def vector_classifier(spark, folder):
    """Balanced classifier on scaled vectors, scored on the held-out fifth."""
    vecs = split_rows(embeddings(spark, folder), ["vec_id"], 0.2, 42)
    train, test = vecs.where("split = 'train'"), vecs.where("split = 'test'")
    scaler = E.fit_scaler(train)
    model = E.train_classifier(scaler.apply(train), iterations=100)
    scored = E.classify(model, scaler.apply(test)).withColumn("prediction", F.col("prediction").cast("int"))
    return E.f1_report(scored).withColumn("f1", F.round("f1", 4))


# ---- counting language model

def sentences(spark, folder):
    return split_rows(P.sentences(documents(spark, folder, "doc_id", "text"), ["doc_id"], terminators=STOP), ["doc_id"], 0.1, 42)


SQL_SPLIT = f"SELECT doc_id, sent_no, {sql_tokens('text')} AS w, CASE WHEN {sql_uniform('doc_id', 42)} < 0.1 THEN 'test' ELSE 'train' END AS split FROM ({sql_sentences('doc_id')})"


def _sql_events(source: str) -> str:
    return f"""SELECT unnest(list_concat(['<s>'], w)) AS context, unnest(list_concat(w, ['</s>'])) AS next FROM {source}"""


@query("ngram_counts", f"""
WITH s AS ({SQL_SPLIT}), e AS (SELECT list_concat(list_concat(['<s>', '<s>'], w), ['</s>']) AS p FROM s),
g AS (SELECT p, unnest(range(3, len(p) + 1)) AS i FROM e)
SELECT p[i - 2] || ' ' || p[i - 1] AS context, p[i] AS next, count(*)::BIGINT AS n FROM g GROUP BY 1, 2""")
def ngram_counts(spark, folder):
    return L.ngram_model(sentences(spark, folder), T.tokens("text"), 3)


@query("next_token_top", f"""
WITH s AS ({SQL_SPLIT}), c AS (SELECT context, next, count(*)::BIGINT AS n FROM ({_sql_events('s')}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS rank, sum(n) OVER (PARTITION BY context) AS t FROM c)
SELECT context, rank, next, n, round(n / t, 6) AS p FROM r WHERE rank <= 5""")
def next_token_top(spark, folder):
    out = L.top_next(L.ngram_model(sentences(spark, folder), T.tokens("text"), 2), 5)
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("p", F.round("p", 6))


@query("prompt_continuations_top", f"""
WITH s AS ({SQL_SPLIT}), c AS (SELECT context, next, count(*)::BIGINT AS n FROM ({_sql_events('s')}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS rank, sum(n) OVER (PARTITION BY context) AS t FROM c),
q AS (SELECT conv_id, turn, coalesce(({sql_tokens('text')})[-1], '<s>') AS context FROM conversations)
SELECT conv_id, turn, context, rank, next, n, round(n / t, 6) AS p FROM q JOIN r USING (context) WHERE rank <= 3""")
def prompt_continuations_top(spark, folder):
    model = L.ngram_model(sentences(spark, folder), T.tokens("text"), 2)
    out = L.prompt_next(table(spark, folder, "conversations"), model, ["conv_id", "turn"], T.tokens("text"), 2, 3)
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("p", F.round("p", 6))


@query("blank_fillers", f"""
WITH s AS ({SQL_SPLIT}), e AS (SELECT list_concat(list_concat(['<s>'], w), ['</s>']) AS p FROM s),
g AS (SELECT p, unnest(range(2, len(p))) AS i FROM e),
c AS (SELECT p[i - 1] AS "left", p[i + 1] AS "right", p[i] AS middle, count(*)::BIGINT AS n FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "left", "right" ORDER BY n DESC, middle) AS rank, sum(n) OVER (PARTITION BY "left", "right") AS t FROM c)
SELECT "left", "right", rank, middle, n, round(n / t, 6) AS p FROM r WHERE rank <= 3""")
def blank_fillers(spark, folder):
    out = L.fill_mask(L.blank_model(sentences(spark, folder), T.tokens("text")), 3)
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("p", F.round("p", 6))


@query("held_out_perplexity", f"""
WITH s AS ({SQL_SPLIT}), tr AS (SELECT * FROM s WHERE split = 'train'), te AS (SELECT * FROM s WHERE split = 'test'),
m AS (SELECT context, next, count(*) AS n FROM ({_sql_events('tr')}) GROUP BY ALL), c AS (SELECT context, sum(n) AS t FROM m GROUP BY context),
v AS (SELECT count(DISTINCT next) + 1 AS v FROM m), e AS ({_sql_events('te')}),
l AS (SELECT ln((coalesce(n, 0) + 1.0) / (coalesce(t, 0) + 1.0 * v)) AS lp, v FROM e LEFT JOIN m USING (context, next) LEFT JOIN c USING (context) CROSS JOIN v)
SELECT count(*)::BIGINT AS events, round(exp(-avg(lp)), 4) AS perplexity, any_value(v)::DOUBLE AS uniform, round(exp(-avg(lp)) / any_value(v), 6) AS ratio FROM l""")
def held_out_perplexity(spark, folder):
    rows = sentences(spark, folder)
    model = L.ngram_model(rows.where("split = 'train'"), T.tokens("text"), 2)
    out = L.perplexity(model, rows.where("split = 'test'"), T.tokens("text"), 2)
    return out.select("events", F.round("perplexity", 4).alias("perplexity"), "uniform", F.round("ratio", 6).alias("ratio"))


def _sql_greedy(steps: int) -> str:
    out = "SELECT conv_id, turn, context AS c0, false AS d0, '' AS o0 FROM q"
    for i in range(steps):
        out = f"""SELECT conv_id, turn, CASE WHEN d{i} OR nx IS NULL OR nx = '</s>' THEN c{i} ELSE nx END AS c{i + 1},
  (d{i} OR nx IS NULL OR nx = '</s>') AS d{i + 1}, CASE WHEN d{i} OR nx IS NULL OR nx = '</s>' THEN o{i} ELSE trim(o{i} || ' ' || nx) END AS o{i + 1}
  FROM ({out}) LEFT JOIN (SELECT context, nx FROM b) b ON b.context = c{i}"""
    return f"SELECT conv_id, turn, o{steps} AS continuation FROM ({out})"


@query("greedy_continuation", f"""
WITH s AS ({SQL_SPLIT}), c AS (SELECT context, next, count(*) AS n FROM ({_sql_events('s')}) GROUP BY ALL),
b AS (SELECT context, next AS nx FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS r FROM c) WHERE r = 1),
q AS (SELECT conv_id, turn, coalesce(({sql_tokens('text')})[-1], '<s>') AS context FROM conversations)
{_sql_greedy(5)}""")
def greedy_continuation(spark, folder):
    model = cut_lineage(L.ngram_model(sentences(spark, folder), T.tokens("text"), 2), "bigrams")
    return L.continue_text(model, table(spark, folder, "conversations"), ["conv_id", "turn"], T.tokens("text"), 2, 5)
