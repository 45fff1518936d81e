import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import neighbours
from lexiloom.operators.neighbours import InvertedFile, recall
from lexiloom.operators.vectors import nearest

SCHEMA = "word bigint, vec array<double>"


@pytest.fixture(scope="module")
def grouped(spark):
    """3,000 vectors around 40 directions, one of which holds a third of them; copies and a zero vector."""
    generator = np.random.default_rng(5)
    centres = generator.normal(size=(40, 24))
    place = np.where(generator.random(3000) < 0.33, 0, generator.integers(0, 40, 3000))
    data = centres[place] + 0.35 * generator.normal(size=(3000, 24))
    data[100:120] = data[100]
    data[7] = 0.0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SCHEMA).cache()
    queries = spark.createDataFrame([(i, (v + 0.05).tolist()) for i, v in enumerate(data[:2000:10])] + [(99_999, [0.0] * 24)], "query bigint, vec array<double>")
    return vectors, queries


def as_rows(df):
    return {(r["query"], r["rank"]): (r["word"], round(r["cosine"], 9)) for r in df.collect()}


def test_certain_search_equals_the_exhaustive_one(grouped, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    vectors, queries = grouped
    index = InvertedFile(vectors)
    assert max(index.sizes) > 64 and index.rows.where("block > 0").count() > 0
    got, want = as_rows(index.nearest(queries, 5, probes=2, certain=True)), as_rows(nearest(queries, vectors, 5))
    # copies have one cosine, so only their order may hang on the last bits of the exhaustive route
    assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)
    zero = [got[99_999, r][0] for r in range(1, 6)]
    assert zero == [0, 1, 2, 3, 4]


def test_recall_of_a_few_probes(grouped):
    vectors, queries = grouped
    queries = queries.where("query < 99999")
    exact = nearest(queries, vectors, 5)
    index = InvertedFile(vectors)
    few, more = (recall(index.nearest(queries, 5, probes=p), exact) for p in (1, 8))
    assert few <= more and more >= 0.95
    assert recall(exact, exact) == 1.0


def test_odd_vectors(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query int, vec array<double>")
    vectors = spark.createDataFrame([(3, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, None)], SCHEMA)
    got = InvertedFile(vectors).nearest(queries, 5, certain=True).orderBy("rank").collect()
    assert [(r["query"], r["rank"], r["word"], r["cosine"]) for r in got] == [(1, 1, 1, 1.0), (1, 2, 3, 1.0), (1, 3, 2, 0.0)]
    assert InvertedFile(vectors.limit(0)).nearest(queries, 5).count() == 0
    assert InvertedFile(vectors).nearest(queries.limit(0), 5, certain=True).count() == 0
    assert InvertedFile(vectors.where("word = 2")).nearest(queries, 1).count() == 1


def test_the_same_index_again(grouped):
    vectors, _ = grouped
    a, b = (neighbours.fit_centroids(v, "word", 12) for v in (vectors, vectors.repartition(7).orderBy(F.desc("word"))))
    assert np.allclose(a, b)


def test_certain_in_small_products(spark, monkeypatch):
    # products of three queries and batches of seven visits give the exhaustive answers
    monkeypatch.setattr(neighbours, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    data = np.random.default_rng(9).normal(size=(60, 4))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "word int, vec array<double>")
    queries = vectors.where("word % 4 = 0").withColumnRenamed("word", "query")
    found = neighbours.InvertedFile(vectors, "word", cells=5).nearest(queries, 3, probes=1, certain=True)
    got = {(r["query"], r["rank"]): r["word"] for r in found.collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert got == {(q, k): int(w) for q in range(0, 60, 4) for k, w in enumerate(np.argsort(-(unit @ unit[q]))[:3], 1)}
