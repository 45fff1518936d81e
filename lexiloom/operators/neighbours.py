"""Nearest neighbours by an inverted file: vectors lie in cells around centroids, queries visit some of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import cut_lineage

MOST_CELLS = 4096
SAMPLE_PER_CELL = 64  # vectors that the centroids are fitted on, for each of them
BLOCK = 4096  # rows of one side in one group of a task
ROWS_AT_ONCE = 256  # rows of one side in one product, and BLOCK visits in one batch, so that neither grows with the cells
SLACK = 1e-9  # for bounds on cosines that were rounded


def unit(vec: Column) -> Column:
    """A vector of doubles with length 1; a zero vector stays zero."""
    doubles = F.transform(vec, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(doubles, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def fit_centroids(vectors: DataFrame, vector_id: str, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Centroids of length 1, as rows, from a sample of at most SAMPLE_PER_CELL vectors for each.

    Without ``cells`` there are about as many as the root of the number of vectors, at most MOST_CELLS. The sample is
    chosen by a hash of the id among all vectors, so the same vectors always give the same centroids.
    """
    rows = vectors.select(F.col(vector_id).alias("id"), unit(F.col("vec")).alias("vec")).where(F.exists("vec", lambda x: x != 0))
    cells = max(2, min(MOST_CELLS, cells or round(rows.count() ** 0.5)))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells * SAMPLE_PER_CELL)
    sample = cut_lineage(sample.select(array_to_vector("vec").alias("features")), "sample")
    if sample.isEmpty():
        return np.zeros((0, 0))
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(sample).clusterCenters())
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    return np.unique(centres[lengths[:, 0] > 0] / lengths[lengths[:, 0] > 0], axis=0)


class InvertedFile:
    """Vectors in cells of their nearest centroids, a written table of blocks, with the cells' radii.

    ``rows`` holds (cell, block, id, vec), vectors of length 1; a crowded cell has several blocks. What is
    sent to every task are the centroids and radii, MOST_CELLS at most.
    """

    def __init__(self, vectors: DataFrame, vector_id: str = "word", cells: int | None = None, seed: int = 42):
        self.spark = vectors.sparkSession
        self.id_type = vectors.schema[vector_id].dataType.simpleString()
        self.centroids = fit_centroids(vectors, vector_id, cells, seed)
        if not len(self.centroids):
            # zero vectors only, or none
            width = vectors.select(F.max(F.size("vec"))).first()[0] or 1
            self.centroids = np.eye(1, width)
        centroids = self.spark.sparkContext.broadcast(self.centroids)

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (f.iloc[at : at + ROWS_AT_ONCE] for f in frames for at in range(0, len(f), ROWS_AT_ONCE)):
                near = np.array(pdf["vec"].tolist()) @ centroids.value.T
                cell = near.argmax(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), angle=np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)))

        rows = vectors.where("vec IS NOT NULL").select(F.col(vector_id).alias("id"), unit(F.col("vec")).alias("vec"))
        rows = cut_lineage(rows.mapInPandas(place, f"id {self.id_type}, vec array<double>, cell int, angle double"), "placed")
        # a row per cell
        found = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()
        self.sizes, self.radii = np.zeros(len(self.centroids), np.int64), np.full(len(self.centroids), -np.inf)
        for r in found:
            self.sizes[r["cell"]], self.radii[r["cell"]] = r["n"], r["radius"]
        blocks = F.array(*[F.lit(max(1, -(-int(n) // BLOCK))) for n in self.sizes])
        dealt = F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).cast("int")
        self.rows = rows.select("cell", dealt.alias("block"), "id", "vec")

    def nearest(self, queries: DataFrame, k: int = 5, query_id: str = "query", probes: int = 8, certain: bool = False) -> DataFrame:
        """(query, rank, word, cosine): the ``k`` nearest vectors of each query.

        A query visits the cells of its ``probes`` nearest centroids, where cosines are computed in full. With ``certain``
        it then visits every other cell that may hold a nearer vector: by the triangle inequality between angles
        no vector of a cell is nearer than the centroid's angle less the cell's radius. The answers are then those of an
        exhaustive search, ties by id included. Neither queries nor vectors pass the driver.

        Queries with a null vector are left out; queries that repeat an id are one query each row of which answers, so
        ids should be unique.
        """
        qt = queries.schema[query_id].dataType.simpleString()
        asked = cut_lineage(queries.where("vec IS NOT NULL").select(F.col(query_id).alias("query"), unit(F.col("vec")).alias("q")), "asked")
        first = self._found(self._pairs(asked, qt, probes), qt, k)
        if not certain:
            return self._ranked(first, k)
        first = cut_lineage(first, "found")
        # the k-th best so far, or the worst there is where fewer were found
        best = self._ranked(first, k).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
        least = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-1.0))
        open_ = asked.join(best, "query", "left").select("query", "q", F.coalesce(least, F.lit(-1.0)).alias("least"))
        return self._ranked(first.unionByName(self._found(self._pairs(open_, qt, probes, rest=True), qt, k)), k)

    def _pairs(self, asked: DataFrame, qt: str, probes: int, rest: bool = False) -> DataFrame:
        """(cell, query, q) of the cells that a query visits first, or of the others that it has to visit."""
        sent = self.spark.sparkContext.broadcast((self.centroids, self.radii, self.sizes))

        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centroids, radii, sizes = sent.value
            for pdf in () if not sizes.any() else (f.iloc[at : at + ROWS_AT_ONCE] for f in frames for at in range(0, len(f), ROWS_AT_ONCE)):
                near = np.array(pdf["q"].tolist()) @ centroids.T
                near[:, sizes == 0] = -2.0
                order = np.argsort(-near, axis=1, kind="stable")
                visited = np.zeros(near.shape, bool)
                np.put_along_axis(visited, order[:, :probes], True, axis=1)
                if rest:
                    angle = np.arccos(np.clip(near, -1, 1)) - radii[None, :]
                    may = np.cos(np.clip(angle, 0, np.pi)) + SLACK >= pdf["least"].to_numpy()[:, None]
                    visited = may & ~visited
                visited[:, sizes == 0] = False
                at, cell = np.nonzero(visited)
                for some in (slice(i, i + BLOCK) for i in range(0, len(at), BLOCK)):
                    yield pd.DataFrame({"cell": cell[some].astype("int32"), "query": pdf["query"].to_numpy()[at[some]], "q": pdf["q"].to_numpy()[at[some]]})

        return asked.mapInPandas(choose, f"cell int, query {qt}, q array<double>")

    def _found(self, pairs: DataFrame, qt: str, k: int) -> DataFrame:
        """(query, word, cosine): the k best of each block that a query visits. Each task multiplies blocks of both sides."""
        sizes = F.array(*[F.lit(max(1, -(-int(n) // BLOCK))) for n in self.sizes])
        pairs = cut_lineage(pairs, "visits")
        crowd = pairs.groupBy("cell").agg((F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1).cast("int").alias("slices"))
        # a row per cell
        slices = {r["cell"]: r["slices"] for r in crowd.collect()}
        many = F.array(*[F.lit(slices.get(c, 0)) for c in range(len(self.sizes))])
        left = pairs.select(
            "cell", F.explode(F.sequence(F.lit(0), F.get(sizes, F.col("cell")) - 1)).alias("block"),
            F.pmod(F.xxhash64("query"), F.get(many, F.col("cell"))).cast("int").alias("slice"), "query", "q")
        right = self.rows.where(F.get(many, F.col("cell")) > 0).select(
            "cell", "block", F.explode(F.sequence(F.lit(0), F.get(many, F.col("cell")) - 1)).alias("slice"), "id", "vec")
        keys = ["cell", "block", "slice"]

        def multiply(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if queries.empty or block.empty:
                return pd.DataFrame({"query": [], "word": [], "cosine": []})
            block = block.sort_values("id", kind="stable")
            ids, rows = block["id"].to_numpy(), np.array(block["vec"].tolist())
            asked, found = queries["query"].to_numpy(), []
            for some in (slice(i, i + ROWS_AT_ONCE) for i in range(0, len(queries), ROWS_AT_ONCE)):
                # the last bits of a product depend on the sizes of the blocks, and ties must not
                cosines = np.round(np.array(queries["q"].iloc[some].tolist()) @ rows.T, 12)
                order = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
                found.append(pd.DataFrame({
                    "query": np.repeat(asked[some], order.shape[1]), "word": ids[order].ravel(), "cosine": np.take_along_axis(cosines, order, axis=1).ravel()}))
            return pd.concat(found, ignore_index=True)

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(multiply, f"query {qt}, word {self.id_type}, cosine double")

    @staticmethod
    def _ranked(found: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("query").orderBy(F.desc("cosine"), "word")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "word", "cosine")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (query, word) that were found."""
    hit = exact.select("query", "word").join(found.select("query", "word").distinct().withColumn("hit", F.lit(1)), ["query", "word"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
