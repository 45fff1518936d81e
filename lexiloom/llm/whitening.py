"""Embedding whitening with distributed block matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import cut_lineage

SCALE = 256
BLOCK_ENTRIES = 1 << 18  # doubles in one block: 2 MB
BLOCK_COLUMNS = 512
BLOCKS_AT_ONCE = 8  # pairs of blocks that one task of a product over many rows holds
RANK_SHARE = 1e-12  # eigenvalues under this share of the largest count as zero


def scaled(vector: Column) -> Column:
    """floor(256 * c) of each entry as a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))


def usable(vector: Column) -> Column:
    """Vectors that are not null, not empty and hold finite numbers only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``place``, gapless from 0: written with their place in the task, then moved by the sizes of earlier tasks."""
    rows = cut_lineage(rows.withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    tasks = rows.groupBy("__task").agg(F.count(F.lit(1)).alias("n"))
    # a row per task that wrote
    before = F.coalesce(F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = tasks.withColumn("__start", before).drop("n")
    return rows.join(F.broadcast(starts), "__task").withColumn("place", F.col("__start") + F.col("__at")).drop("__task", "__at", "__start")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        if batch.num_rows:
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([values.sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["n", "sums"])


def vector_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors ``x`` there are, and their exact sums per dimension."""
    parts = vectors.select("x").mapInArrow(_sums, "n bigint, sums array<bigint>")
    rows = parts.select("n", F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return (rows[0]["n"], [r["s"] for r in rows]) if rows else (0, [])


def block_matrix(rows: DataFrame, n_rows: int, n_columns: int) -> BlockMatrix:
    """Blocks of rows (place, centred), dealt by place. Places without a row are rows of zeros."""
    indexed = rows.select(F.col("place").alias("index"), array_to_vector("centred").alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(indexed, "vector")
    width = min(n_columns, BLOCK_COLUMNS)
    return IndexedRowMatrix(indexed, n_rows, n_columns).toBlockMatrix(max(1, BLOCK_ENTRIES // width), width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself, on the driver: columns times columns.

    The rows, which the product runs over, are dealt to as many tasks as keep BLOCKS_AT_ONCE blocks of
    rows in each; only their small sums meet.
    """
    turned = matrix.transpose()
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_AT_ONCE))
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def principal_axes(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    real = (values > RANK_SHARE * max(values[0], 0.0)) & (values > 0)
    values, vectors = values[real], vectors[:, real]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(values))] < 0, -1.0, 1.0)


def projected(sc: SparkContext, matrix: BlockMatrix, axes: np.ndarray) -> DataFrame:
    """(place, y): the matrix times ``axes``, a row per row."""
    height, width = matrix.colsPerBlock, axes.shape[1]
    # columns times components, as many as the matrix has columns in a block
    parts = [
        ((i, 0), Matrices.dense(len(part), width, part.T.ravel().tolist()))
        for i, part in enumerate(axes[at : at + height] for at in range(0, len(axes), height))]
    right = BlockMatrix(sc.parallelize(parts, 1), height, width, axes.shape[0], width)
    product = matrix.multiply(right)
    indexed = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return indexed.select(F.col("index").alias("place"), vector_to_array("vector").alias("y"))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    x is floor(256 * entry). The fit list holds each distinct x once: n vectors with sums S, so that copies do not
    pull the axes. Rows are centred by S / n, indexed and dealt into a BlockMatrix; its transpose times itself, of the
    fit list's rows, is the scatter; axes are its eigenvectors by falling eigenvalue e, found on the driver; the
    matrix times the axes over sqrt(e) gives all rows whitened. ``deviation`` is the exact sum of (n * x - S) ** 2;
    ``identity_error`` is how far the covariance of the fit list's whitened rows is from the identity.

    Cases. Null and empty vectors and such with null or non-finite entries are left out, and so are vectors of another
    length than the most frequent one (of equally frequent ones, the longest). Repeated rows and null ids each give
    rows. Equal eigenvalues keep the order in which they are found. A direction without variance is no component: vectors
    that are all alike, a single one or an empty table give no rows. A deviation that a long cannot hold is null. Other
    columns are not read. On the driver are matrices of dimension times dimension.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`")
    good = rows.where(usable(vector)).select(F.col(f"`{id_col}`").alias("id"), scaled(vector).alias("x"))
    length = good.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    id_field = T.StructField(id_col, rows.schema[id_col].dataType)
    empty = spark.createDataFrame([], T.StructType([
        id_field, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]]))
    if length is None:
        return empty
    d = length["length"]
    all_rows = numbered(good.where(F.size("x") == d), "vectors")
    fit = cut_lineage(all_rows.groupBy("x").agg(F.min("place").alias("place")), "fit")
    n, sums = vector_sums(fit)
    total = int(all_rows.agg(F.max("place")).first()[0]) + 1

    mean, whole = F.array(*[F.lit(s / n) for s in sums]), F.array(*[F.lit(s).cast("bigint") for s in sums])
    centred = lambda df: df.select("place", F.zip_with("x", mean, lambda x, m: x - m).alias("centred"))
    covariance = scatter(block_matrix(centred(fit), total, d)) / n
    values, axes = principal_axes(covariance, components)
    if not len(values):
        return empty

    y = cut_lineage(projected(spark.sparkContext, block_matrix(centred(all_rows), total, d), axes / np.sqrt(values)), "whitened")
    k = len(values)
    mine = y.join(fit.select("place"), "place", "left_semi")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = mine.agg(*[F.avg(F.col("y")[i]) for i in range(k)], *[F.avg(F.col("y")[i] * F.col("y")[j]) for i, j in pairs]).first()
    error = max(abs(moments[k + p] - moments[i] * moments[j] - (i == j)) for p, (i, j) in enumerate(pairs))

    trace = float(np.trace(covariance))
    explained = F.array(*[F.lit(float(e) / trace) for e in values])
    square = lambda total, v: F.try_add(total, F.try_multiply(v, v))
    deviation = F.aggregate(
        F.zip_with("x", whole, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("bigint"), x), s)), F.lit(0).cast("bigint"), square)
    out = all_rows.select("place", "id", deviation.alias("deviation")).join(y, "place")
    return out.select(F.col("id").alias(id_col), "deviation", F.posexplode("y").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
