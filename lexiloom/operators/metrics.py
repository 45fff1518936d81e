"""Sequence-error metrics between a reference and a synthetic clip."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.vectors import distance

DECIBEL = 10.0 / math.log(10.0) * math.sqrt(2.0)


def warp(ref: np.ndarray, syn: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost monotone path between two (frames, dims) sequences under Euclidean cost.

    Cells are filled one anti-diagonal at a time. Among equal predecessors the
    diagonal wins, then a step in the second sequence, then in the first.
    """
    n, m = len(ref), len(syn)
    cost = np.sqrt(np.maximum(
        (ref * ref).sum(1)[:, None] + (syn * syn).sum(1)[None, :] - 2.0 * ref @ syn.T, 0.0))
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    step = np.zeros((n + 1, m + 1), dtype=np.int8)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        options = np.stack([total[i - 1, j - 1], total[i, j - 1], total[i - 1, j]])
        step[i, j] = options.argmin(axis=0)
        total[i, j] = cost[i - 1, j - 1] + options.min(axis=0)
    path = []
    i, j = n, m
    while i and j:
        path.append((i - 1, j - 1))
        move = step[i, j]
        i, j = i - (move != 1), j - (move != 2)
    return path[::-1]


def dtw(pairs: DataFrame, key: list[str], ref: str = "ref", syn: str = "syn") -> DataFrame:
    """(key, pos, i, j): the warping path of every clip, one clip per row in and out of Python."""
    types = {f.name: f.dataType.simpleString() for f in pairs.schema if f.name in key}
    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", path array<struct<i:int,j:int>>"

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for row in pdf.to_dict("records"):
                x = np.array([np.asarray(f, float) for f in row[ref]])
                y = np.array([np.asarray(f, float) for f in row[syn]])
                path = warp(x, y) if len(x) and len(y) else []
                rows.append((*[row[k] for k in key], [{"i": int(i), "j": int(j)} for i, j in path]))
            yield pd.DataFrame(rows, columns=[*key, "path"])

    paths = pairs.select(*key, ref, syn).mapInPandas(align, schema)
    return paths.select(*key, F.posexplode("path").alias("pos", "p")).select(*key, "pos", "p.i", "p.j")


def on_path(paths: DataFrame, pairs: DataFrame, key: list[str], **series: str) -> DataFrame:
    """Path rows with the values they align: ``x_i`` at i and ``y_j`` at j of each named (ref, syn) column."""
    wide = paths.join(pairs, key)
    # a position past the end of a shorter series takes its last value
    at = lambda arr, idx: F.get(arr, F.least(F.col(idx), F.size(arr) - 1))
    out = [at(col, "i" if name.endswith("_i") else "j").alias(name) for name, col in series.items()]
    return wide.select(*key, "pos", *out)


def frame_db(a: Column | str, b: Column | str) -> Column:
    """Cepstral distance of two aligned frames in decibels."""
    return F.lit(DECIBEL) * distance(a, b)


def aligned_db(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*key).agg(F.avg(frame_db(a, b)).alias("mcd_db"))


def voiced_rmse(df: DataFrame, key: list[str], a: Column | str, b: Column | str) -> DataFrame:
    """Root mean square difference where both values are positive, null if nowhere."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    squares = F.when((a > 0) & (b > 0), F.pow(a - b, 2))
    return df.groupBy(*key).agg(F.sqrt(F.avg(squares)).alias("f0_rmse_hz"))


def clip_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: clips and the mean of each metric over the clips that have it."""
    return df.agg(F.count(F.lit(1)).alias("n_clips"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])
