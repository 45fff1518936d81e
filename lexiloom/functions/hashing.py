"""Seeded hash draws: the same row gets the same draw on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column | str, seed: int | str) -> Column:
    cols = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols, F.lit(str(seed))).cast("binary"))


def uniform(*parts: Column | str, seed: int | str) -> Column:
    """A draw in [0, 1) from the first 32 bits of the key's MD5 digest."""
    return F.conv(F.substring(hash_key(*parts, seed=seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
