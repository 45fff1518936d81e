"""Splits and samples: seeded, stable under repartitioning, leakage-checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.hashing import hash_key, uniform
from lexiloom.functions.text import tokens
from lexiloom.operators.joins import require_present, spread_join
from lexiloom.operators.ordered import ordered_scan
from lexiloom.session import cut_lineage


def split_rows(df: DataFrame, key: list[str], test_ratio: float, seed: int = 42) -> DataFrame:
    """Add ``split`` by a hash of the key: no shuffle, approximate size."""
    return df.withColumn("split", F.when(uniform(*key, seed=seed) < test_ratio, "test").otherwise("train"))


def split_groups(df: DataFrame, key: str, held_out: list[str]) -> DataFrame:
    """Whole groups to validation from a given list; an unknown name is an error."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in held_out], f"{key} string")
    require_present(wanted, df, [key], "held-out groups")
    return df.withColumn("split", F.when(F.col(key).isin(held_out), "validation").otherwise("train"))


def split_groups_frac(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Hold out ``max(1, round(n * fraction))`` groups, the lowest in hash order."""
    groups = df.select(key).distinct().withColumn("__h", hash_key(key, seed=seed))
    ranked = ordered_scan(
        groups, [], ["__h", key], [F.substring("__h", 1, 3)], __i=("number",), __n=("count",)
    )
    wanted = F.greatest(F.lit(1), F.bround(F.col("__n") * fraction))
    flags = ranked.select(key, F.when(F.col("__i") <= wanted, "validation").otherwise("train").alias("split"))
    return spread_join(df, flags, [key])


def split_pairs(df: DataFrame, key: list[str], a: str, b: str, train_ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """Split pairs, then double each into both directions, so a pair never straddles the split."""
    split = split_rows(df, key, 1 - train_ratio, seed)
    return split.select(*key, "split", F.explode(F.array(
        F.struct(F.lit("a2b").alias("direction"), F.col(a).alias("source"), F.col(b).alias("target")),
        F.struct(F.lit("b2a").alias("direction"), F.col(b).alias("source"), F.col(a).alias("target")),
    )).alias("d")).select(*key, "split", "d.*")


def sample_n(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """A fixed-size seeded sample, the lowest ``n`` in hash order."""
    h = hash_key(*key, seed=seed)
    return df.orderBy(h, *key).limit(n)


def shingle_sets(df: DataFrame, key: str, text: str = "text", width: int = 3) -> DataFrame:
    """(key, set): the sorted distinct hashes of word shingles; texts shorter than one shingle give one."""
    words = tokens(text)
    last = F.greatest(F.size("__w") - F.lit(width) + 1, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice("__w", i, F.lit(width)), " ")))
    return (
        df.select(key, words.alias("__w")).where(F.size("__w") > 0)
        .select(key, F.array_sort(F.array_distinct(grams)).alias("set"))
    )


# How many of the commonest shingles have a place of their own in the order, what part of the training
# sets they are counted in, and how many elements are ordered at once.
RANKED, COUNTED_IN, ORDERED_AT_ONCE = 200_000, 8, 1 << 20


def _prefixes(df: DataFrame, ident: str, elements: str, ranked: pa.Table, threshold: float) -> DataFrame:
    """(e, ident): the first elements of each sorted set, those of no rank first, then by rank."""
    by_value = np.argsort(ranked["e"].to_numpy())
    shared = df.sparkSession.sparkContext.broadcast((ranked["e"].to_numpy()[by_value], by_value + 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, places = shared.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column(elements)).to_numpy(zero_copy_only=False).astype(np.int64)
            step = max(1, batch.num_rows * ORDERED_AT_ONCE // max(1, int(sizes.sum())))
            for at in range(0, batch.num_rows, step):
                part, n = batch.slice(at, step), sizes[at:at + step]
                values = part.column(elements).flatten().to_numpy()
                rank = np.zeros(len(values), dtype=np.int64)
                if len(listed):
                    spot = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
                    rank = np.where(listed[spot] == values, places[spot], 0)
                row = np.repeat(np.arange(len(n)), n)
                order = np.argsort(row * (len(listed) + 1) + rank, kind="stable")
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                kept = place < np.repeat(n - np.ceil(threshold * n).astype(np.int64) + 1, n)
                yield pa.RecordBatch.from_arrays([pa.array(values[order[kept]]), part.column(ident).take(pa.array(row[kept]))], names=["e", ident])

    return df.select(ident, elements).mapInArrow(cut, f"e long, {ident} {df.schema[ident].dataType.simpleString()}")


def leakage(train: DataFrame, test: DataFrame, key: str, text: str = "text", width: int = 3, threshold: float = 0.8) -> DataFrame:
    """Test rows with ``leaked`` = some train row has shingle Jaccard >= threshold. Exact.

    Two sets can reach the threshold only if they share an element of their
    prefixes under one global order. Any order gives the same flags; this one puts
    the commonest shingles last, which keeps boilerplate out of the prefixes. They are
    counted in every ``COUNTED_IN``-th training set, by its hash, and at most ``RANKED`` are listed.
    Equal sets are collapsed to one first. Common elements up to the end of the prefix that ends
    first lie in both prefixes, so a pair's shared prefix elements and what lies behind a prefix
    bound its overlap; only pairs that may still reach the threshold meet with their sets.
    Each test set is tried first against the training sets that most of its elements name as
    the least that holds them, and only test sets still unmatched meet all of their candidates.
    """
    sets = lambda df: shingle_sets(df, key, text, width)
    id_of = F.xxhash64("set")
    tests = cut_lineage(sets(test).withColumn("sid", F.struct(id_of.alias("h"), F.size("set").alias("n"))), "held-out-sets")
    trains = cut_lineage(sets(train).select(
        F.struct(id_of.alias("h"), F.size("set").alias("n")).alias("tid"), F.col("set").alias("train_set")
    ).groupBy("tid").agg(F.first("train_set").alias("train_set")), "train-sets")
    test_sets = tests.groupBy("sid").agg(F.first("set").alias("test_set"))

    counted = trains.where(F.pmod("tid.h", F.lit(COUNTED_IN)) == 0).select(F.explode("train_set").alias("e"))
    common = counted.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "e").limit(RANKED)
    # commonest last
    ranked = common.orderBy("n", "e").toArrow()
    train_prefix = cut_lineage(_prefixes(trains, "tid", "train_set", ranked, threshold), "train-prefixes")
    test_prefix = cut_lineage(_prefixes(test_sets, "sid", "test_set", ranked, threshold), "held-out-prefixes")
    sized = (F.col("tid.n") >= F.col("sid.n") * threshold) & (F.col("sid.n") >= F.col("tid.n") * threshold)
    behind = F.greatest(F.ceil(F.col("sid.n") * threshold), F.ceil(F.col("tid.n") * threshold)) - 1
    wanted = (F.col("sid.n") + F.col("tid.n")) * (threshold / (1 + threshold)) - 1e-6

    def shared(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, "e").where(sized).groupBy("sid", "tid").agg(F.count(F.lit(1)).alias("n"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("test_set", "train_set"))
        return (
            pairs.select("sid", "tid").join(test_sets, "sid").join(trains, "tid")
            .where(both >= threshold * (F.size("test_set") + F.size("train_set") - both))
            .select("sid").distinct()
        )

    representative = train_prefix.groupBy("e").agg(F.min("tid").alias("tid"))
    likeliest = Window.partitionBy("sid").orderBy(F.desc("n"), "tid")
    tried = shared(test_prefix, representative).withColumn("r", F.row_number().over(likeliest)).where("r <= 2")
    first = cut_lineage(verified(tried), "matched")
    rest = test_prefix.join(first, "sid", "left_anti")
    second = verified(cut_lineage(shared(rest, train_prefix).where(F.col("n") + behind >= wanted), "candidates"))
    matched = first.unionByName(second).distinct().withColumn("leaked", F.lit(True))
    return spread_join(tests.select(key, "sid"), matched, ["sid"], "left", spread_by=[key]).select(
        key, F.coalesce("leaked", F.lit(False)).alias("leaked")
    )


def leakage_share(flags: DataFrame) -> DataFrame:
    return flags.agg(
        F.count(F.lit(1)).alias("held_out"), F.count_if("leaked").alias("leaked")
    ).withColumn("leaked_pct", F.when(F.col("held_out") > 0, F.col("leaked") / F.col("held_out") * 100))
