"""Skip-gram vectors with negative sampling, trained in shards whose vectors are averaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.blocks import packed, unpacked
from lexiloom.session import cut_lineage, drop_shuffles, drop_table

# Words in a shard, words trained at once and multiplied at once, noise words drawn for them, noise words a pair counts,
# and the most pairs that one step of a word adds up (more are averaged, so that a very common word stays stable).
SHARD_WORDS = 1 << 20
CHUNK, BLOCK, DRAWN, NEGATIVE, MOST_PAIRS = 512, 32, 128, 5, 128
STEP, LEAST_STEP = 0.025, 1e-4
SUMMED_ROWS = 1 << 16  # rows of vectors added up in one group
# Shards that one task trains at most, and their number times the dimensions.
GROUP_SHARDS, GROUP_WIDTH = 8, 256


def weighted_means(rows: DataFrame, key: str, n_rows: int, kind: str = "double") -> DataFrame:
    """(key, n, vec): weighted means of vectors by key, from rows (key, n double, vec) where vec is already
    multiplied by its weight n.

    Keys are dealt by a hash into groups of about SUMMED_ROWS rows, added up by numpy.
    """
    width = np.float64 if kind == "double" else np.float32

    def add(table: pa.Table) -> pa.Table:
        return mean_rows(table, key, width)

    bucket = F.pmod(F.xxhash64(key), F.lit(n_rows // SUMMED_ROWS + 1)).alias("__b")
    return rows.select(key, "n", "vec", bucket).groupBy("__b").applyInArrow(add, f"{key} string, n double, vec array<{kind}>")


def mean_rows(table: pa.Table, key: str, width: type = np.float64) -> pa.Table:
    """``weighted_means`` of the rows of one table."""
    codes = table[key].combine_chunks().dictionary_encode()
    n, vec = table["n"].to_numpy(), list_matrix(table["vec"]).astype(np.float64)
    if not len(n):
        return pa.table({key: codes.dictionary, "n": n, "vec": matrix_lists(vec.astype(width))})
    code = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    sums = np.add.reduceat(n[order], starts)
    return pa.table({key: codes.dictionary, "n": sums, "vec": matrix_lists((np.add.reduceat(vec[order], starts, axis=0) / sums[:, None]).astype(width))})


def list_matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1 if len(lists) else 0)


def matrix_lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel()))


def _first_vectors(hashes: np.ndarray, dim: int) -> np.ndarray:
    """Small vectors that depend on the word's hash only (splitmix64), alike in every shard."""
    z = hashes.astype(np.uint64)[:, None] + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(dim)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _add_rows(target: np.ndarray, at: np.ndarray, steps: np.ndarray, pairs: np.ndarray, rate: float) -> None:
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    many = np.add.reduceat(pairs[order], starts)
    scale = np.float32(rate) * np.minimum(np.float32(1), MOST_PAIRS / np.maximum(many, 1)).astype(np.float32)
    target[at[order][starts]] += scale[:, None] * np.add.reduceat(steps[order], starts, axis=0)


def train_shard(ids: np.ndarray, text: np.ndarray, first: np.ndarray, second: np.ndarray, window: int, seed: list[int], done: float, share: float) -> None:
    """One pass over the words ``ids`` of a shard, which changes ``first`` and ``second`` in place.

    ``text`` says which text a word stands in; no pair spans two. Each word draws its reach, 1 to ``window``; every word
    within it is a pair. The step falls evenly over all passes, of which ``done`` are behind and this one is ``share``.
    """
    draw = np.random.default_rng(seed)
    noise = np.cumsum(np.bincount(ids, minlength=len(first)) ** 0.75)
    n, block, dim = len(ids), max(BLOCK, 2 * window), first.shape[1]
    chunk = CHUNK // block * block or block
    # windows of the first and last words reach into places of no text
    beyond = -n % chunk + window
    at_all = np.concatenate((np.zeros(window, np.int64), ids, np.zeros(beyond, np.int64)))
    own_all = np.concatenate((np.full(window, -1), text, np.full(beyond, -1)))
    wide, blocks = block + 2 * window, chunk // block
    apart = np.abs(np.arange(wide)[None, :] - np.arange(block)[:, None] - window)
    apart[apart == 0] = window + 1
    for lo in range(0, n, chunk):
        rate = max(LEAST_STEP * STEP, STEP * (1 - done - share * lo / n))
        at, own = at_all[lo : lo + chunk + 2 * window], own_all[lo : lo + chunk + 2 * window]
        centre = at[window : window + chunk]
        reach = np.where(own[window : window + chunk] >= 0, draw.integers(1, window + 1, chunk), 0)
        x, y = first[at], second[centre]
        around = np.lib.stride_tricks.sliding_window_view(own, wide)[::block]
        pair = apart[None] <= reach.reshape(blocks, block)[:, :, None]
        pair = (pair & (own[window : window + chunk].reshape(blocks, block)[:, :, None] == around[:, None, :])).astype(np.float32)
        x_blocks = np.lib.stride_tricks.as_strided(x, (blocks, wide, dim), (block * x.strides[0], *x.strides))
        y_blocks = y.reshape(blocks, block, dim)
        pull = pair * (1 - _sigmoid(y_blocks @ x_blocks.transpose(0, 2, 1)))
        to_y, n_y = (pull @ x_blocks).reshape(chunk, dim), pair.sum(axis=2).ravel()
        to_x = _laid(pull.transpose(0, 2, 1) @ y_blocks, block)[: len(at)]
        n_x = _laid(pair.sum(axis=1)[:, :, None], block)[: len(at), 0]
        drawn = np.searchsorted(noise, draw.random(DRAWN) * noise[-1], side="right").clip(max=len(first) - 1)
        away = second[drawn]
        weight = n_x * np.float32(NEGATIVE / DRAWN)
        push = -weight[:, None] * _sigmoid(x @ away.T)
        to_x += push @ away
        _add_rows(first, at, to_x, n_x, rate)
        _add_rows(second, np.concatenate((centre, drawn)), np.concatenate((to_y, push.T @ x)),
                  np.concatenate((n_y, np.full(DRAWN, weight.sum(), np.float32))), rate)


def _laid(parts: np.ndarray, block: int) -> np.ndarray:
    """Overlapping parts, each ``block`` rows after the one before, added up."""
    out = np.zeros((len(parts) + 1, block, parts.shape[2]), np.float32)
    out[:-1] = parts[:, :block]
    out[1:, : parts.shape[1] - block] += parts[:, block:]
    return out.reshape(-1, parts.shape[2])


def _numbered(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """A partition is a group of shards: its texts as numbers of its words, a row per batch and shard, and its words, 10,000 a row.

    ``few`` are the numbers of words that the group alone has fewer than ``min_count`` times.
    """
    from pyspark import TaskContext

    group = TaskContext.get().partitionId()
    held = [(batch.column("shard").to_numpy(), batch.column("tokens")) for batch in batches if batch.num_rows]
    if not held:
        return
    coded = pa.chunked_array([lists.flatten() for _, lists in held], pa.string()).dictionary_encode().unify_dictionaries()
    words = coded.chunk(0).dictionary
    seen = np.zeros(len(words), np.int64)
    for order, ((shards, lists), codes) in enumerate(zip(held, coded.chunks, strict=True)):
        ids = codes.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        seen += np.bincount(ids, minlength=len(words))
        # a null list is without words
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        for shard in np.unique(shards):
            mine = shards == shard
            of = ids[np.repeat(mine, sizes)] if not mine.all() else ids
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((group, pa.int32()), (int(shard), pa.int32()), (order, pa.int32()), (packed(sizes[mine]), pa.binary()), (packed(of), pa.binary()))]
                + [pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.list_(pa.int32()))], schema=NUMBERED)
    for lo in range(0, len(words), 10_000):
        part = words.slice(lo, 10_000)
        few = (lo + np.flatnonzero(seen[lo : lo + 10_000] < min_count)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([group], pa.int32()), pa.nulls(1, pa.int32()), pa.array([lo], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
             pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.ListArray.from_arrays(pa.array([0, len(few)], pa.int32()), pa.array(few))], schema=NUMBERED)


NUMBERED = pa.schema([
    ("of", pa.int32()), ("shard", pa.int32()), ("at", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary()),
    ("words", pa.list_(pa.string())), ("few", pa.list_(pa.int32()))])
NUMBERED_ROWS = "of int, shard int, at int, sizes binary, ids binary, words array<string>, few array<int>"


def skip_gram(df: DataFrame, words: Column, dim: int, window: int, min_count: int, seed: int, iterations: int, partitions: int) -> DataFrame:
    """(word, vec array<double>) of every word that occurs ``min_count`` times; rarer ones are left out before pairs are made.

    Texts are dealt over ``partitions`` shards, or more where a shard would have over SHARD_WORDS words. A shard holds its
    own words only; after each pass a word's vectors are averaged over shards, by its occurrences. Where there are many shards
    a task trains a group of them, each from the same vectors, and adds their vectors up before any moves. Numbers move as
    packed blocks, and a word is looked up in the whole only if its group has it too seldom. No vocabulary and no
    vector passes the driver. A null text has no words. Equal texts may lie in different shards, so one text that
    repeats makes no crowded shard.
    """
    texts = cut_lineage(df.select(words.alias("tokens")), "tokens")
    counted = cut_lineage(texts.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    shards = max(partitions, -(-total // SHARD_WORDS))
    together = max(1, min(GROUP_SHARDS, GROUP_WIDTH // dim, shards // partitions))
    order = F.xxhash64("tokens")
    dealt = texts.repartition(shards).sortWithinPartitions(order).select(F.spark_partition_id().alias("shard"), "tokens")
    if together > 1:
        dealt = dealt.coalesce(-(-shards // together))
    numbered = cut_lineage(dealt.mapInArrow(lambda batches: _numbered(batches, min_count), NUMBERED_ROWS), "shards")
    drop_table(texts)
    drop_shuffles(df.sparkSession)
    spelled = numbered.where("words IS NOT NULL")
    n_rows = spelled.agg(F.sum(F.size("words"))).first()[0] or 0
    rare = counted.where(F.col("n") < min_count).select("word")
    seldom = spelled.select("of", "at", "words", F.explode("few").alias("id")).select("of", "id", F.get("words", F.col("id") - F.col("at")).alias("word"))
    dropped = seldom.join(rare, "word", "left_semi").select(F.col("of").alias("__of"), "id", F.lit(None).cast("array<float>").alias("vec"))
    vectors = None
    for i in range(iterations):
        last = i == iterations - 1
        if vectors is None:
            known = dropped
            lines = numbered.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w, F.lit(seed))))
        else:
            named = spelled.select("of", "at", F.posexplode("words").alias("k", "word"))
            known = named.join(vectors, "word").select(F.col("of").alias("__of"), (F.col("at") + F.col("k")).alias("id"), "vec")
            lines = numbered.withColumn("hashes", F.lit(None).cast("array<long>"))
        begun, seeds, done, share = vectors is not None, [seed, i], i / iterations, 1 / iterations

        def train(rows: pa.Table, known: pa.Table) -> pa.Table:
            spelled = rows.filter(pc.is_valid(rows["words"])).sort_by("at")
            words = spelled["words"].combine_chunks().flatten()
            hashes = spelled["hashes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            named = known["id"].to_numpy()
            keep = np.zeros(len(words), bool)
            keep[named] = True
            if begun:
                row = np.zeros(len(words), np.int64)
                row[named] = np.arange(len(named))
                vec = list_matrix(known["vec"])
            else:
                keep = ~keep
            place = np.cumsum(keep) - 1
            width = dim if last else 2 * dim
            n, sums = np.zeros(int(keep.sum())), np.zeros((int(keep.sum()), width), np.float32)
            blocks = rows.filter(pc.is_valid(rows["shard"])).sort_by([("shard", "ascending"), ("at", "ascending")])
            whose = blocks["shard"].to_numpy()
            for shard in np.unique(whose):
                mine = blocks.filter(pa.array(whose == shard))
                sizes = np.concatenate([unpacked(b.as_py(), np.int32) for b in mine["sizes"]])
                ids = np.concatenate([unpacked(b.as_py(), np.int32) for b in mine["ids"]])
                text = np.repeat(np.arange(len(sizes)), sizes)
                text, ids = text[keep[ids]], ids[keep[ids]]
                if not len(ids):
                    continue
                # words in the order of the shard, so that its noise words are the same in any group
                own, begins, at = np.unique(ids, return_index=True, return_inverse=True)
                order = np.argsort(begins)
                own, at = own[order], np.argsort(order)[at]
                if begun:
                    first, second = (np.ascontiguousarray(half) for half in np.hsplit(vec[row[own]], 2))
                else:
                    first = _first_vectors(hashes[own], dim)
                    second = np.zeros_like(first)
                train_shard(at, text, first, second, window, [*seeds, int(shard)], done, share)
                many = np.bincount(at, minlength=len(own)).astype(np.float64)
                n[place[own]] += many
                sums[place[own]] += (first if last else np.hstack([first, second])) * many[:, None].astype(np.float32)
            return pa.table({"word": words.filter(pa.array(keep)), "n": n, "vec": matrix_lists(sums)})

        passed = lines.drop("few").groupBy("of").cogroup(known.groupBy("__of")).applyInArrow(train, "word string, n double, vec array<float>")
        vectors = weighted_means(passed, "word", n_rows, "double" if last else "float").select("word", "vec")
        if not last:
            vectors = cut_lineage(vectors, "vectors")
            drop_shuffles(df.sparkSession)
    return vectors
