"""Counting n-gram language model: counts, next tokens, blanks, perplexity, continuation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.joins import spread_join

BEGIN, END = "<s>", "</s>"


def _padded(tokens: Column, n: int) -> Column:
    return F.concat(F.array(*[F.lit(BEGIN)] * (n - 1)), tokens, F.array(F.lit(END)))


# Fixed value: tokens whose n-grams are counted at once; a longer row is counted alone.
COUNTED_AT_ONCE = 1 << 20


def _slice_counts(lists: pa.ListArray, n: int) -> pa.RecordBatch:
    """The distinct n-grams inside the rows of ``lists``, a column a place, and their counts.

    An n-gram is a number with its tokens' codes as digits; numbers about to grow over 63 bits are replaced by their ranks.
    """
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(np.arange(len(codes)) + n <= np.repeat(np.cumsum(size), size))
    base = bound = max(1, len(coded.dictionary))
    gram = codes[at]
    for k in range(1, n):
        if bound * base >= 1 << 63:
            ranks, gram = np.unique(gram, return_inverse=True)
            bound = len(ranks)
        gram, bound = gram * base + codes[at + k], bound * base
    _, first, counts = np.unique(gram, return_index=True, return_counts=True)
    places = [coded.dictionary.take(pa.array(codes[at[first] + k])) for k in range(n)]
    return pa.RecordBatch.from_arrays([*places, pa.array(counts.astype(np.int64))], names=[*(f"g{k}" for k in range(n)), "n"])


def _slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows in slices of about COUNTED_AT_ONCE tokens."""
    long = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(long) - long) // COUNTED_AT_ONCE
    borders = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(lists)]
    for i, j in zip(borders, borders[1:]):
        if i < j:
            yield lists.slice(i, j - i)


def _gram_counts(df: DataFrame, padded: Column, n: int) -> DataFrame:
    """(g0, g1, ..., n): n-grams inside the rows' token arrays, counted in slices of a batch of rows; sums are left to the caller."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in _slices(batch.column(0)):
                yield _slice_counts(lists, n)

    return df.select(padded.alias("__p")).mapInArrow(count, ", ".join(f"g{k} string" for k in range(n)) + ", n long")


def ngram_model(df: DataFrame, tokens: Column, n: int = 2) -> DataFrame:
    """(context, next, n): counts of each token after the n-1 before it."""
    if n < 2:
        raise ValueError("n must be at least 2")
    grams = _gram_counts(df, _padded(tokens, n), n)
    context = F.concat_ws(" ", *[F.col(f"g{k}") for k in range(n - 1)])
    return grams.select(context.alias("context"), F.col(f"g{n - 1}").alias("next"), "n").groupBy("context", "next").agg(F.sum("n").alias("n"))


def commonest_next(model: DataFrame, k: int = 5) -> DataFrame:
    """(context, next, n, rank): the k commonest next tokens of every context."""
    best = Window.partitionBy("context").orderBy(F.desc("n"), "next")
    return model.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_next(model: DataFrame, k: int = 5) -> DataFrame:
    """(context, rank, next, n, p): the k likeliest next tokens of every context."""
    top = commonest_next(model, k)
    totals = model.groupBy("context").agg(F.sum("n").alias("__t"))
    return top.join(totals, "context").select("context", "rank", "next", "n", (F.col("n") / F.col("__t")).alias("p"))


def prompt_next(prompts: DataFrame, model: DataFrame, key: list[str], tokens: Column, n: int, k: int = 5) -> DataFrame:
    """Top next tokens of each prompt; a prompt whose context was never seen gets no row."""
    asked = prompts.select(*key, _context(tokens, n).alias("context"))
    lists = top_next(model, k).groupBy("context").agg(
        F.array_sort(F.collect_list(F.struct("rank", "next", "n", "p"))).alias("__top")
    )
    return spread_join(asked, lists, ["context"], spread_by=key).select(*key, "context", F.inline("__top"))


def _context(tokens: Column, n: int) -> Column:
    padded = F.concat(F.array(*[F.lit(BEGIN)] * (n - 1)), tokens)
    return F.array_join(F.slice(padded, F.lit(-(n - 1)), F.lit(n - 1)), " ")


# Fixed value: n-grams in a row of packed ones, few enough for words to be numbered by two bytes.
PACKED_AT_ONCE = 10_000
PACKED = "part int, words string, mark string, left array<short>, right array<short>, middle array<short>, n array<int>"


def _packed_blanks(counts: pa.RecordBatch, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from counted trigrams: those of a part, as numbers of their words.

    A part is chosen by a hash of both neighbours. Words stand in one string, apart by a mark that none of them holds.
    """
    if not counts.num_rows:
        return
    coded = pa.concat_arrays([counts.column(f"g{k}") for k in range(3)]).dictionary_encode(null_encoding="encode")
    left, middle, right = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(3, -1)
    names = np.array(coded.dictionary.to_pylist(), object)
    of = hash_array(names, categorize=False)
    part = ((of[left] * np.uint64(31) + of[right]) >> np.uint64(32)) % np.uint64(parts)
    n = counts.column("n").to_numpy()
    order = np.lexsort((right, left, part))
    for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        for some in np.array_split(mine, -(-len(mine) // PACKED_AT_ONCE)):
            held, at = np.unique(np.concatenate([side[some] for side in (left, right, middle)]), return_inverse=True)
            words = names[held]
            # a missing word has no number
            known = np.array([w is not None for w in words])
            number = np.where(known, np.cumsum(known) - 1, -1).astype(np.int16)[at].reshape(3, -1)
            text = "".join(words[known])
            mark = next(c for c in map(chr, range(1, 0xD800)) if c not in text)
            # counts beyond four bytes stand in several items
            times = n[some]
            while len(times):
                now = np.minimum(times, (1 << 31) - 1)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(now)], pa.int32()), pa.array(x)) for x in (*number, now.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[some[0]])], pa.int32()), pa.array([mark.join(words[known])], pa.string()), pa.array([mark], pa.string()), *lists],
                    names=["part", "words", "mark", "left", "right", "middle", "n"])
                more = times > now
                times, number = (times - now)[more], number[:, more]


def blank_model(df: DataFrame, tokens: Column) -> DataFrame:
    """(left, right, middle, n, part): counts of each token between its two neighbours.

    What moves is packed, once; ``part`` is a hash of both neighbours by which the rows already lie together.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lists in _slices(batch.column(0)):
                more = len(lists.flatten())
                if held and size + more > COUNTED_AT_ONCE:
                    yield from _packed_blanks(_slice_counts(pa.concat_arrays(held), 3), parts)
                    held, size = [], 0
                held.append(lists)
                size += more
        if held:
            yield from _packed_blanks(_slice_counts(pa.concat_arrays(held), 3), parts)

    padded = F.concat(F.array(F.lit(BEGIN)), tokens, F.array(F.lit(END)))
    blocks = df.select(padded.alias("__p")).mapInArrow(pack, PACKED).repartitionById(parts, F.col("part"))
    named = blocks.withColumn("words", F.split("words", F.concat(F.lit("\\Q"), "mark", F.lit("\\E")), F.lit(-1)))
    items = named.select("part", "words", F.inline(F.arrays_zip(*(F.col(c).alias(c) for c in ("left", "right", "middle", "n")))))
    word = lambda side: F.get("words", F.col(side).cast("int")).alias(side)
    grams = items.select("part", word("left"), word("right"), word("middle"), "n")
    return grams.groupBy("part", "left", "right", "middle").agg(F.sum("n").alias("n")).select("left", "right", "middle", "n", "part")


def fill_mask(model: DataFrame, k: int = 5) -> DataFrame:
    """(left, right, rank, middle, n, p): the k likeliest fillers of every blank."""
    # rows of a blank are not moved again if the model names the part they lie in
    best = Window.partitionBy(*[c for c in ("part", "left", "right") if c in model.columns]).orderBy(F.desc("n"), "middle")
    total = F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = model.withColumn("rank", F.row_number().over(best)).withColumn("__t", total).where(F.col("rank") <= k)
    return top.where("left IS NOT NULL AND right IS NOT NULL").select("left", "right", "rank", "middle", "n", (F.col("n") / F.col("__t")).alias("p"))


def perplexity(model: DataFrame, test: DataFrame, tokens: Column, n: int = 2, alpha: float = 1.0) -> DataFrame:
    """One row (events, perplexity, uniform, ratio): add-alpha, weighted by token.

    Held-out events are counted first, so each distinct event meets the model
    once, however frequent. The vocabulary is the model's next tokens and one
    unknown.
    """
    events = ngram_model(test, tokens, n).withColumnRenamed("n", "__c")
    totals = model.groupBy("context").agg(F.sum("n").alias("__t"))
    size = model.agg(F.countDistinct("next") + 1).scalar()
    known = events.join(model, ["context", "next"], "left")
    seen = spread_join(known, totals, ["context"], "left", spread_by=["next"]).withColumn("__v", size)
    p = (F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("__t", F.lit(0)) + alpha * F.col("__v"))
    out = seen.agg(
        F.sum("__c").alias("events"),
        F.exp(-F.sum(F.col("__c") * F.log(p)) / F.sum("__c")).alias("perplexity"),
        F.max("__v").cast("double").alias("uniform"),
    )
    return out.withColumn("ratio", F.col("perplexity") / F.col("uniform"))


def continue_text(model: DataFrame, prompts: DataFrame, key: list[str], tokens: Column, n: int = 2, steps: int = 20) -> DataFrame:
    """(key, continuation): likeliest next token, again and again, until the end token or ``steps``.

    The continuation depends on the context alone, so each distinct context is
    continued once; prompts fetch the result at the end.
    """
    best = model.groupBy("context").agg(
        F.min_by("next", F.struct((-F.col("n")).alias("a"), F.col("next").alias("b"))).alias("__next")
    )
    asked = prompts.select(*key, _context(tokens, n).alias("__start"))
    state = asked.select("__start").distinct().select(
        "__start", F.col("__start").alias("context"), F.array().cast("array<string>").alias("__out"), F.lit(False).alias("__done")
    )
    for _ in range(steps):
        step = state.join(best, "context", "left")
        stop = F.col("__done") | F.col("__next").isNull() | (F.col("__next") == END)
        moved = F.array_join(F.slice(F.concat(F.split("context", " "), F.array("__next")), F.lit(-(n - 1)), F.lit(n - 1)), " ")
        state = step.select(
            "__start",
            F.when(stop, F.col("context")).otherwise(moved).alias("context"),
            F.when(stop, F.col("__out")).otherwise(F.concat("__out", F.array("__next"))).alias("__out"),
            stop.alias("__done"),
        )
    done = state.select("__start", F.array_join("__out", " ").alias("continuation"))
    return spread_join(asked, done, ["__start"], spread_by=key).select(*key, "continuation")
