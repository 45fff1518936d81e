"""How corpus filters interact, from sorted posting lists of the documents that fail each."""

from __future__ import annotations

import heapq
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MOST_UPPER = 200, 50, 3  # words; percent of words; percent of code points
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = re.compile(rb"[#$%&*|]")
BLOCK_ROWS = 1 << 16  # documents in one range of ids
BATCH = 500  # texts in memory at a time

FLAG_SCHEMA = "id bigint, part string, k1 bigint, k2 bigint, fails int"
POSTING_SCHEMA = "part string, documents bigint, ids array<bigint>, lists array<array<int>>, good array<int>, toxic array<int>"
SIZE_SCHEMA = "part string, mask int, size bigint, good bigint, toxic bigint"


def text_fails(text: bytes, n_chars: int) -> int:
    """The filters A to D that a text in UTF-8 fails, one bit each."""
    words = text.split()
    few = len(words) < MIN_WORDS
    same = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    upper = 100 * (len(text) - len(text.translate(None, UPPER))) > MOST_UPPER * n_chars
    return few | same << 1 | upper << 2 | (MARKS.search(text) is not None) << 3


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
        texts = batch.column(2)
        fails, keys = [], []
        for text, n in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), strict=True):
            fails.append(text_fails(text, n))
            keys.append(xxhash.xxh3_128_intdigest(text))
        half = lambda shift: pa.array([((k >> shift) & (1 << 64) - 1) - (1 << 63) for k in keys], pa.int64())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), half(64), half(0), pa.array(fails, pa.int32())], names=["id", "part", "k1", "k2", "fails"])


def failing_postings(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, documents, ids, lists, good, toxic): the posting lists, a row for each part in each range of ids.

    A range holds up to BLOCK_ROWS documents in the order of their ids. In a row, ``ids`` are
    the part's documents of the range; the five ``lists`` (filters A to E), ``good`` and ``toxic``
    hold, ascending, the places in ``ids`` of the documents that fail or bear the label.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = cut_lineage(rows.mapInArrow(_flags, FLAG_SCHEMA), "flags")
    # the first of each group of copies is looked up by its own id, so a large group meets nowhere
    first = rows.where("id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("at")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.withColumn("named", F.col("id").isNotNull()).withColumn("at", F.coalesce("id", "k1"))
    rows = rows.join(first.select("k1", "k2", F.col("id").alias("at"), "first", F.lit(True).alias("named")), ["k1", "k2", "at", "named"], "left")
    rows = rows.join(known.withColumn("named", F.lit(True)), ["at", "named"], "left")
    copied = F.col("named") & F.col("first").isNull()
    rows = rows.select(
        "id", "k1", "part", (F.col("fails") + F.when(copied, 16).otherwise(0)).alias("fails"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    rows = rows.repartitionByRange("id", "k1").sortWithinPartitions("id", "k1").drop("k1")
    return cut_lineage(rows.mapInArrow(_postings, POSTING_SCHEMA), "postings")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple] = {}
    size = 0

    def block():
        rows = [{"part": part, "documents": len(ids), "ids": ids, "lists": lists, "good": good, "toxic": toxic} for part, (ids, lists, good, toxic) in held.items()]
        # lists of a range may be long: a row at a time
        for row in rows:
            yield pa.RecordBatch.from_pylist([row], schema=_POSTINGS)

    for batch in batches:
        for id_, part, fails, good, toxic in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "fails", "good", "toxic")), strict=True):
            if part not in held:
                held[part] = ([], [[] for _ in FILTERS], [], [])
            ids, lists, is_good, is_toxic = held[part]
            place = len(ids)
            ids.append(id_)
            for bit, run in enumerate(lists):
                if fails >> bit & 1:
                    run.append(place)
            if good:
                is_good.append(place)
            if toxic:
                is_toxic.append(place)
            size += 1
            if size == BLOCK_ROWS:
                yield from block()
                held.clear()
                size = 0
    yield from block()


_INTS = pa.list_(pa.int32())
_POSTINGS = pa.schema([("part", pa.string()), ("documents", pa.int64()), ("ids", pa.list_(pa.int64())), ("lists", pa.list_(_INTS)), ("good", _INTS), ("toxic", _INTS)])


def gallop(run: list[int], at: int, target: int) -> int:
    """The first place after ``at`` whose entry is not below ``target``; the entry at ``at`` is below it."""
    step, n = 1, len(run)
    while at + step < n and run[at + step] < target:
        step *= 2
    return bisect_left(run, target, at + step // 2, min(n, at + step + 1))


def union(runs: list[list[int]]) -> list[int]:
    """Entries of any of several sorted lists, by a merge that copies whole stretches of one list."""
    heads = [(run[0], i, 0) for i, run in enumerate(runs) if run]
    heapq.heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        value, i, at = heads[0]
        run = runs[i]
        limit = min(h[0] for h in heads[1:3])
        # an entry that another list holds too is left to the last of them
        to = at + 1 if value == limit else gallop(run, at, limit)
        if value < limit:
            out.extend(run[at:to])
        if to < len(run):
            heapq.heapreplace(heads, (run[to], i, to))
        else:
            heapq.heappop(heads)
    for _, i, at in heads:
        out.extend(runs[i][at:])
    return out


def difference(run: list[int], others: list[int]) -> list[int]:
    """Entries of one sorted list that are not in another."""
    out: list[int] = []
    i = j = 0
    while i < len(run) and j < len(others):
        if run[i] < others[j]:
            to = gallop(run, i, others[j])
            out.extend(run[i:to])
            i = to
        elif run[i] > others[j]:
            j = gallop(others, j, run[i])
        else:
            i, j = i + 1, j + 1
    out.extend(run[i:])
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            out = [{"part": row["part"], "mask": 0, "size": row["documents"], "good": 0, "toxic": 0}]
            for mask in range(1, 1 << len(FILTERS)):
                failing = union([run for bit, run in enumerate(row["lists"]) if mask >> bit & 1])
                lost = {c: len(row[c]) - len(difference(row[c], failing)) for c in ("good", "toxic")}
                out.append({"part": row["part"], "mask": mask, "size": len(failing), **lost})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.string()), ("mask", pa.int32()), ("size", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())]))


def union_sizes(postings: DataFrame) -> DataFrame:
    """(part, mask, size, good, toxic): how many documents fail any filter of ``mask``, and how many of them
    bear each label; under mask 0, ``size`` counts all documents. Ranges are merged apart and summed."""
    sizes = postings.mapInArrow(_sizes, SIZE_SCHEMA)
    return sizes.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("size", "good", "toxic")])


def _mask(letters: Column) -> Column:
    return sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Filters on whole texts: A under 200 words; B under half of the words distinct; C more than 3 % of the code
    points in A-Z; D any of #$%&*|; E the text stands under a smaller id, removed or not. For each
    part and each order of the filters a row per step; a filter's ``shapley`` is its ``removed`` over all orders.

    Cases. Null texts are empty, null parts the empty string. Each row of ``docs`` is a document, repeated
    ones too. A null id is neither smaller nor larger than any, so it neither fails E nor makes others fail, and has no
    labels. A document bears a label if any row of ``labels`` with its id says 1; null ids and values say nothing. An
    empty table gives no rows. Other columns are not read.
    """
    sizes = union_sizes(failing_postings(docs, labels))
    counts = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("size", "good", "toxic"))))
    orders = ",".join(map("".join, itertools.permutations(FILTERS)))
    # 32 sizes a part, and 600 steps of a fixed list
    rows = sizes.groupBy("part").agg(counts.alias("counts")).select("part", "counts", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumns({"own": _mask(letter), "after": _mask(F.substring("filter_order", F.lit(1), F.col("step")))})
    rows = rows.withColumn("before", F.col("after") - F.col("own"))
    every = (1 << len(FILTERS)) - 1
    at = lambda mask, what: F.when(mask == 0, F.lit(0)).otherwise(F.col("counts")[mask][what])
    gained = lambda what: at(F.col("after"), what) - at(F.col("before"), what)
    rows = rows.select(
        "part", "filter_order", "step", "own", (F.col("counts")[F.lit(0)]["size"] - at(F.col("after"), "size")).alias("kept"), gained("size").alias("removed"),
        (at(F.col("own"), "size") - gained("size")).alias("redundant"),
        (F.col("counts")[F.lit(every)]["size"] - at(F.lit(every) - F.col("own"), "size")).alias("unique_fails"),
        gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
