"""Repeated word windows across a corpus, found level by level with windows of doubled length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import BROADCAST_ROWS, arrow_rows, keep_ids, row_key
from lexiloom.operators.joins import HOT_SHARE, spread_join
from lexiloom.session import cut_lineage

WIDTH = 35
BATCH = 500  # texts in memory at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(32)

ANCHOR_SCHEMA = "doc bigint, id bigint, key bigint, n_words int, whole string, places array<int>, h array<bigint>, after array<bigint>, before array<bigint>"
SPAN_SCHEMA = "id bigint, key bigint, n bigint, start int, h bigint, g bigint, windows array<bigint>"
KEPT_SCHEMA = "id bigint, key bigint, n_words bigint, n_removed bigint, kept_sha256 string"
ROW = ["id", "key"]


def levels(width: int) -> tuple[int, int]:
    """Lengths of the two levels below ``width``: a quarter of it, and twice that."""
    first = -(-width // 4)
    return first, min(2 * first, width)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows made of two windows."""
    out = (left ^ (left >> SHIFT)) * MIX + right
    return (out ^ (out >> SHIFT)) * MIX


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, from windows of doubled lengths; the last doubling overlaps."""
    out, size = words, 1
    while size < length:
        step = min(size, length - size)
        out = _joined(out[: len(out) - step], out[step:])
        size += step
    return out


def _extended(hashes: np.ndarray, by: int) -> np.ndarray:
    return _joined(hashes[: max(0, len(hashes) - by)], hashes[by:])


def lowest(values: np.ndarray, reach: int) -> np.ndarray:
    """For each stretch of ``reach`` values the place of the smallest, the first of equal ones."""
    places, size = np.arange(len(values)), 1
    while size < reach:
        step = min(size, reach - size)
        a, b = places[: len(places) - step], places[step:]
        places = np.where(values[a] <= values[b], a, b)
        size += step
    return places


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _level_one(width: int):
    first, second = levels(width)

    def anchors(words: np.ndarray):
        """Places of the anchors of all windows, and the hashes of the first and second level at them."""
        if len(words) < width:
            return (np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 3)
        short = window_hashes(words, first)
        places = np.unique(lowest(short, width - first + 1))
        long = _extended(short, second - first)
        # the longer window that begins at the anchor's, and the one that ends with it
        after = long[np.minimum(places, len(long) - 1)]
        before = long[np.maximum(places - (second - first), 0)]
        return places.astype(np.int32), *(x.view(np.int64) for x in (short[places], after, before))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            counts, digests, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(anchors(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))))
            places, *hashes = ([f[i] for f in found] for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc", *ROW)), pa.array(counts, pa.int32()), pa.array(digests), _lists(places, pa.int32()), *[_lists(h, pa.int64()) for h in hashes]],
                names=["doc", "id", "key", "n_words", "whole", "places", "h", "after", "before"])

    return work


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind))


def _level_three(width: int):
    """Windows of the full width around anchors whose windows of the second level are repeated."""
    first, second = levels(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*ROW, "n", "start", "h", "g", "windows"]
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            columns: list[list] = [[] for _ in names]
            for id_, key, n, text, alive in arrow_rows([batch], *ROW, "n", "text", "alive"):
                words = word_hashes(text)
                short = window_hashes(words, first)
                long, owner = _extended(short, second - first), lowest(short, width - first + 1)
                whole = window_hashes(words, width).view(np.int64)
                place, side = np.divmod(np.sort(np.array(alive, np.int64)), 2)
                low, high = np.searchsorted(owner, place), np.searchsorted(owner, place, "right")
                # windows in which the second level's window fits behind the anchor, or else before it
                turn = np.clip(place - (width - second), low, high)
                low, high = np.where(side == 0, turn, low), np.where(side == 0, high, turn)
                h = long[np.where(side == 0, np.minimum(place, len(long) - 1), np.maximum(place - (second - first), 0))].view(np.int64)
                for i in np.flatnonzero(low < high):
                    around = whole[low[i] : high[i]]
                    for column, value in zip(columns, (id_, key, n, low[i], h[i], xxhash.xxh3_64_intdigest(around.tobytes()) - (1 << 63), around), strict=True):
                        column.append(value)
            if columns[0]:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:6], kinds), _lists(columns[6], pa.int64())], names=names)

    return work


def _without(width: int):
    """What is left of texts after the words under repeated windows are gone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            rows: list[tuple] = []
            for id_, key, text, spans in arrow_rows([batch], *ROW, "text", "spans"):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int32)
                runs = np.array(spans, np.int64)
                np.add.at(edge, runs >> 32, 1)
                np.add.at(edge, (runs & 0xFFFFFFFF) + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                rows.append((id_, key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "key", "n_words", "n_removed", "kept_sha256"])

    return work


def _held_often(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys that stand for several copies (``n`` in each row), and those of them with many rows."""
    counts = cut_lineage(rows.groupBy(*keys).agg(F.sum("n").alias("__all"), F.count(F.lit(1)).alias("__rows")).where("__all > 1"), "repeated")
    total = counts.agg(F.sum("__rows")).first()[0] or 0
    hot = counts.where(F.col("__rows") * HOT_SHARE > total).select(*keys, F.lit(True).alias("__hot"))
    return counts.select(*keys), hot


def _repeated(rows: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
    """Rows whose key is held by more than one."""
    often, hot = _held_often(rows, keys)
    return spread_join(rows, often, keys, spread_by=spread_by, hot=hot)


def repeated_windows(texts: DataFrame, first: DataFrame, width: int) -> DataFrame:
    """(id, key, spans): of each text with repeated windows, from where to where they begin, as two halves of a long."""
    # level one: anchors' short windows; level two: the repeated ones alone, at twice the length
    at = first.select(*ROW, "n", F.explode(F.arrays_zip("places", "h", "after", "before")).alias("a"))
    at = at.select(*ROW, "n", F.col("a.places").alias("place"), F.col("a.h").alias("h"), F.col("a.after").alias("after"), F.col("a.before").alias("before"))
    alive = _repeated(at, ["h"], [*ROW, "place"])
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("after").alias("h")), F.struct(F.lit(1).alias("side"), F.col("before").alias("h")))
    longer = cut_lineage(alive.select(*ROW, "n", "place", F.explode(sides).alias("s")).select(*ROW, "n", "place", "s.side", "s.h"), "alive")
    longer = _repeated(longer, ["h", "side"], [*ROW, "place"])
    # one list a text, no longer than the text
    wanted = cut_lineage(longer.groupBy(*ROW, "n").agg(F.collect_list(F.col("place") * 2 + F.col("side")).alias("alive")), "wanted")

    # level three: windows of the full width around what is left
    spans = cut_lineage(_with(texts, wanted).mapInArrow(_level_three(width), SPAN_SCHEMA), "spans")
    # copies have the same spans: their windows are compared once, with the number of copies
    kinds = cut_lineage(spans.groupBy("h", "g").agg(F.sum("n").alias("n"), F.first("windows").alias("windows")), "kinds")
    several, hot = _held_often(kinds.select("h", F.lit(1).alias("n")), ["h"])
    kinds = cut_lineage(spread_join(kinds, several.withColumn("several", F.lit(True)), ["h"], "left", ["g"], hot=hot), "compared")
    # where all copies have one span, all its windows are repeated or none is
    alone = kinds.where("several IS NULL AND n > 1").select("h", "g", F.array(F.lit(0), F.size("windows") - 1).alias("hits"))
    each = kinds.where("several").select("h", "g", "n", F.posexplode("windows").alias("step", "window"))
    each = _repeated(each, ["h", "window"], ["g", "step"]).groupBy("h", "g").agg(F.min("step").alias("a"), F.max("step").alias("b"), F.collect_list("step").alias("steps"))
    run = F.when(F.size("steps") == F.col("b") - F.col("a") + 1, F.array("a", "b")).otherwise(F.flatten(F.transform("steps", lambda s: F.array(s, s))))
    hits = cut_lineage(alone.unionByName(each.select("h", "g", run.alias("hits"))), "hits")
    placed = spread_join(spans.select(*ROW, "start", "h", "g"), hits, ["h", "g"], spread_by=[*ROW, "start"])
    start = F.col("start").cast("bigint")
    edge = lambda i: start + F.get("hits", i)
    runs = F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.shiftleft(edge(i), 32) + edge(i + 1))
    return cut_lineage(placed.select(*ROW, F.explode(runs).alias("run")).groupBy(*ROW).agg(F.collect_list("run").alias("spans")), "repeats")


def _with(texts: DataFrame, more: DataFrame) -> DataFrame:
    """Texts that have a row in ``more``, with its columns; while the ids can be broadcast, no others are moved."""
    ids = cut_lineage(more.select("id").distinct(), "ids")
    n = ids.count()
    return (keep_ids(texts, "id", ids, n) if n <= BROADCAST_ROWS else texts).join(more, ROW)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): texts without the words of repeated windows.

    Words stand between ASCII white space. A window is ``width`` words running of one text; a word goes if it
    lies in a window whose words begin anywhere else too, in the same text or in another. Windows are judged on the
    texts as given. The digest is of the kept words joined by a space.

    Method. (1) Of the windows of a quarter of the width in each full window, the one with the smallest hash is its
    anchor, so equal windows have equal anchors, and about one word in fourteen is the place of one. Anchors whose short
    window is found once in the corpus are out. (2) The others alone are extended to twice the length, behind and before
    the anchor, and what is then found once is out. (3) What survives is doubled again, to the full width: the windows
    around an anchor in which the window of level two lies are compared. The levels end at the full width, or when no
    candidates survive. Windows count as equal by two 64-bit hashes, of the full window and of the one on level two.

    Cases. Null and empty texts have no words. Repeated rows are texts like any other: of ``width`` words or more
    all go. Null ids are ids like any other. An empty table gives an empty one. Other columns are not read.
    """
    if width < 2:
        raise ValueError("width must be 2 at least")
    doc = F.col(f"`{id_col}`").cast("bigint")
    texts = docs.select(
        doc.alias("doc"), F.coalesce(doc, F.lit(-1)).alias("id"), row_key(id_col, text_col).alias("key"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    rows = cut_lineage(texts.mapInArrow(_level_one(width), ANCHOR_SCHEMA), "anchors")
    # rows that repeat others are looked at once, as so many copies
    copies = cut_lineage(rows.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    first = rows.withColumn("n", F.lit(1).cast("bigint"))
    texts = texts.drop("doc")
    if not copies.isEmpty():
        again = rows.join(copies, ROW).dropDuplicates(ROW).select(*first.columns)
        first = first.join(copies, ROW, "left_anti").unionByName(again)
        texts = texts.join(copies, ROW, "left_anti").unionByName(texts.join(copies.select(*ROW), ROW).dropDuplicates(ROW))
    spans = repeated_windows(texts, first, width)
    left = _with(texts, spans).mapInArrow(_without(width), KEPT_SCHEMA)
    out = rows.select("doc", *ROW, "n_words", "whole").join(left.drop("n_words"), ROW, "left")
    return out.select(
        F.col("doc").alias(id_col), F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
