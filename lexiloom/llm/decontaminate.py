"""Benchmark passages in training texts, found through a positional inverted index."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import arrow_rows, row_key
from lexiloom.session import cut_lineage

# Words are runs of a-z, 0-9 and everything beyond ASCII; A-Z count as a-z. On UTF-8 bytes
# that is: every other byte becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENT_BYTES = 2 << 20  # text in one segment of the index, or one longer text
GAP = 64  # unused positions between two texts of a segment, so that no phrase spans them
BLOCK_ITEMS = 20_000  # benchmark items sent to the tasks at a time

INDEX_SCHEMA = "segment string, ids array<bigint>, keys array<bigint>, sizes array<int>, terms binary, counts binary, postings binary"
MATCH_SCHEMA = "segment string, ord int, id bigint, key bigint, n_words bigint, hits array<struct<start:int,end:int>>, items array<bigint>, near bigint"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all texts, a written table of segments.

    A segment holds the postings of some whole texts: every term with the ascending
    positions at which it stands, texts being laid end to end with a gap. Each text is
    in one segment, so phrases are matched without moving postings between tasks.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), row_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    return cut_lineage(rows.mapInArrow(_segments, INDEX_SCHEMA), "postings")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, nth, held, pending = TaskContext.get().partitionId(), itertools.count(), 0, []
    numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
    for id_, key, text in arrow_rows(batches, "id", "key", "text"):
        # a segment keeps its words as numbers, so that only one text's are held as strings
        words = words_of(text)
        pending.append((id_, key, np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))))
        held += len(text or "")
        if held >= SEGMENT_BYTES or len(pending) >= 50_000:
            yield _segment(f"{part}-{next(nth)}", pending, numbers)
            held, pending, numbers = 0, [], defaultdict(itertools.count().__next__)
    if pending:
        yield _segment(f"{part}-{next(nth)}", pending, numbers)


def _segment(name: str, texts: list, numbers: dict[bytes, int]) -> pa.RecordBatch:
    sizes = np.array([len(words) for _, _, words in texts], dtype=np.int32)
    stream = np.concatenate([w for _, _, w in texts])
    starts = _starts(sizes)
    position = (np.repeat((starts - np.concatenate(([0], np.cumsum(sizes)[:-1]))).astype(np.int32), sizes) + np.arange(len(stream), dtype=np.int32)).astype(np.int32)
    by_term = np.argsort(stream, kind="stable")
    postings = position[by_term]
    steps = np.diff(postings, prepend=np.int32(0)).astype(np.int32)
    pack = zstandard.ZstdCompressor(level=1).compress
    counts = np.bincount(stream, minlength=len(numbers)).astype(np.int32)
    # byte planes: the upper bytes of steps are nearly all zero
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return pa.RecordBatch.from_pydict({
        "segment": [name], "ids": pa.array([[t[0] for t in texts]], pa.list_(pa.int64())), "keys": pa.array([[t[1] for t in texts]], pa.list_(pa.int64())),
        "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())), "terms": [pack(b" ".join(numbers))],
        "counts": [pack(counts.tobytes())], "postings": [pack(planes.tobytes())]})


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Position of each text's first word in its segment."""
    return np.concatenate(([0], np.cumsum(sizes.astype(np.int64) + GAP)[:-1])) if len(sizes) else np.zeros(0, np.int64)


class _Block:
    """Windows of some benchmark items, as numbers into their vocabulary."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        windows: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [numbers[w] for w in words_of(text)]
            size = min(width, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                windows[size][tuple(ids[i : i + size])].add(item)
        self.terms = list(numbers)
        self.by_size = [(np.array(list(w), dtype=np.int32), [sorted(i for i in s if i is not None) for s in w.values()]) for _, w in sorted(windows.items())]


def find_passages(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10, slop: int = 0) -> DataFrame:
    """One row per indexed text: (segment, ord, id, key, n_words, hits, items, near).

    A window is ``width`` consecutive words of a benchmark item, or all of a shorter one.
    ``hits`` are the (start, end) word runs of the text inside exact occurrences, ``items``
    the sorted items with a window there, ``near`` counts proximity matches that are not
    exact: every word of the window within ``slop`` of its place in the phrase.
    In each segment windows with an absent term are dropped at once; the others start
    from the postings of their rarest term, shifted by its offset, and are cut down by
    the shifted postings of the next rarest until nothing or all terms agree.

    Items are read in blocks of BLOCK_ITEMS, each matched against the whole index.
    Cases. Null and wordless items have no window; null item ids hit but are not named;
    items with one id add up. An empty benchmark hits nothing, an empty index gives no rows.
    """
    if not 0 <= slop < GAP - width:
        raise ValueError("slop and width must fit into the gap between texts")
    spark = index.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("item"), F.col(f"`{text_col}`").alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        sent = spark.sparkContext.broadcast(_Block([(r["item"], r["text"]) for r in rows], width))
        found.append(index.mapInArrow(_searcher(sent, slop), MATCH_SCHEMA))
    if blocks == 1:
        return found[0]
    union = found[0]
    for more in found[1:]:
        union = union.unionAll(more)
    runs = F.array_sort(F.flatten(F.collect_list("hits")))
    return union.groupBy("segment", "ord", "id", "key", "n_words").agg(
        _merged(runs).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum("near").alias("near"))


def _merged(runs: Column) -> Column:
    """Sorted runs with overlaps cut off, so that their lengths add up."""
    kind = "struct<end:int,out:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(kind)
    step = lambda s, r: F.when(r["end"] <= s["end"], s).otherwise(F.struct(
        r["end"].alias("end"), F.concat(s["out"], F.array(F.struct(F.greatest(r["start"], s["end"]).alias("start"), r["end"].alias("end")))).alias("out")))
    return F.aggregate(runs, zero, step, lambda s: s["out"])


def _searcher(sent, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _search_segment(*(batch.column(c)[i].as_py() for c in ("segment", "ids", "keys", "sizes", "terms", "counts", "postings")), sent.value, slop)

    return search


def _holds(sorted_values: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which wanted positions have a value within slop."""
    at = np.searchsorted(sorted_values, wanted - slop)
    near = sorted_values[np.minimum(at, len(sorted_values) - 1)]
    return (at < len(sorted_values)) & (near <= wanted + slop)


def _search_segment(name, ids, keys, sizes, terms, counts, postings, block: _Block, slop: int) -> pa.RecordBatch:
    unpack = zstandard.ZstdDecompressor().decompress
    sizes = np.array(sizes, dtype=np.int32)
    counts = np.frombuffer(unpack(counts), dtype=np.int32)
    planes = np.frombuffer(unpack(postings), dtype=np.uint8).reshape(4, -1)
    # steps run on across terms, so one sum gives back all positions
    positions = np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)
    first = np.concatenate(([0], np.cumsum(counts)))
    starts = _starts(sizes)
    here = {t: i for i, t in enumerate(unpack(terms).split(b" "))} if len(counts) else {}
    local = np.array([here.get(t, -1) for t in block.terms] or [-1], dtype=np.int64)

    hit_from, hit_to, items, near = [], [], defaultdict(set), np.zeros(len(sizes), dtype=np.int64)
    for windows, owners in block.by_size:
        placed = local[windows]
        size = windows.shape[1]
        for w in np.flatnonzero((placed >= 0).all(axis=1)):
            terms_here = placed[w]
            order = np.argsort(counts[terms_here], kind="stable")
            lists = [positions[first[terms_here[o]] : first[terms_here[o] + 1]] for o in order]
            begin = lists[0].astype(np.int64) - order[0]
            for o, held in zip(order[1:], lists[1:], strict=True):
                begin = begin[_holds(held, begin + o, slop)]
                if not len(begin):
                    break
            if not len(begin):
                continue
            exact = np.ones(len(begin), dtype=bool)
            if slop:
                for o, held in zip(order[1:], lists[1:], strict=True):
                    exact &= _holds(held, begin + o, 0)
            text = np.searchsorted(starts, begin + order[0], side="right") - 1
            np.add.at(near, text[~exact], 1)
            for t, s in zip(text[exact].tolist(), begin[exact].tolist(), strict=True):
                hit_from.append(s)
                hit_to.append(s + size)
                items[t].update(owners[w])

    hits: dict[int, list] = defaultdict(list)
    for s, e in _joined(sorted(zip(hit_from, hit_to, strict=True))):
        t = int(np.searchsorted(starts, s, side="right")) - 1
        hits[t].append({"start": int(s - starts[t]), "end": int(e - starts[t])})
    n = len(sizes)
    run = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes.astype(np.int64)),
         pa.array([hits.get(i, []) for i in range(n)], run), pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.int64())), pa.array(near)],
        names=["segment", "ord", "id", "key", "n_words", "hits", "items", "near"])


def _joined(runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    at = None
    for s, e in runs:
        if at and s <= at[1]:
            at = (at[0], max(at[1], e))
        else:
            if at:
                yield at
            at = (s, e)
    if at:
        yield at


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, slop: int = 1) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, key) of every text.

    Cases: a null or empty text has no words and no hits; null and repeated ids keep a row
    per text, told apart by ``key``; an empty table gives an empty one; other columns are not read.
    """
    found = find_passages(build_index(docs, id_col, text_col), benchmark, width=width, slop=slop)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + h["end"] - h["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.col("near").alias("n_near"), "key")
