"""Near-duplicates by bottom-k sketches of one hash function, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lexiloom.llm.common import keep_ids
from lexiloom.llm.components import connected_components
from lexiloom.operators.joins import spread_join
from lexiloom.session import cut_lineage

SKETCH = 32  # retained hash values
OVERLAP = 12  # retained values two sketches of a linked pair share at least
CROWD = 32  # members of a list up to which its components are compared pair by pair
BATCH = 1_000  # rows whose full sets are handed back at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``width`` consecutive words of a text in UTF-8.

    Words stand between ASCII white space, A-Z counting as a-z; fewer words are one shingle.
    """
    words = text.translate(LOWER_BYTES).split() if text else ()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    starts = max(1, len(words) - width + 1) if len(words) else 0
    chain = hashes[:starts]
    for j in range(1, min(width, len(words))):
        chain = (chain ^ (chain >> np.uint64(29))) * MIX + hashes[j : j + starts]
    return np.unique((chain ^ (chain >> np.uint64(32))).view(np.int64))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of rows (id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                yield _set_batch(part.column(0), [shingles(t, width) for t in part.column(1).to_pylist()])

    id_type = docs.schema["id"].dataType
    schema = StructType([StructField("id", id_type), StructField("shingles", ArrayType(LongType()))])
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(sets, schema)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _set_batch(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, _lists(sets)], names=["id", "shingles"])


def shingle_sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, k1, k2, sketch) of rows (id, text): the set's size, 128 bits of hash and smallest values."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            k1, k2 = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(k1), pa.array(k2), _lists([s[:SKETCH] for s in sets])],
                names=["id", "n", "k1", "k2", "sketch"])

    rows = docs.select("id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sketches, "id bigint, n int, k1 bigint, k2 bigint, sketch array<bigint>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): classes of texts linked by Jaccard similarity.

    Texts are linked when 100 * intersection >= percent * union of their shingle sets;
    a component is all that links reach and is named by its smallest id, whose row is kept.

    Method. (1) Every set is sketched by its SKETCH smallest hash values; equal sets
    become one class. (2) Retained values have inverted lists. A class enters only the
    lists of its rarest values, as many as leave out fewer than the overlap that a
    linked pair has: exactly percent of the set where sketches hold whole sets, else
    OVERLAP of SKETCH, which a pair at 0.8 misses with a chance of 1e-7.
    (3) Each list compares its members with two of its own, the one with the most
    shared values and one by lot, so that a group of copies costs its size, not its
    square. (4) Lists that still hold several components compare across them. Lists of more
    than CROWD members do so through the rarest values of their members' full sets, where
    the places of a common value bound the overlap exactly: in a crowd of texts that are
    alike, but not enough, each begins with values of its own and meets no other. Near copies of
    one text, which share all but their changes, are compared by their changes against a leader.
    Rounds (3) and (4) estimate similarity on the union of the sketches, and every link is
    confirmed on the full sets.

    Cases. Null and empty texts have no shingles and are linked with nothing. Null ids
    are counted but linked with nothing and kept. Repeated rows share their class, so
    all rows of the smallest id are kept. An empty table gives an empty one. Other
    columns are not read.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches = cut_lineage(shingle_sketches(docs, width), "sketches")
    linkable = sketches.where("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(
        linkable.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    lists = cut_lineage(_inverted_lists(classes, percent), "lists")

    stars = _estimated(_star_pairs(lists, percent), classes, percent)
    links = _confirmed(stars, docs, width, percent)
    parts = connected_components(links)
    across, crowded = _across(lists, parts, percent)
    more = _confirmed(_estimated(across, classes, percent), docs, width, percent).unionByName(_crowded_links(crowded, docs, width, percent))
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))

    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = sketches.drop("sketch").join(named, ["n", "k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * F.lit(100) >= F.greatest(a, b) * F.lit(percent)


def _least_overlap(size: Column, whole: Column, percent: int) -> Column:
    """Values that the sketches of a linked pair share at least, out of ``size`` in a sketch."""
    return F.when(whole, F.ceil(size * percent / F.lit(100.0))).otherwise(F.least(F.lit(OVERLAP), F.ceil(size * F.lit(OVERLAP / SKETCH)))).cast("int")


def _inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n, weight): the lists, of two members at least, of every class's rarest values."""
    postings = classes.select("rep", "n", F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = (
        postings.join(common, "value", "left")
        .groupBy("rep", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "value"))).alias("values"))
    )
    # a partner of a set this small is itself held whole by its sketch
    whole = F.col("n") * F.lit(100) < SKETCH * percent
    front = F.size("values") - _least_overlap(F.size("values"), whole, percent) + 1
    rows = ranked.select(
        "rep", "n", F.aggregate("values", F.lit(0).cast("bigint"), lambda s, v: s + v["df"]).alias("weight"),
        F.explode(F.slice("values", F.lit(1), front)).alias("v")).where("v.df > 1")
    return rows.select(F.col("v.value").alias("value"), "rep", "n", "weight")


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each member of a list with the list's two leaders."""
    heads = lists.groupBy("value").agg(
        F.max(F.struct("weight", "rep", "n")).alias("most"), F.min(F.struct(F.xxhash64("value", "rep"), "rep", "n")).alias("lot"))
    heads = heads.select("value", F.explode(F.array(
        F.struct(F.col("most.rep").alias("head"), F.col("most.n").alias("head_n")),
        F.struct(F.col("lot.rep").alias("head"), F.col("lot.n").alias("head_n")))).alias("h")).select("value", "h.*").distinct()
    return (
        lists.join(heads, "value").where((F.col("rep") != F.col("head")) & _similar_sizes("n", "head_n", percent))
        .select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    )


def _across(lists: DataFrame, parts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members of one short list that lie in different components, and the
    members (rep, part, leader) of the longer lists that hold several components, with the
    heaviest leader of a member's lists."""
    placed = lists.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "value", "rep", "n", "weight", F.coalesce("component", "rep").alias("part"))
    mixed = placed.groupBy("value").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("members"), F.max(F.struct("weight", "rep")).alias("most")).where("p < q")
    placed = cut_lineage(placed.drop("weight").join(mixed.select("value", "members", "most"), "value"), "across")
    short = placed.where(F.col("members") <= CROWD)
    left = short.select("value", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"))
    right = short.select("value", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
    pairs = left.join(right, "value").where((F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & _similar_sizes("na", "nb", percent))
    crowded = placed.where(F.col("members") > CROWD).groupBy("rep", "part").agg(F.max("most").alias("most"))
    return pairs.select("a", "b").distinct(), crowded.select("rep", "part", F.col("most.rep").alias("leader"))


def _crowded_links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the components among the members (rep, part, leader), exact.

    Members near one leader are compared by what sets them apart from it (``_group_pairs``), all
    others by prefix filtering. Sets are put in one order, the rarest values first. If the first common value of two
    linked sets is the i-th of one of n values, n - i + 1 values at least are as many as the overlap needs.
    """
    members = cut_lineage(members, "crowd")
    sets = shingle_sets(keep_ids(docs, "id", members.select(F.col("rep").alias("id"))), width).withColumnRenamed("id", "rep")
    sets = cut_lineage(sets.join(members, "rep").select("rep", "part", "leader", F.size("shingles").alias("n"), "shingles"), "sets")
    apart = cut_lineage(_apart(sets, percent), "apart")
    to_leaders = apart.where(F.col("near") & (F.col("rep") != F.col("leader"))).select(
        F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))
    grouped = sets.join(apart.select("rep", F.col("leader").alias("group")), "rep", "left")
    front = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int") + 1
    first = _fronts(grouped.select("rep", "part", "group", "n", F.col("shingles").alias("values")), [], front)
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100.0 + percent))
    fits = (F.col("na") - F.col("ata") >= needed) & (F.col("nb") - F.col("atb") >= needed)
    same = F.coalesce(F.col("groupa") == F.col("groupb"), F.lit(False))
    pairs = _meeting(first, ["value"], fits & ~same).unionByName(_group_pairs(apart, percent)).distinct()
    return _linked(pairs, sets.select(F.col("rep").alias("id"), "shingles"), percent).unionByName(to_leaders)


def _fronts(rows: DataFrame, within: list[str], front: Column) -> DataFrame:
    """Rows (..., at, value) for the values, among the ``front`` rarest of ``values``, that another
    row ``within`` the same keys holds too; ``at`` is a value's place, from 0."""
    others = [c for c in rows.columns if c != "values"]
    postings = rows.select(*others, F.explode("values").alias("value"))
    common = postings.groupBy(*within, "value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = (
        postings.join(common, [*within, "value"], "left").groupBy(*others)
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "value"))).alias("values")))
    first = ranked.select(*others, F.posexplode(F.slice("values", F.lit(1), front)).alias("at", "v")).where("v.df > 1")
    return cut_lineage(first.select(*others, "at", F.col("v.value").alias("value")), "fronts")


def _meeting(fronts: DataFrame, on: list[str], fits: Column) -> DataFrame:
    """Pairs (a, b) of different components that meet in ``on`` and fit; other columns end in a or b."""
    side = lambda end: fronts.select(*on, F.col("rep").alias(end), *[
        F.col(c).alias(c + end) for c in fronts.columns if c not in ("rep", *on)])
    pairs = side("a").join(side("b"), on).where((F.col("a") < F.col("b")) & (F.col("parta") != F.col("partb")) & fits)
    return pairs.select("a", "b").distinct()


def _apart(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, part, leader, size, least, near, values) of the members that differ from their leader in no more values than they hold.

    ``values`` are those that only one of member and leader holds, ``size`` is the leader's, and
    ``near`` says that the two are linked. Two members of one leader have in common ``size``,
    less what each lacks, plus the ``values`` they share. So they are linked if and only if
    2 * (100 + percent) times the number of shared ``values`` is the sum of their ``least`` or more.
    """
    leaders = sets.join(sets.select(F.col("leader").alias("rep")).distinct(), "rep").select(
        F.col("rep").alias("leader"), F.col("n").alias("size"), F.col("shingles").alias("whole"))
    both = spread_join(sets, leaders, ["leader"], spread_by=["rep"])
    both = both.select("rep", "part", "leader", "n", "size", F.array_except("shingles", "whole").alias("own"), F.array_except("whole", "shingles").alias("lacked"))
    lacks = F.size("lacked").cast("bigint")
    least = F.col("n") * (2 * percent) - F.col("size") * (100 + percent) + lacks * (2 * (100 + percent))
    return both.where(F.size("own") + F.size("lacked") <= F.col("n")).select(
        "rep", "part", "leader", "size", least.alias("least"), (least <= F.col("size") * (100 - percent)).alias("near"), F.concat("own", "lacked").alias("values"))


def _group_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one leader that may be linked, by prefix filtering of what sets them apart from it.

    Members near the leader are linked with it, so a pair that joins components has one that is
    not. ``least`` is over size * (100 - percent) for those and -size * (100 - percent) at least for
    any, so such a pair shares a value.
    """
    unit = 2 * (100 + percent)
    reach = F.col("size") * (100 - percent)
    partner = F.when(F.col("near"), reach + 1).otherwise(-reach)
    shared = F.greatest(F.lit(1), F.ceil((F.col("least") + partner) / F.lit(float(unit)))).cast("int")
    held = F.size("values")
    rows = apart.where(held >= shared).select("rep", "part", "leader", "least", "near", held.alias("held"), shared.alias("shared"), "values")
    first = _fronts(rows, ["leader"], F.col("held") - F.col("shared") + 1)
    rest = lambda end: (F.col(f"held{end}") - F.col(f"at{end}")) * unit >= F.col("leasta") + F.col("leastb")
    return _meeting(first, ["leader", "value"], ~(F.col("neara") & F.col("nearb")) & rest("a") & rest("b"))


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose share of the smallest values of the union of both sketches may reach percent."""
    side = lambda end: classes.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}"), F.col("sketch").alias(f"s{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    both = both.select("a", "b", "na", "nb", "sa", "sb", union.alias("u"))
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u"))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH) & (F.size(F.array_union("sa", "sb")) <= SKETCH)
    return cut_lineage(both.where(shared >= _least_overlap(F.size("u"), whole, percent)).select("a", "b"), "pairs")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs linked on their full shingle sets; only texts of some pair are shingled again."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    return _linked(pairs, cut_lineage(shingle_sets(keep_ids(docs, "id", ids), width), "sets"), percent)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda end: sets.select(F.col("id").alias(end), F.col("shingles").alias(f"s{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    both = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    return cut_lineage(both.where((F.col("i") > 0) & (F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent)).select("a", "b").distinct(), "links")
