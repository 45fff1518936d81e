"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.session import cut_lineage


def text_bytes(text: Column) -> Column:
    """Bytes a text takes in a shard: its UTF-8 bytes and one separator; a null text has none of its own."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): law ``bytes``.

    Rows are put in ascending order of id by ranges, and each range adds up its own
    bytes; only these totals, one row per range, are summed across ranges. A row goes
    to the shard in whose equal share of all bytes its middle byte lies, so a shard
    misses the target by half a row at each end at most, and shards are contiguous in
    the order. ``slot`` counts a shard's rows in that order from 0.

    Cases. Null ids come first. A null text counts as empty: 1 byte, checksum 0. Rows of
    one id are ordered by size, then checksum, and repeated rows stay apart, so a hot id
    is cut like any other run of rows. An empty table gives an empty one. Other columns
    are not read. ``grown_shard`` is null: under this law a further shard moves others' rows.
    """
    return _assigned(docs, id_col, text_col, shards, keep_text=False)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> None:
    """Parquet folders ``shard=N`` of (id, text, slot), each file a contiguous run of slots."""
    out = _assigned(docs, id_col, text_col, shards, keep_text=True)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select(id_col, text_col, "shard", "slot").write.partitionBy("shard").parquet(path)


def _assigned(docs: DataFrame, id_col: str, text_col: str, shards: int, keep_text: bool) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), text_bytes(text).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("crc"),
        F.monotonically_increasing_id().alias("nth"), *([text.alias("text")] if keep_text else []))
    order = [F.col("id").asc_nulls_first(), F.col("size"), F.col("crc"), F.col("nth")]
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")

    # one row per range
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(starts), "part").select(
        "*", (F.col("bytes_before") + F.sum("size").over(within)).alias("end"),
        (F.col("rows_before") + F.count(F.lit(1)).over(within) - 1).alias("place"))
    middle = (F.col("end") * 2 - F.col("size")) * F.lit(shards)
    shard = F.least(F.floor(middle / (F.col("all_bytes") * 2)).cast("int"), F.lit(shards - 1))
    placed = cut_lineage(placed.select(*rows.columns, "place", shard.alias("shard")), "placed")
    # one row per shard
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *([F.col("text").alias(text_col)] if keep_text else []))
