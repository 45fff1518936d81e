"""Joins: skew-safe lookup, verse join, enrichment, inventories, prefix attestation, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def hot_keys(df: DataFrame, on: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys holding more than 1/share of the rows: at most ``share`` of them exist,
    which is what makes broadcasting this frame safe at any scale."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.where(F.col("__n") * share > total).select(*on, F.lit(True).alias("__hot"))


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    salts: int = 64,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to one row per key without gathering a hot key in one task.

    Hot keys of the large side are dealt over ``salts`` sub-keys by a hash of
    the row (the same on a retry), and only their partners are replicated.
    ``hot`` is the result of ``hot_keys`` where the same side is joined again.
    """
    hot = F.broadcast(hot_keys(big, on) if hot is None else hot)
    row = [F.col(c) for c in (spread_by or big.columns)]
    left = (
        big.join(hot, on, "left")
        .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*row), F.lit(salts))).otherwise(0).cast("int"))
        .drop("__hot")
    )
    right = (
        small.join(hot, on, "left")
        .withColumn(
            "__salt",
            F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hot")
    )
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def verse_join(a: DataFrame, b: DataFrame, on: list[str], a_text: str, b_text: str) -> DataFrame:
    """Full outer join on the verse key with a ``side`` column: both, a_only, b_only."""
    left = a.select(*on, F.col(a_text).alias("a_text"), F.lit(True).alias("__a"))
    right = b.select(*on, F.col(b_text).alias("b_text"), F.lit(True).alias("__b"))
    side = F.when(F.col("__a").isNull(), "b_only").when(F.col("__b").isNull(), "a_only").otherwise("both")
    return left.join(right, on, "full").withColumn("side", side).drop("__a", "__b")


def coverage_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def enrich_segments(
    analysis: DataFrame,
    report: DataFrame,
    textgrids: DataFrame,
    wavs: DataFrame,
    texts: DataFrame,
    order: str | None = None,
) -> DataFrame:
    """Alignment rows with segmentation flags and file paths; defaults where a file is missing.

    A segment that the report repeats takes its last row by the report's column ``order``, and of rows equal in
    it the greatest (chapter, confidence, reason). Without ``order`` it is the last row as read, which is the file's
    last only where the report comes straight from its file. Every other side is unique on ``segment``, so plain
    shuffled joins cannot skew. ``aligned`` says that there is an interval file; whether it holds words
    is for ``collect_record`` to see.
    """
    path = lambda df, name: df.select(F.col("stem").alias("segment"), F.col("path").alias(name))
    flagged = F.struct("chapter", "confidence", "reason")
    at = F.col(order) if order else F.monotonically_increasing_id()
    newest = report.withColumn("__at", at).groupBy("segment").agg(F.max_by(flagged, F.struct("__at", flagged)).alias("r"))
    flags = newest.select(
        "segment",
        F.col("r.chapter").alias("__chapter"),
        F.col("r.confidence").alias("segmentation_confidence"),
        F.col("r.reason").alias("segmentation_reason"),
    )
    out = (
        analysis.join(flags, "segment", "left")
        .join(path(textgrids, "textgrid_path"), "segment", "left")
        .join(path(wavs, "wav_path"), "segment", "left")
        .join(path(texts, "txt_path"), "segment", "left")
    )
    return (
        out.withColumn("aligned", F.col("textgrid_path").isNotNull())
        .withColumn("chapter", F.coalesce("__chapter", F.regexp_replace("segment", r"(?s)^(.*)_seg_.*$", "$1")))
        .withColumn("book", F.substring_index("segment", "_", 1))
        .fillna("", ["segmentation_confidence", "segmentation_reason", "textgrid_path", "wav_path", "txt_path"])
        .drop("__chapter")
    )


def expected_present(books: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Expected units (book, n units) against two inventories keyed (book, num)."""
    expected = books.select("book", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("num")).where(F.col("num") >= 1)
    flag = lambda df, name: df.select("book", "num").distinct().withColumn(name, F.lit(True))
    return (
        expected.join(flag(left, "has_left"), ["book", "num"], "left")
        .join(flag(right, "has_right"), ["book", "num"], "left")
        .fillna(False, ["has_left", "has_right"])
    )


def inventory_counts(presence: DataFrame) -> DataFrame:
    return presence.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(F.col("has_left") & F.col("has_right")).alias("pairs"),
        F.count_if(~(F.col("has_left") & F.col("has_right"))).alias("missing_pairs"),
        F.count_if(~F.col("has_left")).alias("missing_left"),
        F.count_if(~F.col("has_right")).alias("missing_right"),
    )


def attested(headwords: DataFrame, vocabulary: DataFrame, min_chars: int = 3) -> DataFrame:
    """Headwords that are a prefix of some corpus word, as an equi semi-join.

    Corpus words are distinct already; each contributes its prefixes once per
    task before the shuffle (partial aggregation of ``distinct``).
    """
    prefixes = (
        vocabulary.where(F.length("token") >= min_chars)
        .select(F.explode(F.transform(F.sequence(F.lit(min_chars), F.length("token")), lambda n: F.substring("token", F.lit(1), n))).alias("headword"))
        .distinct()
    )
    return headwords.where(F.length("headword") >= min_chars).join(prefixes, "headword", "left_semi")


def judge_lexicon(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Mark induced pairs ``agree``, ``disagree`` or ``not_in_ref``."""
    ref = reference.select(F.col("headword").alias("source"), "glosses")
    status = (
        F.when(F.col("glosses").isNull(), "not_in_ref")
        .when(F.array_contains("glosses", F.col("target")), "agree")
        .otherwise("disagree")
    )
    return spread_join(pairs, ref, ["source"], "left").withColumn("status", status).drop("glosses")


def missing_values(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Distinct wanted keys with no present row."""
    return wanted.select(*on).distinct().join(present.select(*on), on, "left_anti")


def require_present(wanted: DataFrame, present: DataFrame, on: list[str], what: str) -> None:
    """Raise if a wanted key is unknown; only a few offenders reach the driver."""
    unknown = missing_values(wanted, present, on).orderBy(*on).limit(20).collect()
    if unknown:
        raise ValueError(f"{what} not present: {[tuple(r) for r in unknown]}")


def union_batches(batches: dict[str, DataFrame]) -> DataFrame:
    """Union per-run records, each tagged with its batch name."""
    frames = [df.withColumn("batch", F.lit(name)) for name, df in batches.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
