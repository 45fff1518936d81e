"""Corpus profiling: sizes, vocabularies, character inventories, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.ordered import quantiles, upper_middle


def sentences(df: DataFrame, keep: list[str], text: str = "text", terminators: str = T.DANDA, min_tokens: int = 3) -> DataFrame:
    """One row per sentence of at least ``min_tokens``; ``sent_no`` counts all non-empty pieces."""
    return (
        df.select(*keep, F.posexplode(T.split_sentences(text, terminators)).alias("sent_no", "text"))
        .withColumn("sent_no", F.col("sent_no").cast("long"))
        .where(F.size(T.tokens("text")) >= min_tokens)
    )


def corpus_stats(df: DataFrame, by: str, text: str = "text", ranges=T.DEVANAGARI_RANGES) -> DataFrame:
    """Sentence, token and type counts, mean and median length, script share per group.

    Lengths are small integers, so the exact median keeps one counter per
    distinct length. Types are counted after (group, token) is deduplicated,
    first inside each task, then across tasks.
    """
    measured = df.select(
        by, T.word_count(text).alias("__n"), T.native_count(text, ranges).alias("__native"), T.non_space_count(text).alias("__chars")
    )
    sizes = measured.groupBy(by).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum("__n").alias("tokens"),
        F.avg("__n").alias("mean_length"),
        F.median("__n").alias("median_length"),
        (F.try_divide(F.sum("__native"), F.sum("__chars")) * 100).alias("script_pct"),
    )
    types = df.select(by, F.explode(T.tokens(text)).alias("__t")).groupBy(by).agg(F.countDistinct("__t").alias("types"))
    return (
        sizes.join(types, by, "left")
        .fillna(0, ["types"])
        .withColumn("type_token_ratio", F.try_divide("types", "tokens"))
    )


def vocabulary(df: DataFrame, tokens: Column, by: list[str] | None = None) -> DataFrame:
    """Distinct tokens with their count."""
    return df.select(*(by or []), F.explode(tokens).alias("token")).groupBy(*(by or []), "token").agg(
        F.count(F.lit(1)).alias("n")
    )


def code_point_label(ch: Column | str) -> Column:
    ch = F.col(ch) if isinstance(ch, str) else ch
    # the code point through UTF-32, since ascii() stops at the first UTF-16 unit
    code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 16)
    return F.concat(F.lit("U+"), F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code))


def charset(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Characters other than white space with count and U+XXXX label."""
    chars = df.select(*(by or []), F.explode(F.split(F.regexp_replace(text, f"(?U){T.SPACE}+", ""), "")).alias("ch"))
    return (
        chars.where(F.col("ch") != "")
        .groupBy(*(by or []), "ch")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", code_point_label("ch"))
    )


def coverage(chars: DataFrame, inventories: DataFrame) -> DataFrame:
    """Per candidate inventory: covered and total characters, share, missing kinds, rank.

    ``chars`` is (ch, n) and cannot exceed the size of Unicode, so it is safe
    to broadcast. Candidates of no overlap appear with zero.
    """
    totals = chars.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    total, kinds = totals.select("t").scalar(), totals.select("k").scalar()
    hit = (
        inventories.select("candidate", "ch").distinct()
        .join(F.broadcast(chars.select("ch", "n")), "ch", "left")
        .groupBy("candidate")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered"), F.count("n").alias("__kinds"))
    )
    return hit.select(
        "candidate", "covered",
        total.alias("total"),
        (F.try_divide(F.col("covered"), total) * 100).alias("covered_pct"),
        (kinds - F.col("__kinds")).alias("missing_kinds"),
    )


def missing_characters(chars: DataFrame, inventories: DataFrame, candidates: list[str]) -> DataFrame:
    """(candidate, ch, n) for every character a candidate lacks, without pairing the two sides."""
    holders = inventories.groupBy("ch").agg(F.collect_set("candidate").alias("__in"))
    lacking = F.array_except(F.array(*[F.lit(c) for c in candidates]), F.coalesce("__in", F.array().cast("array<string>")))
    return chars.join(holders, "ch", "left").select(F.explode(lacking).alias("candidate"), "ch", "n")


def reduction(df: DataFrame, before: Column | str, after: Column | str, by: list[str] | None = None) -> DataFrame:
    """Words before and after cleaning and the share removed."""
    before = F.col(before) if isinstance(before, str) else before
    after = F.col(after) if isinstance(after, str) else after
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(before).alias("words_before"), F.sum(after).alias("words_after")
    )
    return out.withColumn(
        "reduction_pct",
        F.when(F.col("words_before") > 0, 100 * (1 - F.col("words_after") / F.col("words_before"))),
    )


def oov_rate(known: DataFrame, evaluated: DataFrame, min_count: int = 1) -> DataFrame:
    """Share of distinct evaluated types missing from the vocabulary, 0 when there are none.

    ``known`` is (token, n); ``evaluated`` has a ``token`` column.
    """
    vocab = known.where(F.col("n") >= min_count).select("token", F.lit(1).alias("__known"))
    types = evaluated.select("token").distinct().join(vocab, "token", "left")
    counts = types.agg(F.count(F.lit(1)).alias("types"), F.count_if(F.col("__known").isNull()).alias("oov"))
    return counts.withColumn(
        "oov_pct", F.when(F.col("types") == 0, F.lit(0.0)).otherwise(F.col("oov") / F.col("types") * 100)
    )


RATIO_POINTS = {"min": 0.0, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}


def ratio_profile(df: DataFrame, ratio: Column | str, resolution: float = 0.01) -> DataFrame:
    """Named quantiles of a length ratio as rows (point, value)."""
    names = F.create_map(*[x for n, p in RATIO_POINTS.items() for x in (F.lit(float(p)), F.lit(n))])
    rows = quantiles(df, [], ratio, list(RATIO_POINTS.values()), resolution)
    return rows.select(names[F.col("prob")].alias("point"), "value")


def sentence_packing(df: DataFrame, a_count: Column, b_count: Column) -> DataFrame:
    """How many rows hold 0, 1 or 2+ sentences per side, and both/either multi counts."""
    bucket = lambda c: F.when(c >= 2, "2+").otherwise(c.cast("string"))
    flags = df.select(bucket(a_count).alias("a"), bucket(b_count).alias("b"))
    sides = flags.select(F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("a").alias("bucket")),
        F.struct(F.lit("b").alias("side"), F.col("b").alias("bucket")),
        F.struct(F.lit("both_multi").alias("side"), ((F.col("a") == "2+") & (F.col("b") == "2+")).cast("string").alias("bucket")),
        F.struct(F.lit("either_multi").alias("side"), ((F.col("a") == "2+") | (F.col("b") == "2+")).cast("string").alias("bucket")),
    )).alias("x")).select("x.*")
    counts = sides.groupBy("side", "bucket").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.col("n") / total * 100)


def split_report(df: DataFrame, split: str = "split", text: str = "text", duration: str = "duration_s", resolution: float = 1.0) -> DataFrame:
    """Clips, hours, upper-middle duration, tokens and types for the total and every split."""
    label = F.coalesce(F.col(split), F.lit("total"))
    base = df.rollup(split).agg(
        F.count(F.lit(1)).alias("clips"),
        (F.sum(duration) / 3600).alias("hours"),
        F.sum(T.word_count(text)).alias("tokens"),
    ).withColumn(split, label)
    pairs = df.select(split, F.explode(T.tokens(text)).alias("__t")).distinct()
    types = pairs.rollup(split).agg(F.countDistinct("__t").alias("types")).withColumn(split, label)
    medians = upper_middle(df, [split], duration, resolution).unionByName(
        upper_middle(df.withColumn(split, F.lit("total")), [split], duration, resolution)
    )
    return base.join(types, split, "left").join(medians, split, "left").fillna(0, ["types"])


def reason_counts(df: DataFrame, reasons: str = "qc_reasons") -> DataFrame:
    """Rows per reason with the share of all rows; a row may hold several reasons."""
    total = df.agg(F.count(F.lit(1))).scalar()
    exploded = df.select(F.explode(F.split(reasons, ";")).alias("reason")).where(F.col("reason") != "")
    return exploded.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)


def yield_by(df: DataFrame, key: str, passed: Column | str, n: int | None = 5) -> DataFrame:
    """Pass rate per group, the lowest ``n`` if asked; ties by key."""
    passed = F.col(passed) if isinstance(passed, str) else passed
    rates = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed")
    ).withColumn("pass_rate", F.col("passed") / F.col("total"))
    return rates if n is None else rates.orderBy("pass_rate", key).limit(n)


def kept_share(df: DataFrame, passed: Column, kept: Column, total: Column) -> DataFrame:
    """Seconds kept by passing rows against all seconds, nulls as zero."""
    sums = df.agg(
        F.coalesce(F.sum(F.when(passed, F.coalesce(kept, F.lit(0.0)))), F.lit(0.0)).alias("kept"),
        F.coalesce(F.sum(total), F.lit(0.0)).alias("total"),
    )
    return sums.withColumn("share", F.when(F.col("total") > 0, F.col("kept") / F.col("total")))


def calibrate(df: DataFrame, cuts: dict[str, float], resolution: float = 1.0) -> DataFrame:
    """Exact percentile of each metric as a suggested threshold: (metric, prob, value)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(float(p)).alias("__p"), F.col(m).cast("double").alias("__x")) for m, p in cuts.items()
    ])).alias("r")).select("r.*")
    wanted = F.create_map(*[x for m, p in cuts.items() for x in (F.lit(m), F.lit(float(p)))])
    rows = quantiles(long, ["metric"], "__x", sorted(set(map(float, cuts.values()))), resolution)
    return rows.where(F.col("prob") == wanted[F.col("metric")])


def rate_by(df: DataFrame, key: str, outcome: Column) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(outcome).alias("hits"), F.avg(outcome.cast("double")).alias("rate")
    )


def corr_with_outcome(df: DataFrame, metrics: list[str], outcome: Column) -> DataFrame:
    """Correlation of each metric with a 0/1 outcome, one pass."""
    row = df.agg(*[F.corr(F.col(m).cast("double"), outcome.cast("double")).alias(m) for m in metrics])
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("corr")) for m in metrics])).alias("r")).select("r.*")


def context_rate(df: DataFrame, suffixes: list[str], markers: list[str], text: str = "text") -> DataFrame:
    """Per suffix: sentences with a word ending in it, and how many of them hold a marker word."""
    words = T.tokens(text)
    marked = F.arrays_overlap(words, F.array(*[F.lit(m) for m in markers]))
    ends = lambda s: F.exists(words, lambda w: F.endswith(w, F.lit(s)))
    row = df.agg(*[a for i, s in enumerate(suffixes) for a in (
        F.count_if(ends(s)).alias(f"n{i}"), F.count_if(ends(s) & marked).alias(f"m{i}"))])
    out = row.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("suffix"), F.col(f"n{i}").alias("sentences"), F.col(f"m{i}").alias("with_marker"))
        for i, s in enumerate(suffixes)])).alias("r")).select("r.*")
    return out.withColumn("rate", F.when(F.col("sentences") > 0, F.col("with_marker") / F.col("sentences")))


# ---------------------------------------------------------------- adaptation

def adapt_dataset(df: DataFrame, key: str, missing: list[str], policy: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """The rows with their text adapted to an inventory; refused if any row would be left empty.

    The refusal names a few of the rows; no more than those reach the driver.
    """
    out = df.withColumn(text, T.adapt_text(F.col(text), missing, policy))
    empty = out.where(F.coalesce(T.strip_space(text), F.lit("")) == "")
    n = empty.count()
    if n:
        some = [r[key] for r in empty.orderBy(key).limit(3).collect()]
        raise ValueError(f"adaptation empties {n} rows, such as {some}")
    return out
