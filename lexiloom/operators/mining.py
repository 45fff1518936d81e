"""Mining of evaluation sets: similarity pairs and analogy quadruples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.joins import spread_join

JOINER = "\u200d"


def filter_dictionary(df: DataFrame, marker: str = "", headword: str = "headword", glosses: str = "glosses") -> DataFrame:
    """Drop entries without glosses, of one character, or with digits; leading marker characters are stripped first."""
    word = F.ltrim(F.col(headword), F.lit(marker)) if marker else F.col(headword)
    return df.withColumn(headword, word).where(
        (F.size(F.coalesce(glosses, F.array().cast("array<string>"))) > 0)
        & (F.length(headword) > 1)
        & ~F.col(headword).rlike(r"(?U)\d")
    )


def gloss_bags(df: DataFrame, entry: str, glosses: str) -> DataFrame:
    """(entry, bag): entries with equal gloss sets share the bag named by the smallest of them."""
    sets = df.select(entry, F.array_sort(F.array_distinct(glosses)).alias("__g"))
    names = sets.groupBy("__g").agg(F.min(entry).alias("bag"))
    return spread_join(sets, names, ["__g"], spread_by=[entry]).select(entry, "bag", F.col("__g").alias("glosses"))


def idf_jaccard(df: DataFrame, entry: str = "entry", glosses: str = "glosses", min_score: float = 0.0) -> DataFrame:
    """(a, b, score), a < b: all entries with a common gloss of positive weight and an
    IDF-weighted Jaccard of at least ``min_score``. Exact.

    IDF counts every entry. Entries with equal glosses are one bag while scores are computed, and
    score 1 among themselves. Given a ``min_score``, bags meet only on the rare front part of their
    glosses: if everything after a gloss weighs less than ``min_score`` of the bag, no pair can
    depend on it, so words found in most entries never bring bags together.
    """
    entries = df.agg(F.count(F.lit(1))).scalar()
    each = df.select(F.explode(F.array_distinct(glosses)).alias("g"))
    idf = each.groupBy("g").agg(F.log(entries / F.count(F.lit(1))).alias("idf"))
    members = gloss_bags(df, entry, glosses)
    bags = members.where(F.col(entry) == F.col("bag")).select("bag", F.col("glosses").alias("__g")).dropDuplicates(["bag"])
    weighted = spread_join(bags.select("bag", F.explode("__g").alias("g")), idf, ["g"], spread_by=["bag"])
    rest = Window.partitionBy("bag").orderBy(F.desc("idf"), "g").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("bag")
    placed = weighted.withColumn("__rest", F.sum("idf").over(rest)).withColumn("__w", F.sum("idf").over(whole))
    front = placed.where((F.col("idf") > 0) & (F.col("__rest") >= min_score * F.col("__w") * (1 - 1e-9))).select("g", "bag", "__w")
    content = weighted.groupBy("bag").agg(F.map_from_entries(F.collect_list(F.struct("g", "idf"))).alias("m"), F.sum("idf").alias("w"))
    close = (F.col("wa") >= min_score * F.col("wb")) & (F.col("wb") >= min_score * F.col("wa"))
    end = lambda n: front.select("g", F.col("bag").alias(n), F.col("__w").alias(f"w{n}"))
    pairs = end("a").join(end("b"), "g").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    side = lambda n: content.select(F.col("bag").alias(n), F.col("m").alias(f"m{n}"), F.col("w").alias(f"w{n}"))
    common = F.map_values(F.map_filter("ma", lambda k, v: F.map_contains_key("mb", k)))
    inter = F.aggregate(F.array_sort(common), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (inter / (F.col("wa") + F.col("wb") - inter)).alias("score"))
    scored = scored.where(F.col("score") >= min_score)
    named = lambda bag, name: members.select(F.col("bag").alias(bag), F.col(entry).alias(name))
    apart = scored.join(named("a", "x"), "a").join(named("b", "y"), "b").select("x", "y", "score")
    weights = content.where("w > 0").select("bag")
    alike = members.join(weights, "bag", "left_semi")
    side = lambda name: alike.select("bag", F.col(entry).alias(name))
    within = side("x").join(side("y"), "bag").where("x < y").select("x", "y", F.lit(1.0).alias("score"))
    return apart.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


# Share of the shorter word two words of one stem have in common.
SAME_STEM_SHARE = 0.6


def same_stem(a: Column | str, b: Column | str, share: float = SAME_STEM_SHARE) -> Column:
    """True when the common prefix is at least ``share`` of the shorter word."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    needed = F.ceil(F.least(F.length(a), F.length(b)) * F.lit(share) - 1e-9).cast("int")
    return F.substring(a, F.lit(1), needed) == F.substring(b, F.lit(1), needed)


def exclude_same_stem(pairs: DataFrame, a: str = "word1", b: str = "word2") -> DataFrame:
    return pairs.where(~same_stem(a, b))


def minmax(df: DataFrame, col: str) -> DataFrame:
    """Rescale to 0..1 over all rows; a constant column becomes 0."""
    lo, hi = df.agg(F.min(col)).scalar(), df.agg(F.max(col)).scalar()
    return df.withColumn(col, F.coalesce(F.try_divide(F.col(col) - lo, hi - lo), F.lit(0.0)))


# Stem window, productive suffixes, support and frequency floors, trim.
STRIP_LENGTHS, MIN_STEM, MIN_FORMS = (1, 5), 3, 3
TOP_SUFFIXES, MIN_PARADIGMS, MIN_FORM_COUNT = 8, 3, 5
PER_COMBINATION, TARGET_QUADRUPLES = 2, 30


def stem_clusters(vocab: DataFrame, strip=STRIP_LENGTHS, min_stem: int = MIN_STEM, min_forms: int = MIN_FORMS) -> DataFrame:
    """(stem, suffix, form, n): forms split into stem and 1 to 5 final characters, joiners left out of both.

    Stems that differ only by a joiner are one. If two forms give the same
    stem and suffix, the more frequent stands for them.
    """
    lo, hi = strip
    longest = F.least(F.lit(hi), F.length("token") - 1)
    cut = vocab.where(F.length("token") > lo).select(
        F.col("token").alias("form"), "n", F.explode(F.sequence(F.lit(lo), longest)).alias("k")
    )
    plain = lambda c: F.replace(c, F.lit(JOINER), F.lit(""))
    split = cut.select(
        plain(F.substring("form", F.lit(1), F.length("form") - F.col("k"))).alias("stem"),
        plain(F.substring("form", F.length("form") - F.col("k") + 1, F.col("k"))).alias("suffix"),
        "form", "n",
    ).where((F.length("stem") >= min_stem) & (F.col("suffix") != ""))
    forms = split.groupBy("stem", "suffix").agg(
        F.min_by(F.struct("form", "n"), F.struct(-F.col("n"), "form")).alias("f")
    ).select("stem", "suffix", "f.form", "f.n")
    sizes = forms.groupBy("stem").agg(F.count(F.lit(1)).alias("n_forms")).where(F.col("n_forms") >= min_forms)
    return forms.join(sizes, "stem").select("stem", "suffix", "form", "n", "n_forms")


def top_suffixes(clusters: DataFrame, top: int = TOP_SUFFIXES) -> DataFrame:
    best = Window.partitionBy("stem").orderBy(F.desc("n"), "suffix")
    return clusters.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top).drop("__r")


def paradigm_pairs(clusters: DataFrame, top: int = TOP_SUFFIXES) -> DataFrame:
    """(stem, s1, s2, form1, form2, n1, n2), s1 < s2: suffix pairs inside one stem's ``top`` suffixes.

    Pairs are built inside one array of at most ``top`` suffixes per stem.
    """
    lists = top_suffixes(clusters, top).groupBy("stem").agg(
        F.array_sort(F.collect_list(F.struct("suffix", "form", "n"))).alias("xs")
    )
    left = lists.select("stem", "xs", F.posexplode("xs").alias("i", "x"))
    both = left.select("stem", "x", F.explode(F.slice("xs", F.col("i") + 2, F.lit(top))).alias("y"))
    return both.select(
        "stem", F.col("x.suffix").alias("s1"), F.col("y.suffix").alias("s2"), F.col("x.form").alias("form1"),
        F.col("y.form").alias("form2"), F.col("x.n").alias("n1"), F.col("y.n").alias("n2"),
    )


def suffix_pairs(clusters: DataFrame, top: int = TOP_SUFFIXES, min_paradigms: int = MIN_PARADIGMS) -> DataFrame:
    """(s1, s2, paradigms): suffix pairs in the top list of at least ``min_paradigms`` stems."""
    return paradigm_pairs(clusters, top).groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("paradigms")).where(
        F.col("paradigms") >= min_paradigms
    )


def quadruples(clusters: DataFrame, pairs: DataFrame, top: int = TOP_SUFFIXES, min_count: int = MIN_FORM_COUNT, target: int = TARGET_QUADRUPLES) -> DataFrame:
    """The candidate quadruples that can be among the ``target`` most frequent: (s1, s2, stem1, stem2, a, b, c, d, total).

    Every two stems sharing a suffix pair make a quadruple whose total is the
    sum of the two stems' own sums. Pairing all stems would grow with the
    square of a productive pair's stems; but a stem behind ``target`` + 1
    others of its suffix pair cannot be in one of the ``target`` best, so only
    the first ``target`` + 1 stems are paired. The trimmed result is the same.
    """
    fit = paradigm_pairs(clusters, top).where((F.col("n1") >= min_count) & (F.col("n2") >= min_count)).join(
        pairs.select("s1", "s2"), ["s1", "s2"], "left_semi"
    ).withColumn("__sum", F.col("n1") + F.col("n2"))
    best = Window.partitionBy("s1", "s2").orderBy(F.desc("__sum"), "stem")
    lists = (
        fit.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= target + 1)
        .groupBy("s1", "s2").agg(F.array_sort(F.collect_list(F.struct("stem", "form1", "form2", "__sum"))).alias("xs"))
    )
    left = lists.select("s1", "s2", "xs", F.posexplode("xs").alias("i", "x"))
    both = left.select("s1", "s2", "x", F.explode(F.slice("xs", F.col("i") + 2, F.lit(target + 1))).alias("y"))
    return both.select(
        "s1", "s2", F.col("x.stem").alias("stem1"), F.col("y.stem").alias("stem2"),
        F.col("x.form1").alias("a"), F.col("x.form2").alias("b"), F.col("y.form1").alias("c"), F.col("y.form2").alias("d"),
        (F.col("x.__sum") + F.col("y.__sum")).alias("total"),
    )


def cap_and_trim(candidates: DataFrame, cap: int = PER_COMBINATION, target: int = TARGET_QUADRUPLES) -> DataFrame:
    """At most ``cap`` per stem pair and suffix pair, then the ``target`` most frequent."""
    combination = Window.partitionBy("stem1", "stem2", "s1", "s2").orderBy(F.desc("total"), "a", "b", "c", "d")
    capped = candidates.withColumn("__r", F.row_number().over(combination)).where(F.col("__r") <= cap).drop("__r")
    return capped.orderBy(F.desc("total"), "s1", "s2", "stem1", "stem2").limit(target)
