"""Document fingerprints: chains of content words after common words, compared by pruned Jaccard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.common import lower_ascii
from lexiloom.llm.components import connected_components
from lexiloom.session import cut_lineage

ANCHOR_SHARE = 200  # a word holding at least 1/200 of all words is an anchor: at most 200 of them exist
STRETCH = 16  # distinct words that may follow each other without an anchor before anchors are added to the list
ADDED, ROUNDS = 40, 8  # words added in a round, and rounds
LONG_STRETCH = 24  # distinct words without an anchor from which words of the stretch are chosen by their hash
SPLIT = r"[^\p{L}\p{N}]+"
SIGNATURES = "array<bigint>"


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SPLIT), lambda w: w != "")


def _stretches(words: Column, anchors: list[str], least: int) -> Column:
    """The runs of words between anchors that hold more than ``least`` distinct words."""
    gone = (lambda w: F.when(w.isin(anchors), F.lit("\n")).otherwise(w)) if anchors else (lambda w: w)
    lines = F.filter(F.split(F.array_join(F.transform(words, gone), " "), "\n"), lambda s: F.length(s) > 2 * least)
    return F.filter(F.transform(lines, lambda s: F.split(F.btrim(s), " ")), lambda s: F.size(F.array_distinct(s)) > least)


def common_words(docs: DataFrame, text_col: str = "text", share: int = ANCHOR_SHARE) -> list[str]:
    """The words that each hold at least 1/share of all word occurrences, then those that the texts without them need.

    A language or form of text with a small share of the words has none in the first list. So the
    stretches of more than STRETCH distinct words without an anchor are pooled, their ADDED commonest words
    become anchors, and what is still a stretch is pooled again, ROUNDS times at most.
    """
    texts = docs.select(_words(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("w"))
    counts = cut_lineage(texts.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most ``share`` words can pass
    added = [r["word"] for r in counts.where(F.col("n") * share >= total).collect()]
    anchors = list(added)
    for _ in range(ROUNDS):
        texts = cut_lineage(texts.select(F.explode(_stretches(F.col("w"), added, STRETCH)).alias("w")), "stretches")
        pooled = texts.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        added = [r["word"] for r in pooled.orderBy(F.desc("n"), "word").limit(ADDED).collect()]
        if not added:
            break
        anchors += added
    return sorted(anchors)


def with_signatures(df: DataFrame, text: Column, anchors: list[str], name: str) -> DataFrame:
    """Adds the sorted distinct 32-bit signatures of a text.

    Every anchor gives one: itself and the next two content words (words that are no
    anchors). The beginning of the text counts as an anchor, so any text with content words has a
    signature. In a stretch of more than LONG_STRETCH distinct content words without an anchor, about every
    fourth word, chosen by its hash, gives one with the two words after it; it stays a content word. A text with anchors only has the hash of its words, one without words the
    hash of its characters, and the empty text none.
    """
    kept = df.columns
    words = df.select("*", text.alias("__t")).select("*", _words(F.col("__t")).alias("__w"))
    # "^ anchor anchor" NEWLINE "content anchor" NEWLINE "content" ...: a new line before each content word
    is_anchor = (lambda w: w.isin(anchors)) if anchors else (lambda w: F.lit(False))
    marked = F.array_join(F.transform("__w", lambda w: F.when(is_anchor(w), w).otherwise(F.concat(F.lit("\n"), w))), " ")
    runs = words.select("*", F.split(F.concat(F.lit("^ ^ "), marked), " ?\n").alias("__r"))
    runs = runs.select("*", F.transform("__r", lambda r: F.split(F.rtrim(r), " ")).alias("__p"))
    runs = runs.select("*", F.transform("__p", lambda p: F.get(p, F.lit(0))).alias("__c"), (F.size("__p") - 1).alias("__n"))
    chain = F.zip_with(F.slice("__c", F.lit(2), "__n"), F.slice("__c", F.lit(3), "__n"), lambda a, b: F.xxhash64(a, b))
    runs = runs.select("*", chain.alias("__h"))
    signature = lambda h, a: F.shiftrightunsigned(F.xxhash64(a, h), 32)
    each = F.zip_with(
        F.slice("__p", F.lit(1), "__n"), "__h", lambda p, h: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a: signature(h, a)))
    plain = F.when(F.size("__w") > 0, F.array(F.shiftrightunsigned(F.xxhash64("__w"), 32))).when(
        F.col("__t") != "", F.array(F.shiftrightunsigned(F.xxhash64("__t"), 32))).otherwise(F.array().cast(SIGNATURES))

    def chosen(x: Column) -> Column:
        """Signatures of the words of a stretch whose hash is a multiple of 4 or the smallest, up to the last but two."""
        s, hashes, least = x["s"], x["h"], x["least"]
        picked = lambda i: (i < F.size(s) - 2) & ((F.pmod(F.get(hashes, i), F.lit(4)) == 0) | (F.get(hashes, i) == least))
        all_ = F.transform(s, lambda w, i: F.when(picked(i), signature(F.xxhash64(F.get(s, i + 1), F.get(s, i + 2)), w)))
        return F.filter(all_, lambda h: h.isNotNull())

    # hashes and their minimum stand beside the stretch, or every word would compute them again
    hashed = F.transform(_stretches(F.col("__w"), anchors, LONG_STRETCH), lambda s: F.struct(s.alias("s"), F.transform(s, lambda w: F.xxhash64(w)).alias("h")))
    runs = runs.select("*", F.transform(hashed, lambda x: F.struct(
        x["s"].alias("s"), x["h"].alias("h"), F.array_min(F.slice(x["h"], F.lit(1), F.size(x["h"]) - 2)).alias("least"))).alias("__x"))
    inside = F.flatten(F.transform("__x", chosen))
    found = F.when(F.col("__n") > 0, F.sort_array(F.array_distinct(F.concat(F.flatten(each), inside)))).otherwise(plain)
    return runs.select(*[F.col(f"`{c}`") for c in kept], found.alias(name))


def fingerprint(signatures: Column) -> Column:
    """Signatures as text: eight hexadecimal digits each, ascending."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike.

    Pairs whose sizes alone keep them under ``least`` are pruned to 0 before anything is intersected.
    """
    shared = F.size(F.array_intersect(a, b))
    value = shared / (F.size(a) + F.size(b) - shared)
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * F.lit(least)), F.lit(0.0)).otherwise(value)


def edited_fingerprints(docs: DataFrame, anchors: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next row is the one with the next smaller id, and after the last the first. The edited
    text is the text with its last floor(n/2) code points replaced by the first as many of the next.

    Rows are cut into ranges of id at sampled quantiles; into each range goes a copy of the row that
    follows its last one, so one shuffle of the texts brings all neighbours together.
    Cases. Null and empty texts are empty: no signatures, alike to each other only. Null ids come
    last; rows of one id are ordered by a hash of their text. A table of one row is its own
    next. An empty table gives an empty one. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", _bucket(rows))
    # per range its first row, in descending order: one row per range
    tops = rows.groupBy("bucket").agg(F.max("id").alias("id"))
    heads = {r["bucket"]: r["id"] for r in tops.collect()}
    order = sorted(heads, reverse=True)
    guest_of = dict(zip([order[(i + 1) % len(order)] for i in range(len(order))], order, strict=True)) if order else {}
    first = F.col("id").isin([i for i in heads.values() if i is not None]) | ((F.col("id").isNull()) if None in heads.values() else F.lit(False))
    firsts = rows.where(first).groupBy("bucket", "id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("bucket", "id", "m.text")
    host = F.create_map(*[F.lit(x) for pair in guest_of.items() for x in pair]) if guest_of else F.create_map(F.lit(0), F.lit(0))
    guests = firsts.select("id", "text", F.element_at(host, F.col("bucket")).alias("bucket"), F.lit(True).alias("guest"))
    near = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket")
    near = with_signatures(near, F.col("text"), anchors, "sigs")
    following = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.xxhash64("text").desc())
    near = near.select("*", F.lead("text").over(following).alias("next_text"), F.lead("sigs").over(following).alias("next_sigs")).where("NOT guest")

    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    near = near.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sigs", likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
    near = with_signatures(near, F.col("edited"), anchors, "edited_sigs")
    return near.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), "near_next")


def _bucket(rows: DataFrame) -> Column:
    """Number of the range that an id lies in, ascending; null ids lie in range -1.

    There are as many ranges as shuffle partitions, at most 10,000, cut at approximate quantiles.
    Bounds are looked up in two steps, so a row costs the root of their number.
    """
    n = min(10_000, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [1.0], 100_000)).first()[0] or []
    bounds = sorted(set(cuts))
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("id")))
    group = F.greatest(below(longs([g[0] for g in groups])) - 1, F.lit(0))
    return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(group * step + below(F.get(F.array(*[longs(g) for g in groups]), group)))


def similar_documents(docs: DataFrame, anchors: list[str], id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, n_signatures, component_id, kept): classes of texts whose fingerprints are alike.

    Equal fingerprints are one class. Classes are partitioned by the logarithm of their set
    length, so that alike sets lie in one partition or in neighbouring ones, and meet only on
    the rarest signatures, of which alike sets share one. Empty fingerprints are alike to nothing;
    null ids are linked with nothing; repeated rows share their class.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = cut_lineage(with_signatures(rows, F.col("text"), anchors, "sigs").select("id", "sigs"), "fingerprints")
    some = rows.where("id IS NOT NULL AND size(sigs) > 0")
    classes = cut_lineage(some.groupBy("sigs").agg(F.min("id").alias("rep")).select("rep", "sigs", F.size("sigs").alias("n")), "classes")
    postings = classes.select("rep", "n", F.explode("sigs").alias("sig"))
    common = postings.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = postings.join(common, "sig", "left").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("v"))
    front = F.col("n") - F.ceil(F.col("n") * F.lit(least)).cast("int") + 1
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least))).cast("int")
    lists = ranked.select("rep", "n", band.alias("band"), F.explode(F.slice("v", F.lit(1), front)).alias("v")).where("v.df > 1").select("rep", "n", "band", "v.sig")
    left = lists.select("sig", F.col("rep").alias("a"), F.col("n").alias("na"), "band")
    right = lists.select("sig", F.col("rep").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    # the smaller set is the right one, in the left one's partition or the one below it
    alike = (F.col("nb") >= F.col("na") * F.lit(least)) & ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a"))))
    pairs = left.join(right, ["sig", "band"]).where(alike).select("a", "b").distinct()
    side = lambda end: classes.select(F.col("rep").alias(end), F.col("sigs").alias(f"s{end}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(likeness(F.col("sa"), F.col("sb"), least) >= least).select("a", "b")
    parts = connected_components(links).withColumnRenamed("node", "rep")
    named = classes.join(parts, "rep", "left").select("sigs", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, "sigs", "left").select("id", F.size("sigs").cast("bigint").alias("n_signatures"), F.coalesce("component", "id").alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_signatures", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
