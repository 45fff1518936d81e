"""Mixing sources to target weights: token totals raked to marginals, documents drawn accordingly."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.hashing import uniform
from lexiloom.llm.common import BROADCAST_ROWS
from lexiloom.operators.joins import spread_join
from lexiloom.session import cut_lineage

SEED = 17
KEEP = 0.8  # share of all tokens that the mix is to hold
TOWARDS_EVEN = 0.25  # how far targets go from the present shares towards equal ones
ROUNDS, MOST_ROUNDS, TOLERANCE = 4, 60, 0.001  # passes at least and at most, and how far a factor may still move
MARGINALS = ("source", "lang", "topic")
# What a text is about by its form, the first that applies. Patterns run on whole texts.
TOPICS = (
    ("code", r"[A-Za-z_]\w* ?[=:] ?[\"']"),
    ("contact", r"[\w.]+@[\w.]+|\(\d{3}\) \d{3}"),
    ("license", r"(?i)licen[cs]e|copyright"),
    ("marked", r"[%*#&$]{3}"),
)


# What every match of a topic's pattern holds; quicker to look for, and without it the pattern is not tried.
HINTS = {"code": r"[=:] ?[\"']", "contact": r"[@(]"}


def topic_of(text: Column) -> Column:
    text, out = F.coalesce(text, F.lit("")), F.lit("prose")
    for name, pattern in reversed(TOPICS):
        hit = text.rlike(HINTS[name]) & text.rlike(pattern) if name in HINTS else text.rlike(pattern)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words between white space; a null, empty or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")


def default_targets(cells: DataFrame, column: str, keep: float = KEEP, towards_even: float = TOWARDS_EVEN) -> DataFrame:
    """(value, share): present shares of tokens moved towards equal ones, as far as the tokens reach.

    No value grows by more than the cube root of 1 / ``keep``: a cell whose three values all grow is then
    wanted about as much as it has when the mix holds ``keep`` of all tokens. What the scarce values may not
    take stays with the values that shrink.
    """
    now = cells.groupBy(F.col(f"k_{column}").alias("value")).agg(F.sum("tokens").alias("tokens"))
    whole = now.agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n"))
    # one row
    rows = now.join(F.broadcast(whole), how="cross").select("value", (F.col("tokens") / F.col("all")).alias("now"), (1 / F.col("n")).alias("even"))
    most = keep ** (-1 / len(MARGINALS))
    aim = (1 - towards_even) * F.col("now") + towards_even * F.col("even")
    rows = rows.select("value", "now", F.greatest(F.least(aim, F.col("now") * most) - F.col("now"), F.lit(0.0)).alias("more"), F.greatest(F.col("now") - aim, F.lit(0.0)).alias("less"))
    sums = rows.agg(F.sum("more").alias("given"), F.sum("less").alias("free"))
    given = F.when(F.col("free") > 0, F.col("given") / F.col("free")).otherwise(0.0)
    return rows.join(F.broadcast(sums), how="cross").select("value", (F.col("now") + F.col("more") - F.col("less") * given).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[str, DataFrame]:
    """{marginal: (value, share, factor)}: factors of a table of shares that meets all the marginals, by iterative proportional fitting.

    A cell's share of the mix is its tokens times the factors of its values. A step sets one marginal's
    factors so that its sums meet the targets; only these small tables are kept, so every step's plan is the
    same two joins and one sum. ``rounds`` passes over all marginals are made, then more, up to MOST_ROUNDS, while a
    factor still moves by more than ``tolerance`` of itself; a warning says when that did not help, as no mix
    of the given cells meets the targets.
    """
    factors = {c: cut_lineage(shares.where("value IS NOT NULL").select("value", "share", F.lit(1.0).alias("factor"), F.lit(1.0).alias("moved")), "factors") for c, shares in targets.items()}
    for nth in range(MOST_ROUNDS):
        for column in targets:
            rows = cells
            for other in targets:
                if other != column:
                    rows = rows.join(_factor(factors, other), f"k_{other}")
            weight = F.col("tokens").cast("double")
            for other in targets:
                if other != column:
                    weight = weight * F.col(f"f_{other}")
            now = rows.groupBy(F.col(f"k_{column}").alias("value")).agg(F.sum(weight).alias("now"))
            new = F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0)
            old = factors[column].select("value", "share", "factor")
            factors[column] = cut_lineage(old.join(now, "value").select(
                "value", "share", new.alias("factor"), F.when(new > 0, F.abs(F.col("factor") / new - 1)).otherwise(0.0).alias("moved")), "factors")
        if nth + 1 >= rounds:
            moved = max(f.agg(F.max("moved")).first()[0] or 0.0 for f in factors.values())
            if moved <= tolerance:
                break
    else:
        warnings.warn(f"mix: no such mix of the given cells was found; factors still move by {moved:.1%}", stacklevel=2)
    return factors


def _factor(factors: dict[str, DataFrame], column: str) -> DataFrame:
    return factors[column].select(F.col("value").alias(f"k_{column}"), F.col("share").alias(f"wanted_{column}"), F.col("factor").alias(f"f_{column}"))


def key_of(value: Column) -> Column:
    """A value's name in targets, null being a value like any other."""
    return F.to_json(F.struct(value.alias("v")))


def mix_documents(docs: DataFrame, keep: float = KEEP, seed: int = SEED, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, drawn, wanted_*, drawn_*) of every row of ``documents``.

    Token totals of the cells of source, language and topic are raked until all three marginals meet their
    targets. The mix is then as large as it can be without a document taken twice: the cell that is wanted most
    for what it has is drawn whole, every other one with a probability in proportion, by a hash of the
    document's id, so any retry draws the same ones. ``wanted_source`` and so on are the targets of the row's
    values, ``drawn_source`` and so on their shares of the tokens that were drawn.

    ``targets`` gives (value, share) for each marginal, the value as ``key_of`` names it; a value without a share is not
    wanted. Without targets, shares go part of the way to equal ones as far as a mix of about ``keep`` of all tokens allows.

    Cases. Null sources and languages are values like any other; null texts have no tokens and
    the topic of prose. A cell without tokens is drawn whole, as it costs nothing, and has no shares. Rows with one id
    are drawn alike if they lie in one cell; null ids share one draw. An empty table gives an empty one. Other columns
    are not read.
    """
    rows = docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), token_count(F.col("text")).alias("n_tokens"))
    keys = [f"k_{c}" for c in MARGINALS]
    rows = cut_lineage(rows.withColumns({f"k_{c}": key_of(F.col(c)) for c in MARGINALS}).withColumn("cell", F.concat_ws(",", *keys)), "rows")
    cells = cut_lineage(rows.where("n_tokens > 0").groupBy("cell", *keys).agg(F.sum("n_tokens").alias("tokens")), "cells")
    factors = rake(cells, targets or {c: default_targets(cells, c, keep) for c in MARGINALS})
    raked = cells
    for c in MARGINALS:
        raked = raked.join(_factor(factors, c), f"k_{c}", "left")
    product = F.col("f_source") * F.col("f_lang") * F.col("f_topic")
    raked = cut_lineage(raked.select("cell", *keys, *[f"wanted_{c}" for c in MARGINALS], F.coalesce(product, F.lit(0.0)).alias("rate")), "raked")
    top = raked.agg(F.max("rate")).first()[0] or 1.0
    chance = raked.withColumn("probability", F.round(F.col("rate") / F.lit(top), 6))

    few = chance.count() <= BROADCAST_ROWS
    unit = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed=seed)
    out = _by_cell(rows.drop(*keys), chance.select("cell", "probability"), few)
    out = out.withColumn("probability", F.coalesce("probability", F.lit(1.0))).withColumn("drawn", unit < F.col("probability"))
    # sums of cells, not of documents, are put together for each marginal
    taken = out.where("drawn").groupBy("cell").agg(F.sum("n_tokens").alias("taken"))
    taken = cut_lineage(chance.join(taken, "cell", "left").withColumn("taken", F.coalesce("taken", F.lit(0))), "taken")
    whole = taken.agg(F.sum("taken")).first()[0] or 1
    for c in MARGINALS:
        sums = taken.groupBy(f"k_{c}").agg(F.sum("taken").alias("sum")).select(f"k_{c}", F.round(F.col("sum") / F.lit(float(whole)), 6).alias(f"drawn_{c}"))
        taken = taken.join(sums, f"k_{c}")
    shares = [f"{kind}_{c}" for kind in ("wanted", "drawn") for c in MARGINALS]
    named = taken.select("cell", *[F.round(F.coalesce(f"wanted_{c}", F.lit(0.0)), 6).alias(f"wanted_{c}") for c in MARGINALS], *shares[len(MARGINALS):])
    return _by_cell(out, cut_lineage(named, "shares"), few).select("doc_id", *MARGINALS, "n_tokens", "probability", "drawn", *shares)


def _by_cell(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(cells), "cell", "left") if few else spread_join(rows, cells, ["cell"], "left", ["doc_id"])


def mix_report(mixed: DataFrame) -> DataFrame:
    """(marginal, value, wanted, achieved) of every value of a mix that has tokens."""
    parts = [mixed.where("n_tokens > 0").groupBy(F.lit(c).alias("marginal"), F.col(c).alias("value")).agg(F.max(f"wanted_{c}").alias("wanted"), F.max(f"drawn_{c}").alias("achieved")) for c in MARGINALS]
    return reduce(DataFrame.unionAll, parts)
