"""Ordered work inside a key when one key may hold a third of all rows.

A plain ``Window.partitionBy(key)`` would sort such a key in a single task.
Here every key is cut into chunks by an expression that grows with the order;
windows run inside (key, chunk) and a summary of one row per chunk carries the
state across chunk borders. The large side is shuffled once by (key, chunk),
and the summary join reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: list[Column],
    attach: DataFrame | None = None,
    **scans: tuple,
) -> DataFrame:
    """Add one column per scan; ``order`` must be a total, ascending order.

    ``chunk`` expressions must never fall along ``order``. Keys must not be
    null. Scans: ``("number",)`` position from 1; ``("sum_before", c)``,
    ``("min_before", c)``, ``("max_before", c)`` over earlier rows;
    ``("last", c)`` latest non-null so far; ``("lag", c)``, ``("lead", c)``;
    ``("count",)``, ``("sum", c)``, ``("min", c)``, ``("max", c)`` of the whole
    key. ``attach`` is a frame of one row per key whose columns are added to
    the rows (inner join); it meets the chunk summaries, not the rows, so a hot
    key costs nothing.
    """
    ck = [f"__chunk{i}" for i in range(len(chunk))]
    df = df.withColumns(dict(zip(ck, chunk)))
    local = Window.partitionBy(*keys, *ck).orderBy(*order)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(*ck)
    outer_earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    outer_all = Window.partitionBy(*keys)
    position = F.struct(*[F.col(o) for o in order])

    rows, summary, carried, result = {}, [], {}, {}
    for name, (kind, *rest) in scans.items():
        here, part, carry = f"__{name}_here", f"__{name}_part", f"__{name}_carry"
        value = _c(rest[0]) if rest else None
        if kind == "number":
            rows[here] = F.row_number().over(local).cast("long")
            summary.append(F.count(F.lit(1)).alias(part))
            carried[carry] = F.coalesce(F.sum(part).over(outer_earlier), F.lit(0))
            result[name] = F.col(here) + F.col(carry)
        elif kind == "sum_before":
            rows[here] = F.coalesce(F.sum(value).over(earlier), F.lit(0))
            summary.append(F.coalesce(F.sum(value), F.lit(0)).alias(part))
            carried[carry] = F.coalesce(F.sum(part).over(outer_earlier), F.lit(0))
            result[name] = F.col(here) + F.col(carry)
        elif kind in ("min_before", "max_before"):
            agg, pick = (F.min, F.least) if kind == "min_before" else (F.max, F.greatest)
            rows[here] = agg(value).over(earlier)
            summary.append(agg(value).alias(part))
            carried[carry] = agg(part).over(outer_earlier)
            result[name] = pick(F.col(here), F.col(carry))
        elif kind == "last":
            rows[here] = F.last(value, ignorenulls=True).over(upto)
            summary.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(part))
            carried[carry] = F.last(part, ignorenulls=True).over(outer_earlier)
            result[name] = F.coalesce(F.col(here), F.col(carry))
        elif kind in ("lag", "lead"):
            wrapped = F.struct(value.alias("v"))
            step, edge = (F.lag, F.max_by) if kind == "lag" else (F.lead, F.min_by)
            rows[here] = step(wrapped).over(local)
            summary.append(edge(wrapped, position).alias(part))
            carried[carry] = step(part).over(outer)
            result[name] = F.coalesce(F.col(here), F.col(carry))["v"]
        elif kind in ("count", "sum", "min", "max"):
            agg = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[kind]
            inner = F.count(F.lit(1)) if kind == "count" else agg(value)
            summary.append(inner.alias(part))
            carried[carry] = agg(part).over(outer_all)
            result[name] = F.col(carry)
        else:
            raise ValueError(f"unknown scan {kind!r}")

    if not summary:
        summary = [F.count(F.lit(1)).alias("__rows")]
    states = df.groupBy(*keys, *ck).agg(*summary).withColumns(carried).select(*keys, *ck, *carried)
    if attach is not None:
        states = states.join(attach, keys)
    out = df.withColumns(rows) if rows else df
    out = out.join(states, [*keys, *ck])
    return out.withColumns(result).drop(*ck, *rows, *carried)


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column | str,
    probs: list[float],
    resolution: float = 1.0,
) -> DataFrame:
    """Exact quantiles (linear interpolation) as rows (keys, prob, value).

    Equal values collapse to one counted row before any ordering, and values
    are ordered in chunks of ``resolution``, so neither a hot value nor a hot
    key lands in one task. ``percentile`` would keep every distinct value of a
    key in a single buffer.
    """
    counted = df.where(_c(value).isNotNull()).groupBy(*keys, _c(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    scanned = ordered_scan(
        counted, keys, ["__v"], [F.floor(F.col("__v") / F.lit(resolution))],
        __before=("sum_before", "__n"), __total=("sum", "__n"),
    )
    inside = lambda rank: (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__n"))
    spot = lambda p: p * (F.col("__total") - 1)
    hits = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: inside(F.floor(spot(p))) | inside(F.ceil(spot(p))),
    )
    picked = scanned.withColumn("prob", F.explode(hits))
    rank = spot(F.col("prob"))
    bounds = picked.groupBy(*keys, "prob").agg(
        F.max(F.when(inside(F.floor(rank)), F.col("__v"))).alias("__lo"),
        F.max(F.when(inside(F.ceil(rank)), F.col("__v"))).alias("__hi"),
        F.max(rank - F.floor(rank)).alias("__frac"),
    )
    return bounds.select(*keys, "prob", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias("value"))


def upper_middle(df: DataFrame, keys: list[str], value: Column | str, resolution: float = 1.0) -> DataFrame:
    """The value at sorted index ``n div 2`` of each key."""
    counted = df.where(_c(value).isNotNull()).groupBy(*keys, _c(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    scanned = ordered_scan(
        counted, keys, ["__v"], [F.floor(F.col("__v") / F.lit(resolution))],
        __before=("sum_before", "__n"), __total=("sum", "__n"),
    )
    middle = F.floor(F.col("__total") / 2)
    hit = (middle >= F.col("__before")) & (middle < F.col("__before") + F.col("__n"))
    return scanned.where(hit).select(*keys, F.col("__v").alias("median"))
