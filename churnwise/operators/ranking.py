"""Exact ranking and quantiles without a single-partition window.

A plain ``percent_rank().over(Window.orderBy(v))`` or an exact ``percentile``
moves every row (or every distinct value) through one task.  Here:

1. rows collapse to distinct ``(group, value)`` with a count (map-side
   partial aggregation, so a value held by a third of all rows is one row);
2. the distinct values are cut into ``buckets`` value ranges whose bounds come
   from a ``percentile_approx`` sketch (bounded memory, evaluated once as a
   scalar subquery);
3. per (group, range) row totals get a running sum over the few ranges; within
   a range a window over the distinct values finishes the running count.

The result, :func:`value_positions`, says for each distinct value how many
rows of its group sort before it.  Average rank, percentile and quantiles are
plain expressions on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnwise import config


def value_positions(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                    buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Distinct ``(group..., value)`` with ``cnt`` (rows holding it),
    ``before`` (rows of the group with a smaller value) and ``n`` (non-null
    rows of the group)."""
    g = list(group_cols)
    v = F.col(value_col)
    vc = df.filter(v.isNotNull()).groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("cnt"))
    if buckets > 1:
        probs = [i / buckets for i in range(1, buckets)]
        bounds = vc.agg(F.percentile_approx(value_col, probs, 10_000).alias("b")).scalar()
        vc = vc.withColumn("_bounds", bounds)
        bucket = _count_below(F.col("_bounds"), v, buckets - 1)
    else:
        bucket = F.lit(0)
    vc = vc.withColumn("_bucket", bucket).drop("_bounds")
    per_bucket = vc.groupBy(*g, "_bucket").agg(F.sum("cnt").alias("_bcnt"))
    wb = Window.partitionBy(*g).orderBy("_bucket")
    per_bucket = per_bucket.select(
        *g, "_bucket",
        (F.sum("_bcnt").over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         - F.col("_bcnt")).alias("_offset"),
        F.sum("_bcnt").over(Window.partitionBy(*g)).alias("n"))
    wv = Window.partitionBy(*g, "_bucket").orderBy(value_col)
    inside = F.sum("cnt").over(wv.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cnt")
    vc = vc.withColumn("_inside", inside)
    return (vc.join(per_bucket, on=[*g, "_bucket"], how="inner")
            .select(*g, value_col, "cnt", (F.col("_offset") + F.col("_inside")).alias("before"), "n"))


def _count_below(bounds, v, n_bounds: int):
    """Number of the ``n_bounds`` sorted bounds below ``v`` in about 2*sqrt(n)
    plain comparisons (codegen'd, unlike a lambda over the array): count the
    every-``s``-th bounds below ``v``, then the bounds inside that segment."""
    s = max(1, math.isqrt(n_bounds))

    def below(i):
        return F.when(F.try_element_at(bounds, i) < v, 1).otherwise(0)
    coarse = sum((below(F.lit(s * k)) for k in range(1, n_bounds // s + 1)), F.lit(0))
    fine = sum((below(coarse * s + j) for j in range(1, s)), F.lit(0))
    return coarse * s + fine


def avg_rank_pct(df: DataFrame, value_col: str, out_col: str, group_cols: Sequence[str] = (),
                 buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Adds ``out_col`` = average rank / n, ascending, ties share the mean
    rank; null values get null (pandas ``rank(pct=True)``)."""
    pos = value_positions(df, value_col, group_cols, buckets)
    pct = (F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)) / F.col("n")
    pos = pos.select(*group_cols, value_col, pct.alias(out_col))
    return df.join(pos, on=[*group_cols, value_col], how="left")


def _pick(pos_before, pos_cnt, j, value):
    return F.max(F.when((pos_before <= j) & (j < pos_before + pos_cnt), value))


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, group_cols: Sequence[str] = (),
                    buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """Exact linearly interpolated quantiles (numpy ``percentile`` default),
    one row per group with one column per probability."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    pos = value_positions(df, value_col, group_cols, buckets)
    b, c, n, v = F.col("before"), F.col("cnt"), F.col("n"), F.col(value_col)
    aggs, finals = [F.max(n).alias("_n")], []
    for i, p in enumerate(probs):
        h = (n - 1) * F.lit(float(p))
        j0 = F.floor(h)
        j1 = F.least(j0 + 1, n - 1)
        aggs += [_pick(b, c, j0, v).alias(f"_lo{i}"), _pick(b, c, j1, v).alias(f"_hi{i}")]
    out = pos.groupBy(*group_cols).agg(*aggs)
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        finals.append((lo + frac * (hi - lo)).alias(names[i]))
    return out.select(*group_cols, *finals)


def exact_quantile_value(df: DataFrame, value_col: str, p: float, buckets: int = config.RANK_BUCKETS):
    """One global quantile as a scalar-subquery column (lazy, nothing collected)."""
    return exact_quantiles(df, value_col, [p], ["q"], buckets=buckets).select("q").scalar()
