"""Equal-width histograms with empty bins kept.

Bins follow ``pandas.cut(x, bins=n)``: ``n + 1`` evenly spaced edges over
[min, max], right-closed, the first edge lowered by 0.1 % of the range so the
minimum falls in the first bin (a zero range is widened by 0.1 % on both
sides instead).  Membership uses the exact edges.  The label of a bin is the
midpoint of its *display* edges: every edge rounded to the smallest number
of significant digits (3 to 19) that keeps all edges distinct, the first one
lowered by one unit of that precision; the midpoint is then rounded to 2
places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnwise import config
from churnwise.functions.scalar import round_half_even


def _edges(mn: Column, mx: Column, bins: int):
    same = mn == mx
    pad_lo = F.when(mn != 0, F.abs(mn) * 0.001).otherwise(F.lit(0.001))
    pad_hi = F.when(mx != 0, F.abs(mx) * 0.001).otherwise(F.lit(0.001))
    lo = F.when(same, mn - pad_lo).otherwise(mn)
    hi = F.when(same, mx + pad_hi).otherwise(mx)
    step = (hi - lo) / F.lit(float(bins))
    first = F.when(same, lo).otherwise(lo - (hi - lo) * 0.001)

    def edge(i: Column) -> Column:
        return (F.when(i <= 0, first).when(i >= bins, hi)
                .otherwise(i.cast("double") * step + lo))
    return lo, step, edge


def _bin_of(x: Column, lo: Column, step: Column, edge, bins: int) -> Column:
    """Index b with edge(b) < x <= edge(b + 1): an arithmetic guess corrected
    against the exact edges (so rounding never puts x in a neighbour bin)."""
    guess = F.least(F.greatest(F.ceil((x - lo) / step) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (F.when((guess > 0) & (x <= edge(guess)), guess - 1)
            .when((guess < bins - 1) & (x > edge(guess + 1)), guess + 1)
            .otherwise(guess))


def _round_frac(x: Column, precision) -> Column:
    """Round to ``precision`` significant digits below 1, else to ``precision`` places."""
    p = F.lit(precision) if isinstance(precision, int) else precision
    digits = F.when(F.abs(x) < 1, -F.floor(F.log10(F.abs(x))) - 1 + p).otherwise(p)
    f = F.pow(F.lit(10.0), F.abs(digits))
    r = F.when(digits >= 0, F.rint(x * f) / f).otherwise(F.rint(x / f) * f)
    return F.when((x == 0) | F.isnan(x), x).otherwise(r)


def _rounder(precision):
    return lambda e: _round_frac(e, precision)


def _label_frame(rng: DataFrame, bins: int) -> DataFrame:
    """(bin_index, bin) label rows from the one-row (mn, mx) frame, built in
    separate projections so each array is computed once."""
    _, _, edge = _edges(F.col("mn"), F.col("mx"), bins)
    t = rng.select(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: edge(i)).alias("edges"))
    # one lambda over the precisions: a plan that names each of them takes longer to compile than to run
    fits = F.filter(F.sequence(F.lit(3), F.lit(19)), lambda p: F.size(F.array_distinct(F.transform("edges", _rounder(p)))) == bins + 1)
    t = t.select("edges", F.coalesce(F.get(fits, 0), F.lit(3)).alias("prec"))
    t = t.select(F.transform("edges", lambda e, i: F.when(i == 0, _round_frac(e, F.col("prec"))
                                                          - F.pow(F.lit(10.0), -F.col("prec")))
                             .otherwise(_round_frac(e, F.col("prec")))).alias("breaks"))
    mids = F.transform(F.sequence(F.lit(1), F.lit(bins)),
                       lambda i: round_half_even((F.element_at("breaks", i) + F.element_at("breaks", i + 1)) * 0.5, 2))
    return t.select(F.posexplode(mids).alias("bin_index", "bin"))


def histogram(df: DataFrame, col: str, bins: int = config.HIST_BINS,
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts per bin (and per group), every bin present.

    The edges are computed over the whole frame (one global range for all
    groups, as a shared-axis chart needs), as scalar subqueries.
    """
    g = list(group_cols)
    x = F.col(col)
    rng = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"))
    mm = rng.select(F.struct("mn", "mx").alias("s")).scalar()      # one subquery for both ends
    mn, mx = F.col("_ends.mn"), F.col("_ends.mx")
    lo, step, edge = _edges(mn, mx, bins)
    placed = df.filter(x.isNotNull()).select(*g, x.alias("_x"), mm.alias("_ends"))
    counts = (placed.groupBy(*g, _bin_of(F.col("_x"), lo, step, edge, bins).alias("bin_index"))
              .agg(F.count(F.lit(1)).alias("count")))
    # the labels come from the same subquery: the frame is scanned once for its ends
    labels = _label_frame(df.sparkSession.range(1).select(mm.alias("_ends")).select("_ends.mn", "_ends.mx"), bins)
    if g:
        keys = df.select(*g).distinct()
        frame = keys.select(*g, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index"))
        frame = frame.join(F.broadcast(labels), "bin_index")            # `bins` rows
    else:
        frame = labels
    return (frame.join(counts, [*g, "bin_index"], "left")
            .select(*g, "bin_index", "bin", F.coalesce("count", F.lit(0)).alias("count")))
