"""Column-level helpers (all built-in expressions, no Python UDF).

Notes on semantics that differ from the obvious Spark function:

* day differences floor (-2 h is -1 day), so ``datediff`` / ``timestamp_diff
  (DAY)`` are not used;
* rounding is half-to-even on the scaled double (``rint(x * 10^d) / 10^d``),
  Spark's ``round`` is half-up and ``bround`` works on the decimal string;
* money is summed as a decimal so that a sum does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnwise import config

_MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_diff(end, start) -> Column:
    """Whole days from ``start`` to ``end``, floored."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return F.floor(micros / F.lit(_MICROS_PER_DAY)).cast("int")


def add_days(ts, days: int) -> Column:
    """``ts`` plus a whole number of days as an exact day-time interval."""
    return _c(ts) + F.make_dt_interval(F.lit(int(days)))


def parse_ts(c) -> Column:
    """Timestamp parse where an invalid value becomes null."""
    return F.try_to_timestamp(_c(c))


def round_half_even(c, digits: int = 2) -> Column:
    """Half-to-even rounding on the scaled double."""
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def money(c) -> Column:
    """A money value as an exact decimal (six places keep any 2-4 place input exact)."""
    return _c(c).cast("decimal(38,6)")


def money_sum(c) -> Column:
    """Order-independent sum of a money column, returned as double."""
    return F.sum(money(c)).cast("double")


def finite_or_zero(c) -> Column:
    """+-Inf and NaN become null, then null becomes 0."""
    x = _c(c).cast("double")
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(F.when(bad, F.lit(None)).otherwise(x), F.lit(0.0))


def assign_action(prob, pct, risk_cut: float = config.HIGH_RISK_CUT,
                  value_cut: float = config.HIGH_VALUE_CUT) -> Column:
    """2x2 quadrant of churn risk and value."""
    high_risk = _c(prob) >= F.lit(risk_cut)
    high_value = _c(pct) >= F.lit(value_cut)
    return (F.when(high_value & high_risk, "SAVE_NOW")
            .when(~high_value & high_risk, "LET_GO")
            .when(high_value & ~high_risk, "NURTURE")
            .otherwise("MONITOR"))


def assign_clv_tier(clv, platinum=None, gold=None, silver=None) -> Column:
    """Tier by thresholds; missing thresholds fall back to the fixed ones."""
    fp, fg, fs = config.FALLBACK_TIERS
    p = _c(platinum) if platinum is not None else F.lit(fp)
    g = _c(gold) if gold is not None else F.lit(fg)
    s = _c(silver) if silver is not None else F.lit(fs)
    v = _c(clv)
    return (F.when(v >= p, "Platinum")
            .when(v >= g, "Gold")
            .when(v >= s, "Silver")
            .otherwise("Bronze"))


def feature_label(name_col) -> Column:
    """Feature name -> readable label, unknown names map to themselves."""
    pairs = []
    for k, v in config.FEATURE_LABELS.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    return F.coalesce(F.element_at(m, _c(name_col)), _c(name_col))


def explanation_text(label, value, contribution) -> Column:
    """``"{label} = {value:.1f} (increases|decreases churn risk)"``."""
    direction = F.when(_c(contribution) > 0, "increases").otherwise("decreases")
    # pre-round half-to-even: Java's %.1f rounds half-up on the shortest decimal form
    return F.format_string("%s = %.1f (%s churn risk)", _c(label), round_half_even(value, 1), direction)


def mean_exact(c) -> Column:
    """Mean of a value with at most six decimals, independent of row order."""
    return F.sum(money(c)).cast("double") / F.count(_c(c))
