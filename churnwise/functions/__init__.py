from churnwise.functions.scalar import (  # noqa: F401
    add_days, assign_action, assign_clv_tier, day_diff, explanation_text, mean_exact,
    feature_label, finite_or_zero, money, money_sum, parse_ts, round_half_even,
)
