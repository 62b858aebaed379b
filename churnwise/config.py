"""Fixed values and tunable parameters.

The values in the FIXED VALUES block must equal the ones the retention
pipeline was specified with, otherwise results differ (thresholds, names,
template texts).  They are listed plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the specified pipeline)
# ---------------------------------------------------------------------------

HORIZON_DAYS = 90                 # target window length before the last order
N_CLUSTERS = 4                    # K-Means k
K_SWEEP = tuple(range(2, 9))      # k values evaluated for the elbow / silhouette
TEST_SIZE = 0.2
RANDOM_STATE = 42
N_INIT = 10                       # K-Means restarts
N_TREES = 200
MAX_DEPTH = 6
LEARNING_RATE = 0.1
ROW_SAMPLE = 0.8
FEATURE_SAMPLE = 0.8
MAX_BINS = 32                     # split candidates per feature
HIGH_RISK_CUT = 0.5               # churn probability >= cut -> high risk
HIGH_VALUE_CUT = 0.5              # monetary percentile >= cut -> high value
ACTIVATION_CHURN_MIN = 0.85
ACTIVATION_CLV_MIN = 100.0
TIER_PERCENTILES = (0.95, 0.80, 0.50)          # platinum, gold, silver
FALLBACK_TIERS = (500.0, 200.0, 100.0)         # platinum, gold, silver
EXPLAIN_TOP_N = 100
HIST_BINS = 50
TOP_EXPLAINED_SERVED = 20
DRILLDOWN_LIMIT = 100
TOP_CLV_SERVED = 20

SEGMENT_NAMES = ("Champions", "Loyalists", "At-Risk", "Hibernating")

SEGMENT_DESCRIPTIONS = {
    "Champions": "High spend, high frequency, recent purchases. Your best customers.",
    "Loyalists": "Consistent buyers with moderate spend. Reliable revenue base.",
    "At-Risk": "Previously active but engagement is declining. Intervention needed.",
    "Hibernating": "Inactive for a long time, low spend. Likely already lost.",
}

ACTIONS = ("SAVE_NOW", "LET_GO", "NURTURE", "MONITOR")

ACTION_DESCRIPTIONS = {
    "SAVE_NOW": "High Value + High Churn Risk — Send retention offer immediately.",
    "LET_GO": "Low Value + High Churn Risk — Not worth the intervention cost.",
    "NURTURE": "High Value + Low Churn Risk — Reward loyalty, give early access.",
    "MONITOR": "Low Value + Low Churn Risk — Keep an eye, no urgent action.",
}

# action -> (channel, template, subject, discount_pct, urgency, description)
ACTION_TEMPLATES = {
    "SAVE_NOW": ("email", "win_back_vip", "We miss you! Here's 20% off your next order 💜", 20, "HIGH",
                 "VIP recovery email with 20% discount code"),
    "NURTURE": ("email", "loyalty_reward", "You're a star ⭐ Unlock early access to new arrivals!", 0, "LOW",
                "Loyalty nurture — early access, no discount needed"),
    "MONITOR": ("none", "no_action", "", 0, "NONE", "No action required — customer is stable"),
    "LET_GO": ("none", "no_action", "", 0, "NONE", "Low-value churned customer — do not spend budget"),
}
ACTIVATED_ACTIONS = ("SAVE_NOW", "NURTURE")
ACTIVATION_STATUS = "SIMULATED"

FEATURE_COLS = (
    "recency",
    "frequency",
    "monetary",
    "avg_order_value",
    "avg_review_score",
    "total_items",
    "unique_categories",
    "avg_delivery_delay",
    "purchase_span_days",
    "avg_days_between_purchases",
)

FEATURE_LABELS = {
    "recency": "Days since last purchase",
    "frequency": "Number of orders placed",
    "monetary": "Total amount spent",
    "avg_order_value": "Average order value",
    "avg_review_score": "Average review rating given",
    "total_items": "Total items purchased",
    "unique_categories": "Number of product categories explored",
    "avg_delivery_delay": "Average delivery delay (days)",
    "purchase_span_days": "Time span of purchasing history",
    "avg_days_between_purchases": "Average gap between purchases",
}

TIER_NAMES = ("Platinum", "Gold", "Silver", "Bronze")
TIER_SHARE_LABELS = ("Top 5%", "Top 20%", "Top 50%", "Bottom 50%")

# ---------------------------------------------------------------------------
# Tunable parameters (defaults are the fixed values above)
# ---------------------------------------------------------------------------

# training rows of one partition: the layout of the training frames follows the data, not the cluster
TRAIN_ROWS_PER_PARTITION = 200_000

# value ranges of the distributed ranking / quantile operator: each range is
# one window task over distinct values, so more ranges = more parallelism
RANK_BUCKETS = 256


@dataclass(frozen=True)
class Params:
    horizon_days: int = HORIZON_DAYS
    n_clusters: int = N_CLUSTERS
    k_sweep: tuple = K_SWEEP
    n_init: int = N_INIT
    # the k sweep scores the silhouette of every such row, each against all rows (1: all of them; work is their product)
    silhouette_every: int = 1
    test_size: float = TEST_SIZE
    seed: int = RANDOM_STATE
    n_trees: int = N_TREES
    max_depth: int = MAX_DEPTH
    learning_rate: float = LEARNING_RATE
    row_sample: float = ROW_SAMPLE
    feature_sample: float = FEATURE_SAMPLE
    churn_threshold: float = ACTIVATION_CHURN_MIN
    clv_threshold: float = ACTIVATION_CLV_MIN
    explain_top_n: int = EXPLAIN_TOP_N
    # number of value ranges used by the distributed exact ranking / quantiles
    rank_buckets: int = RANK_BUCKETS
    feature_cols: tuple = field(default=FEATURE_COLS)
