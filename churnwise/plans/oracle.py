"""DuckDB twins of the registered queries (the correctness oracle).

Each entry is one self-contained SQL statement over the driver's views
(orders, lineitem, customer, part, events).  Shared steps are CTE text
pieces; the SQL re-states the adapter mapping of
:mod:`churnwise.sources.testdata` independently of the Spark code.
"""

from __future__ import annotations

from churnwise import config


def r(expr: str, digits: int = 2) -> str:
    """Half-to-even rounding of a double (numpy semantics)."""
    s = 10 ** digits
    return f"(round_even(({expr}) * {s}, 0) / {s})"


def msum(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(38,6))) AS DOUBLE)"


def days(end: str, start: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {start}, {end}) / 86400000000.0) AS INTEGER)"


H = config.HORIZON_DAYS

BASE = f"""
src_orders AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS order_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         CASE o.o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
              WHEN 'P' THEN 'processing' ELSE o.o_orderstatus END AS order_status,
         o.o_orderdate AS order_purchase_timestamp,
         d.delivered AS order_delivered_customer_date,
         o.o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey) d
    ON o.o_orderkey = d.l_orderkey),
src_items AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id, l_extendedprice AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(15,2)) AS DOUBLE) AS freight_value
  FROM lineitem),
src_payments AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_totalprice AS payment_value FROM orders),
src_reviews AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
         CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL
              ELSE CAST(1 + (l_orderkey * 31 + l_linenumber) % 5 AS DOUBLE) END AS review_score,
         l_shipdate AS review_creation_date
  FROM lineitem),
src_customers AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_unique_id FROM customer),
src_products AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS product_category_name FROM part),
pay AS (
  SELECT order_id, COALESCE({msum('payment_value')}, 0.0) AS total_payment
  FROM src_payments WHERE order_id IS NOT NULL GROUP BY order_id),
items_agg AS (
  SELECT i.order_id, COUNT(i.order_item_id) AS n_items,
         COALESCE({msum('i.freight_value')}, 0.0) AS total_freight,
         COUNT(DISTINCT p.product_category_name) AS n_unique_categories
  FROM src_items i LEFT JOIN src_products p ON i.product_id = p.product_id
  WHERE i.order_id IS NOT NULL GROUP BY i.order_id),
rev_latest AS (
  SELECT order_id, review_score FROM (
    SELECT order_id, review_score,
           row_number() OVER (PARTITION BY order_id ORDER BY (review_creation_date IS NULL) DESC,
                              review_creation_date DESC, review_score DESC NULLS LAST) AS rn
    FROM src_reviews WHERE order_id IS NOT NULL) WHERE rn = 1),
rev_first AS (
  SELECT order_id, review_score FROM (
    SELECT order_id, review_score,
           row_number() OVER (PARTITION BY order_id ORDER BY (review_creation_date IS NULL) ASC,
                              review_creation_date ASC, review_score ASC) AS rn
    FROM src_reviews WHERE order_id IS NOT NULL AND review_score IS NOT NULL) WHERE rn = 1),
master AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
         o.order_delivered_customer_date, o.order_estimated_delivery_date,
         c.customer_unique_id, pay.total_payment, rl.review_score,
         it.n_items, it.total_freight, it.n_unique_categories
  FROM src_orders o
  LEFT JOIN src_customers c ON o.customer_id = c.customer_id
  LEFT JOIN pay ON o.order_id = pay.order_id
  LEFT JOIN rev_latest rl ON o.order_id = rl.order_id
  LEFT JOIN items_agg it ON o.order_id = it.order_id),
kept AS (
  SELECT * FROM master
  WHERE order_status = 'delivered' AND customer_unique_id IS NOT NULL AND total_payment > 0),
clean AS (
  SELECT order_id, customer_id, order_status, order_purchase_timestamp,
         order_delivered_customer_date, order_estimated_delivery_date, customer_unique_id,
         total_payment,
         COALESCE(review_score, (SELECT quantile_cont(review_score, 0.5) FROM kept)) AS review_score,
         CAST(COALESCE(n_items, 1) AS INTEGER) AS n_items,
         COALESCE(total_freight, 0.0) AS total_freight,
         CAST(COALESCE(n_unique_categories, 1) AS INTEGER) AS n_unique_categories,
         COALESCE({days('order_delivered_customer_date', 'order_estimated_delivery_date')}, 0)
           AS delivery_delay_days
  FROM kept),
cut AS (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY - INTERVAL {H} DAY AS cutoff FROM clean),
feat_rows AS (SELECT * FROM clean WHERE order_purchase_timestamp < (SELECT cutoff FROM cut)),
tgt_rows AS (SELECT * FROM clean WHERE order_purchase_timestamp >= (SELECT cutoff FROM cut)),
fagg AS (
  SELECT customer_unique_id,
         {days('(SELECT cutoff FROM cut)', 'max(order_purchase_timestamp)')} AS recency,
         COUNT(DISTINCT order_id) AS frequency,
         COALESCE({msum('total_payment')}, 0.0) AS monetary,
         {msum('total_payment')} / COUNT(total_payment) AS avg_order_value,
         SUM(review_score) / COUNT(review_score) AS avg_review_score,
         CAST(SUM(n_items) AS BIGINT) AS total_items,
         CAST(SUM(n_unique_categories) AS BIGINT) AS unique_categories,
         CAST(SUM(delivery_delay_days) AS DOUBLE) / COUNT(delivery_delay_days) AS avg_delivery_delay,
         {days('max(order_purchase_timestamp)', 'min(order_purchase_timestamp)')} AS purchase_span_days
  FROM feat_rows GROUP BY customer_unique_id),
tagg AS (
  SELECT customer_unique_id, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS target_purchases,
         COALESCE({msum('total_payment')}, 0.0) AS target_revenue
  FROM tgt_rows GROUP BY customer_unique_id),
features AS (
  SELECT f.customer_unique_id, f.recency, f.frequency, {r('f.monetary')} AS monetary,
         {r('f.avg_order_value')} AS avg_order_value, {r('f.avg_review_score')} AS avg_review_score,
         f.total_items, f.unique_categories, {r('f.avg_delivery_delay')} AS avg_delivery_delay,
         f.purchase_span_days,
         {r('CASE WHEN f.frequency > 1 THEN f.purchase_span_days / (f.frequency - 1) ELSE 0.0 END')}
           AS avg_days_between_purchases,
         {r('COALESCE(t.target_purchases, 0.0)')} AS target_purchases,
         {r('COALESCE(t.target_revenue, 0.0)')} AS target_revenue,
         CAST(COALESCE(t.target_purchases, 0) = 0 AS INTEGER) AS churned,
         {r('COALESCE(t.target_revenue, 0.0)')} AS clv_target
  FROM fagg f LEFT JOIN tagg t ON f.customer_unique_id = t.customer_unique_id)
"""

FEATURE_SELECT = ("customer_unique_id, recency, frequency, monetary, avg_order_value, avg_review_score, "
                  "total_items, unique_categories, avg_delivery_delay, purchase_span_days, "
                  "avg_days_between_purchases")


def w(*ctes: str) -> str:
    """WITH clause: the shared base plus extra CTEs."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {BASE}{extra}\n"


SQL: dict[str, str] = {}

SQL["payments_per_order"] = w() + "SELECT order_id, total_payment FROM pay"
SQL["items_per_order"] = w() + "SELECT order_id, n_items, total_freight FROM items_agg"
SQL["categories_per_order"] = w() + "SELECT order_id, n_unique_categories FROM items_agg"
SQL["latest_review"] = w() + "SELECT order_id, review_score FROM rev_latest"
SQL["first_review"] = w() + "SELECT order_id, review_score FROM rev_first"
SQL["order_master"] = w() + "SELECT * FROM master"
SQL["clean_orders"] = w() + "SELECT * FROM clean"
SQL["csv_clean_orders"] = SQL["clean_orders"]
SQL["uploaded_orders"] = """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       CASE WHEN o_orderkey % 3 <> 0 THEN date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) END AS order_ts, o_totalprice AS value
FROM orders"""
SQL["time_split_counts"] = w() + """
SELECT (SELECT cutoff FROM cut) AS cutoff_date, COUNT(*) AS n_rows,
       COUNT(*) FILTER (WHERE order_purchase_timestamp < (SELECT cutoff FROM cut)) AS n_feature_rows,
       COUNT(*) FILTER (WHERE order_purchase_timestamp >= (SELECT cutoff FROM cut)) AS n_target_rows,
       COUNT(*) FILTER (WHERE order_purchase_timestamp IS NULL) AS n_undated_rows,
       COUNT(DISTINCT customer_unique_id) FILTER (WHERE order_purchase_timestamp < (SELECT cutoff FROM cut))
         AS n_feature_customers,
       COUNT(DISTINCT customer_unique_id) FILTER (WHERE order_purchase_timestamp >= (SELECT cutoff FROM cut))
         AS n_target_customers
FROM clean"""
SQL["customer_features"] = w() + f"SELECT {FEATURE_SELECT} FROM features"
SQL["feature_matrix"] = w() + "SELECT * FROM features"
SQL["churn_labels"] = w() + ("SELECT customer_unique_id, target_purchases, target_revenue, churned, clv_target "
                             "FROM features")
SQL["target_outcomes"] = w() + "SELECT customer_unique_id, target_purchases, target_revenue FROM tagg"


def quantiles_sql(src: str, val: str, probs, names, groups=()) -> str:
    """Linear-interpolation percentiles (numpy default) per group, written
    out with row positions so the double arithmetic is explicit."""
    g = list(groups)
    gsel = "".join(f"{x}, " for x in g)
    part = f"PARTITION BY {', '.join(g)} " if g else ""
    cols = []
    for p, nm in zip(probs, names):
        h = f"((n - 1) * CAST({p!r} AS DOUBLE))"
        lo = f"MAX(CASE WHEN pos = CAST(floor({h}) AS BIGINT) THEN v END)"
        hi = f"MAX(CASE WHEN pos = LEAST(CAST(floor({h}) AS BIGINT) + 1, n - 1) THEN v END)"
        fr = f"MAX({h} - floor({h}))"
        cols.append(f"{lo} + {fr} * ({hi} - {lo}) AS {nm}")
    gb = f" GROUP BY {', '.join(g)}" if g else ""
    return (f"(SELECT {gsel}{', '.join(cols)} FROM ("
            f"SELECT {gsel}{val} AS v, row_number() OVER ({part}ORDER BY {val}) - 1 AS pos, "
            f"COUNT(*) OVER ({part.strip()}) AS n FROM {src} WHERE {val} IS NOT NULL){gb})")


SCORED = [
    """scored0 AS (
  SELECT f.*,
         round_even(LEAST(CAST(1.0 AS DOUBLE), f.recency / CAST(365.0 AS DOUBLE)) * 10000, 0) / 10000
           AS churn_probability,
         CAST(LEAST(CAST(1.0 AS DOUBLE), f.recency / CAST(365.0 AS DOUBLE)) > 0.5 AS INTEGER) AS churn_prediction,
         CAST(LEAST(3, floor(f.recency / 180)) AS INTEGER) AS cluster,
         round_even(GREATEST(f.monetary / f.frequency, CAST(0.0 AS DOUBLE)) * 100, 0) / 100 AS predicted_clv
  FROM features f)""",
    """mpos AS (SELECT monetary, COUNT(*) AS cnt FROM scored0 WHERE monetary IS NOT NULL GROUP BY monetary)""",
    """mpct AS (
  SELECT monetary,
         (SUM(cnt) OVER (ORDER BY monetary ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cnt
          + (cnt + 1) / CAST(2.0 AS DOUBLE)) / SUM(cnt) OVER () AS monetary_percentile
  FROM mpos)""",
    """scored1 AS (
  SELECT s.*, p.monetary_percentile,
         CASE WHEN p.monetary_percentile > 0.75 THEN 'Champions' WHEN p.monetary_percentile > 0.5 THEN 'Loyalists'
              WHEN p.monetary_percentile > 0.25 THEN 'At-Risk' ELSE 'Hibernating' END AS segment,
         CASE WHEN p.monetary_percentile >= 0.5 AND s.churn_probability >= 0.5 THEN 'SAVE_NOW'
              WHEN p.monetary_percentile < 0.5 AND s.churn_probability >= 0.5 THEN 'LET_GO'
              WHEN p.monetary_percentile >= 0.5 AND s.churn_probability < 0.5 THEN 'NURTURE'
              ELSE 'MONITOR' END AS action
  FROM scored0 s LEFT JOIN mpct p ON s.monetary = p.monetary)""",
    "thr AS " + quantiles_sql("scored1", "predicted_clv", [0.95, 0.8, 0.5], ["platinum", "gold", "silver"]),
    """scored AS (
  SELECT s.*, CASE WHEN s.predicted_clv >= t.platinum THEN 'Platinum' WHEN s.predicted_clv >= t.gold THEN 'Gold'
                   WHEN s.predicted_clv >= t.silver THEN 'Silver' ELSE 'Bronze' END AS clv_tier
  FROM scored1 s, thr t)""",
]


def ws(*ctes: str) -> str:
    return w(*SCORED, *ctes)


LIST = ("customer_unique_id, segment, recency, frequency, monetary, avg_review_score, "
        "churn_probability, action")

SQL["monetary_percentile"] = ws() + "SELECT customer_unique_id, monetary, monetary_percentile FROM scored"
SQL["action_matrix"] = ws() + ("SELECT customer_unique_id, monetary, churn_probability, monetary_percentile, "
                               "segment, action FROM scored")
SQL["action_distribution"] = ws() + f"""
SELECT a.action, COALESCE(c.cnt, 0) AS count,
       {r('COALESCE(c.cnt, 0) / CAST((SELECT COUNT(*) FROM scored) AS DOUBLE) * 100', 1)} AS pct
FROM (SELECT unnest(['SAVE_NOW', 'LET_GO', 'NURTURE', 'MONITOR']) AS action) a
LEFT JOIN (SELECT action, COUNT(*) AS cnt FROM scored GROUP BY action) c ON a.action = c.action"""
SQL["clv_thresholds"] = ws() + "SELECT platinum, gold, silver FROM thr"
SQL["clv_tiers"] = ws() + "SELECT customer_unique_id, predicted_clv, clv_tier FROM scored"
SQL["tier_table"] = ws() + """
SELECT 0 AS tier_rank, 'Platinum' AS tier, 'Top 5%' AS share, platinum AS threshold FROM thr
UNION ALL SELECT 1, 'Gold', 'Top 20%', gold FROM thr
UNION ALL SELECT 2, 'Silver', 'Top 50%', silver FROM thr
UNION ALL SELECT 3, 'Bronze', 'Bottom 50%', CAST(0.0 AS DOUBLE) FROM thr"""
SQL["segment_distribution"] = ws() + "SELECT segment, COUNT(*) AS count FROM scored GROUP BY segment"
SQL["tier_distribution"] = ws() + "SELECT clv_tier, COUNT(*) AS count FROM scored GROUP BY clv_tier"
SQL["share_by_segment"] = ws() + ("SELECT segment, COUNT(*) AS count, COUNT(*) / CAST((SELECT COUNT(*) FROM scored) "
                                  "AS DOUBLE) AS share FROM scored GROUP BY segment")
SQL["share_by_tier"] = ws() + ("SELECT clv_tier, COUNT(*) AS count, COUNT(*) / CAST((SELECT COUNT(*) FROM scored) "
                               "AS DOUBLE) AS share FROM scored GROUP BY clv_tier")
SQL["segment_summary"] = ws() + f"""
SELECT segment, COUNT(customer_unique_id) AS customer_count,
       {r('AVG(recency)')} AS avg_recency, {r('AVG(frequency)')} AS avg_frequency,
       {r(msum('monetary') + ' / COUNT(monetary)')} AS avg_monetary,
       {r(msum('avg_review_score') + ' / COUNT(avg_review_score)')} AS avg_review_score,
       {r('AVG(churned) * 100', 1)} AS churn_rate
FROM scored GROUP BY segment"""
SQL["rank_and_name_groups"] = ws(f"""csum AS (
  SELECT cluster, AVG(recency) AS mean_recency, AVG(frequency) AS mean_frequency,
         {msum('monetary')} / COUNT(monetary) AS mean_monetary, COUNT(*) AS count
  FROM scored GROUP BY cluster)""", """cscore AS (
  SELECT *, (rank() OVER (ORDER BY mean_monetary) + (COUNT(*) OVER (PARTITION BY mean_monetary) - 1) / 2.0)
          + (rank() OVER (ORDER BY mean_frequency) + (COUNT(*) OVER (PARTITION BY mean_frequency) - 1) / 2.0)
          + (rank() OVER (ORDER BY mean_recency DESC) + (COUNT(*) OVER (PARTITION BY mean_recency) - 1) / 2.0)
          AS score
  FROM csum)""") + """
SELECT cluster, mean_recency, mean_frequency, mean_monetary, count, CAST(score AS DOUBLE) AS score,
       ['Champions', 'Loyalists', 'At-Risk', 'Hibernating']
         [row_number() OVER (ORDER BY score DESC, mean_monetary DESC, cluster)] AS segment
FROM cscore"""
CONF = "confusion AS (SELECT COUNT(*) FILTER (WHERE churned = 0 AND churn_prediction = 0) AS tn, " \
       "COUNT(*) FILTER (WHERE churned = 0 AND churn_prediction = 1) AS fp, " \
       "COUNT(*) FILTER (WHERE churned = 1 AND churn_prediction = 0) AS fn, " \
       "COUNT(*) FILTER (WHERE churned = 1 AND churn_prediction = 1) AS tp FROM scored)"


def dv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / CAST(({b}) AS DOUBLE) ELSE 0.0 END)"


SQL["confusion_counts"] = ws(CONF) + "SELECT tn, fp, fn, tp FROM confusion"
SQL["threshold_metrics"] = ws(CONF) + f"""
SELECT {r(dv('tp + tn', 'tn + fp + fn + tp'), 4)} AS accuracy, {r(dv('2 * tp', '2 * tp + fn + fp'), 4)} AS f1_score,
       {r(dv('tp', 'tp + fp'), 4)} AS precision, {r(dv('tp', 'tp + fn'), 4)} AS recall
FROM confusion"""
_P0, _R0, _F0 = dv('tn', 'tn + fn'), dv('tn', 'tn + fp'), dv('2 * tn', '2 * tn + fp + fn')
_P1, _R1, _F1 = dv('tp', 'tp + fp'), dv('tp', 'tp + fn'), dv('2 * tp', '2 * tp + fn + fp')
_ACC = dv('tn + tp', 'tn + fp + fn + tp')
SQL["classification_report"] = ws(CONF) + f"""
SELECT '0' AS class, {r(_P0, 4)} AS precision, {r(_R0, 4)} AS recall, {r(_F0, 4)} AS f1_score,
       CAST(tn + fp AS BIGINT) AS support FROM confusion
UNION ALL SELECT '1', {r(_P1, 4)}, {r(_R1, 4)}, {r(_F1, 4)}, CAST(tp + fn AS BIGINT) FROM confusion
UNION ALL SELECT 'accuracy', {r(_ACC, 4)}, {r(_ACC, 4)}, {r(_ACC, 4)}, CAST(tn + fp + fn + tp AS BIGINT) FROM confusion
UNION ALL SELECT 'macro avg', {r(f'({_P0} + {_P1}) / 2', 4)}, {r(f'({_R0} + {_R1}) / 2', 4)},
       {r(f'({_F0} + {_F1}) / 2', 4)}, CAST(tn + fp + fn + tp AS BIGINT) FROM confusion
UNION ALL SELECT 'weighted avg', {r(dv(f'{_P0} * (tn + fp) + {_P1} * (tp + fn)', 'tn + fp + fn + tp'), 4)},
       {r(dv(f'{_R0} * (tn + fp) + {_R1} * (tp + fn)', 'tn + fp + fn + tp'), 4)},
       {r(dv(f'{_F0} * (tn + fp) + {_F1} * (tp + fn)', 'tn + fp + fn + tp'), 4)},
       CAST(tn + fp + fn + tp AS BIGINT) FROM confusion"""
SQL["error_analysis"] = ws() + f"""
SELECT k.error_type, COALESCE(a.n, 0) AS n, {r('a.avg_recency', 1)} AS avg_recency,
       {r('a.avg_frequency', 1)} AS avg_frequency
FROM (SELECT unnest(['false_negative', 'false_positive']) AS error_type) k
LEFT JOIN (
  SELECT CASE WHEN churned = 1 AND churn_prediction = 0 THEN 'false_negative' ELSE 'false_positive' END AS error_type,
         COUNT(*) AS n, AVG(recency) AS avg_recency, AVG(frequency) AS avg_frequency
  FROM scored WHERE churned <> churn_prediction GROUP BY 1) a ON k.error_type = a.error_type"""
_E = "(CAST(clv_target AS DECIMAL(18,2)) - CAST(predicted_clv AS DECIMAL(18,2)))"
_Y = "CAST(clv_target AS DECIMAL(18,2))"
SQL["regression_metrics"] = ws(f"""rs AS (
  SELECT COUNT(*) AS n, CAST(SUM(ABS({_E})) AS DOUBLE) AS sae, CAST(SUM({_E} * {_E}) AS DOUBLE) AS sse,
         CAST(SUM({_Y}) AS DOUBLE) AS sy, CAST(SUM({_Y} * {_Y}) AS DOUBLE) AS syy,
         CAST(SUM(CAST(predicted_clv AS DECIMAL(18,2))) AS DOUBLE) AS sp
  FROM scored)""", "pmed AS " + quantiles_sql("scored", "predicted_clv", [0.5], ["m"])) + f"""
SELECT {r('sae / n')} AS mae, {r('sqrt(sse / n)')} AS rmse,
       {r('CASE WHEN syy - sy * sy / n > 0 THEN 1 - sse / (syy - sy * sy / n) WHEN sse = 0 THEN 1.0 ELSE 0.0 END', 4)}
         AS r2_score,
       {r('(SELECT m FROM pmed)')} AS median_predicted_clv, {r('sp / n')} AS mean_predicted_clv
FROM rs"""
SQL["dashboard_kpis"] = ws() + f"""
SELECT COUNT(*) AS total_customers, {r(msum('monetary'))} AS total_revenue,
       {r(msum('avg_order_value') + ' / COUNT(avg_order_value)')} AS avg_order_value,
       {r('AVG(churned) * 100', 1)} AS churn_rate
FROM scored"""
SQL["clv_stats"] = ws("pmed AS " + quantiles_sql("scored", "predicted_clv", [0.5], ["m"])) + f"""
SELECT {r(msum('predicted_clv') + ' / COUNT(predicted_clv)')} AS mean_clv, {r('(SELECT m FROM pmed)')} AS median_clv,
       {r(msum('predicted_clv'))} AS total_predicted_value
FROM scored"""


def rf(x: str, p: str) -> str:
    """pandas display rounding of a bin edge (significant digits below 1)."""
    d = f"(CASE WHEN abs({x}) < 1 THEN -floor(log10(abs({x}))) - 1 + {p} ELSE {p} END)"
    f = f"pow(10.0, abs({d}))"
    return (f"(CASE WHEN {x} = 0 OR isnan({x}) THEN {x} WHEN {d} >= 0 THEN round_even({x} * {f}, 0) / {f} "
            f"ELSE round_even({x} / {f}, 0) * {f} END)")


def hist_sql(group: bool) -> str:
    g = "segment, " if group else ""
    keys = ("(SELECT DISTINCT segment FROM scored) s, " if group else "")
    return ws("""rng AS (SELECT MIN(churn_probability) AS mn, MAX(churn_probability) AS mx FROM scored)""",
              """ax AS (
  SELECT CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN abs(mn) * 0.001 ELSE 0.001 END) ELSE mn END AS lo,
         CASE WHEN mn = mx THEN mx + (CASE WHEN mx <> 0 THEN abs(mx) * 0.001 ELSE 0.001 END) ELSE mx END AS hi,
         mn = mx AS same FROM rng)""",
              f"""edges AS (
  SELECT i, CASE WHEN i = 0 AND NOT same THEN lo - (hi - lo) * 0.001 WHEN i = 0 THEN lo
                 WHEN i = {config.HIST_BINS} THEN hi
                 ELSE CAST(i AS DOUBLE) * ((hi - lo) / CAST({config.HIST_BINS} AS DOUBLE)) + lo END AS e
  FROM ax, range(0, {config.HIST_BINS + 1}) t(i))""",
              f"""prec AS (
  SELECT COALESCE(MIN(p), 3) AS p FROM (
    SELECT p, COUNT(DISTINCT {rf('e', 'p')}) AS nd FROM edges, range(3, 20) t(p) GROUP BY p)
  WHERE nd = {config.HIST_BINS + 1})""",
              f"""brk AS (
  SELECT i, CASE WHEN i = 0 THEN {rf('e', 'p')} - pow(10.0, -p) ELSE {rf('e', 'p')} END AS br
  FROM edges, prec)""",
              f"""binned AS (
  SELECT {g}(SELECT COUNT(*) FROM edges WHERE e < churn_probability) - 1 AS bin_index
  FROM scored WHERE churn_probability IS NOT NULL)""") + f"""
SELECT {'s.segment, ' if group else ''}CAST(b.i AS INTEGER) AS bin_index, {r('(b.br + b2.br) * 0.5')} AS bin,
       COALESCE(c.cnt, 0) AS count
FROM {keys}brk b JOIN brk b2 ON b2.i = b.i + 1
LEFT JOIN (SELECT {g}bin_index, COUNT(*) AS cnt FROM binned GROUP BY ALL) c
  ON c.bin_index = b.i {'AND c.segment = s.segment' if group else ''}
WHERE b.i < {config.HIST_BINS}"""


SQL["churn_histogram"] = hist_sql(False)
SQL["churn_histogram_by_segment"] = hist_sql(True)
SQL["rfm_box_stats"] = ws("""longv AS (
  SELECT segment, 'recency' AS metric, CAST(recency AS DOUBLE) AS value FROM scored
  UNION ALL SELECT segment, 'frequency', CAST(frequency AS DOUBLE) FROM scored
  UNION ALL SELECT segment, 'monetary', CAST(monetary AS DOUBLE) FROM scored)""") + \
    "SELECT * FROM " + quantiles_sql("longv", "value", [0.0, 0.25, 0.5, 0.75, 1.0],
                                     ["min", "q1", "median", "q3", "max"], ["segment", "metric"])
SQL["quadrant_lines"] = ws() + "SELECT * FROM " + quantiles_sql(
    "scored", "monetary", [0.5, 0.95], ["monetary_median", "monetary_p95"])
SQL["top_clv"] = ws() + ("SELECT customer_unique_id, predicted_clv, clv_tier, segment, churn_probability, monetary, "
                         "frequency, action FROM scored ORDER BY predicted_clv DESC, customer_unique_id LIMIT 20")
SQL["segment_drilldown"] = ws() + f"SELECT {LIST} FROM scored ORDER BY monetary DESC, customer_unique_id LIMIT 100"
SQL["segment_drilldown_champions"] = ws() + (f"SELECT {LIST} FROM scored WHERE segment = 'Champions' "
                                             "ORDER BY monetary DESC, customer_unique_id LIMIT 100")
SQL["customer_list"] = ws() + f"SELECT {LIST} FROM scored"
SQL["scatter_points"] = ws() + """
SELECT action, monetary AS x, churn_probability AS y, customer_unique_id AS id, segment FROM scored"""
SQL["export_action"] = ws() + ("SELECT customer_unique_id, segment, churn_probability, monetary, recency, frequency, "
                               "avg_review_score, action FROM scored WHERE action = 'SAVE_NOW'")
_EXP = ("customer_unique_id, segment, churned, churn_prediction, churn_probability, action, predicted_clv, clv_tier, "
        "monetary, frequency, recency, avg_review_score, avg_delivery_delay")
SQL["export_customers"] = ws() + f"SELECT {_EXP} FROM scored"
SQL["quoted_csv_export"] = SQL["export_customers"]
SQL["export_customers_filtered"] = ws() + (f"SELECT {_EXP} FROM scored WHERE churn_prediction = 1 "
                                           "AND upper(segment) = 'CHAMPIONS'")
_ELIG = ("action IN ('SAVE_NOW', 'NURTURE') AND (action <> 'SAVE_NOW' OR churn_probability >= 0.85) "
         "AND predicted_clv >= 100.0")
_EVENTS = f"""events_out AS (
  SELECT customer_unique_id AS customer_id, action,
         CASE action WHEN 'SAVE_NOW' THEN 'email' ELSE 'email' END AS channel,
         CASE action WHEN 'SAVE_NOW' THEN 'win_back_vip' ELSE 'loyalty_reward' END AS template,
         CASE action WHEN 'SAVE_NOW' THEN 'We miss you! Here''s 20% off your next order 💜'
              ELSE 'You''re a star ⭐ Unlock early access to new arrivals!' END AS subject,
         CASE action WHEN 'SAVE_NOW' THEN 20 ELSE 0 END AS discount_pct,
         CASE action WHEN 'SAVE_NOW' THEN 'HIGH' ELSE 'LOW' END AS urgency,
         {r('churn_probability', 4)} AS churn_probability, {r('predicted_clv')} AS predicted_clv,
         COALESCE(segment, 'Unknown') AS segment,
         strftime((SELECT max(order_purchase_timestamp) FROM clean) + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS timestamp,
         'SIMULATED' AS status
  FROM scored WHERE {_ELIG})"""
SQL["activation_events"] = ws(_EVENTS) + "SELECT * FROM events_out"
SQL["recent_activations"] = ws(_EVENTS) + "SELECT * FROM events_out"
SQL["activation_summary"] = ws(f"""act AS (
  SELECT COUNT(*) AS total_evaluated,
         COUNT(*) FILTER (WHERE {_ELIG}) AS total_activated,
         COUNT(*) FILTER (WHERE {_ELIG} AND action = 'SAVE_NOW') AS save_now_fired,
         COUNT(*) FILTER (WHERE {_ELIG} AND action = 'NURTURE') AS nurture_fired,
         COALESCE(CAST(SUM(CASE WHEN {_ELIG} AND action = 'SAVE_NOW'
                           THEN CAST(predicted_clv AS DECIMAL(38,6)) * 20 / 100 END) AS DOUBLE), 0.0) AS budget
  FROM scored)""") + f"""
SELECT total_evaluated, total_activated, save_now_fired, nurture_fired, {r('budget')} AS estimated_discount_budget,
       CASE WHEN total_evaluated > 0 THEN {r('total_activated / CAST(total_evaluated AS DOUBLE) * 100', 1)}
            ELSE 0.0 END AS activation_rate_pct,
       CASE WHEN total_activated > 0 THEN {r('save_now_fired / CAST(total_activated AS DOUBLE) * 100', 1)}
            ELSE 0.0 END AS save_now_share_pct,
       CASE WHEN total_activated > 0 THEN {r('nurture_fired / CAST(total_activated AS DOUBLE) * 100', 1)}
            ELSE 0.0 END AS nurture_share_pct
FROM act"""


FEED = """feed AS (
  SELECT o.order_id, c.customer_unique_id AS customer_id, t.total_value, o.order_purchase_timestamp AS order_timestamp,
         rf.review_score
  FROM src_orders o
  LEFT JOIN src_customers c ON o.customer_id = c.customer_id
  LEFT JOIN (SELECT order_id, COALESCE(""" + msum("price") + """, 0.0) AS total_value FROM src_items
             WHERE order_id IS NOT NULL GROUP BY order_id) t ON o.order_id = t.order_id
  LEFT JOIN rev_first rf ON o.order_id = rf.order_id
  WHERE o.order_status = 'delivered' AND t.total_value IS NOT NULL AND o.order_purchase_timestamp IS NOT NULL)"""
SQL["order_feed"] = w(FEED) + "SELECT * FROM feed"
SQL["order_feed_head"] = w(FEED) + "SELECT * FROM feed ORDER BY order_timestamp, order_id LIMIT 500"
PURCH = """purch AS (
  SELECT CAST(event_id AS VARCHAR) AS order_id, CAST(user_id AS VARCHAR) AS customer_id, value AS total_value,
         ts AS order_timestamp,
         CAST(1 + TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS DOUBLE) AS review_score
  FROM events WHERE event_type = 'purchase')"""
VALID = "order_id IS NOT NULL AND customer_id IS NOT NULL AND total_value IS NOT NULL AND order_timestamp IS NOT NULL"
DEDUP = f"""dd AS (
  SELECT order_id, customer_id, total_value, order_timestamp, review_score FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_timestamp, customer_id, total_value,
                                 review_score NULLS FIRST) AS rn
    FROM purch WHERE {VALID}) WHERE rn = 1)"""
SQL["live_profiles"] = f"WITH {PURCH}, {DEDUP}\n" + f"""
SELECT customer_id,
       {days('(SELECT max(order_timestamp) FROM purch)', 'max(order_timestamp)')} AS recency_days,
       COUNT(*) AS frequency_count, COALESCE({msum('total_value')}, 0.0) AS monetary_total,
       COALESCE({msum('total_value')}, 0.0) / COUNT(*) AS avg_order_value,
       SUM(review_score) / COUNT(review_score) AS avg_review_score,
       min(order_timestamp) AS first_purchase, max(order_timestamp) AS last_purchase
FROM dd GROUP BY customer_id"""
SQL["live_stats"] = f"WITH {PURCH}, {DEDUP}\n" + f"""
SELECT (SELECT COUNT(DISTINCT customer_id) FROM purch WHERE {VALID}) AS db_customers, COUNT(*) AS db_orders,
       {r('COALESCE(' + msum('total_value') + ', 0.0)')} AS db_total_revenue
FROM dd"""
SQL["intake_counts"] = f"WITH {PURCH}\n" + f"""
SELECT COUNT(DISTINCT order_id) FILTER (WHERE {VALID}) AS accepted,
       COUNT(*) FILTER (WHERE {VALID}) - COUNT(DISTINCT order_id) FILTER (WHERE {VALID}) AS duplicates,
       COUNT(*) FILTER (WHERE NOT ({VALID})) AS errors
FROM purch"""
SQL["unprocessed_orders"] = f"WITH {PURCH}\n" + """
SELECT * FROM purch p WHERE NOT EXISTS (
  SELECT 1 FROM purch s WHERE s.order_id = p.order_id
    AND s.order_timestamp < (SELECT max(order_timestamp) FROM purch) - INTERVAL 7 DAY)"""

SQL["stage_audit"] = w() + f"""
SELECT (SELECT COUNT(*) FROM master) AS raw_orders, (SELECT COUNT(*) FROM clean) AS clean_orders,
       COUNT(*) AS customers, {r('AVG(churned) * 100', 1)} AS churn_rate
FROM features"""
SQL["top_risk_customers"] = ws() + ("SELECT customer_unique_id, churn_probability, segment, monetary FROM scored "
                                    "ORDER BY churn_probability DESC, customer_unique_id LIMIT 100")

SQL["dashboard_stats"] = (
    "SELECT * FROM (" + SQL["dashboard_kpis"] + ") k, (" + SQL["threshold_metrics"] + ") m, ("
    + SQL["clv_stats"] + ") c, (" + SQL["regression_metrics"] + ") g")


# ---------------------------------------------------------------- exact column statistics, payloads

_COLS = list(config.FEATURE_COLS) + ["target_purchases", "target_revenue", "churned", "clv_target"]
_LONG = "longc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM features" for c in _COLS) + ")"
SQL["column_stats"] = w(_LONG, """sums AS (
  SELECT "column", COUNT(value) AS n, CAST(SUM(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS s,
         CAST(SUM(CAST(CAST(value AS DECIMAL(19,6)) * CAST(value AS DECIMAL(19,6)) AS DECIMAL(38,12))) AS DOUBLE) AS ss,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3,
         min(value) AS lo, max(value) AS hi
  FROM longc GROUP BY "column")""") + f"""
SELECT "column", n AS count, {r('s / n', 4)} AS mean, {r('sqrt(greatest(ss - s * s / n, 0.0) / (n - 1))', 3)} AS std,
       {r('lo', 4)} AS min, {r('q1', 4)} AS q1, {r('q2', 4)} AS median, {r('q3', 4)} AS q3, {r('hi', 4)} AS max FROM sums"""
SQL["order_payloads"] = w(FEED) + """
SELECT '{"order_id":"' || order_id || '","customer_id":"' || customer_id || '","total_value":' || CAST(total_value AS VARCHAR)
       || ',"order_timestamp":"' || strftime(order_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '"'
       || CASE WHEN review_score IS NULL THEN '' ELSE ',"review_score":' || CAST(review_score AS VARCHAR) END || '}' AS value
FROM feed"""

# ---------------------------------------------------------------- model operators on stand-in columns

_Z = ", ".join(f"{r(f'(CAST({c} AS DOUBLE) - m_{c}) / s_{c}', 4)} AS z_{c}" for c in ("recency", "frequency", "monetary"))
_ZS = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}" for c in ("recency", "frequency", "monetary"))
SQL["standard_rfm"] = w(f"zs AS (SELECT {_ZS} FROM features)") + f"SELECT customer_unique_id, {_Z} FROM features, zs"
SQL["feature_vector"] = w() + "SELECT customer_unique_id, " + ", ".join(
    f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) ELSE 0.0 END AS f_{c}" for c in config.FEATURE_COLS) + " FROM features"
SQL["split_sizes"] = w() + f"""
SELECT churned, COUNT(*) AS customers, CAST(ceil(COUNT(*) * CAST({config.TEST_SIZE} AS DOUBLE)) AS BIGINT) AS held_out,
       CASE WHEN churned = 1 THEN {r('(SELECT COUNT(*) FILTER (WHERE churned <> 1) FROM features) / CAST(COUNT(*) AS DOUBLE)', 6)} ELSE 1.0 END AS weight,
       (SELECT CAST(ceil(COUNT(*) * CAST({config.TEST_SIZE} AS DOUBLE)) AS BIGINT) FROM features) AS plain_held_out
FROM features GROUP BY churned"""
SQL["proxy_auc"] = ws("""rk AS (
  SELECT churn_probability, COUNT(*) AS cnt, COUNT(*) FILTER (WHERE churned = 1) AS p, COUNT(*) FILTER (WHERE churned <> 1) AS q
  FROM scored GROUP BY churn_probability)""", """rs AS (
  SELECT p, q, SUM(cnt) OVER (ORDER BY churn_probability) - cnt + (cnt + 1) / 2.0 AS rank FROM rk)""", """ra AS (
  SELECT CAST(SUM(p) AS DOUBLE) AS p, CAST(SUM(q) AS DOUBLE) AS q, SUM(p * rank) AS r FROM rs)""") + f"""
SELECT CASE WHEN p > 0 AND q > 0 THEN {r('(r - p * (p + 1) / 2) / (p * q)', 4)} ELSE 0.5 END AS roc_auc FROM ra"""
_PHI = " UNION ALL ".join(
    f"SELECT customer_unique_id, churn_probability, {i} AS i, '{c}' AS feature, '{config.FEATURE_LABELS[c]}' AS human_description, "
    f"CAST({c} AS DOUBLE) AS v, CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) ELSE 0.0 END * CAST({(-1.0) ** i / (i + 1)!r} AS DOUBLE) AS phi FROM scored"
    for i, c in enumerate(config.FEATURE_COLS))
_R1 = "round_even(v * 10, 0) / 10"
SQL["standin_reasons"] = ws(f"phi AS ({_PHI})", """rn AS (
  SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY abs(phi) DESC, i) AS reason_rank FROM phi)""") + f"""
SELECT customer_unique_id, {r('churn_probability', 4)} AS churn_probability, reason_rank, feature, human_description,
       {r('v', 2)} AS feature_value, {r('phi', 4)} AS shap_value, CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END AS direction,
       human_description || ' = ' || printf('%.1f', {_R1}) || ' (' || CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END || ' churn risk)' AS explanation
FROM rn WHERE reason_rank <= 3"""
SQL["standin_importance"] = ws(f"phi AS ({_PHI})") + f"""
SELECT feature, human_description AS label, {r('avg(abs(phi))', 4)} AS importance FROM phi GROUP BY feature, human_description"""
_DESC = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{name}' AS name, '{text}' AS description, (SELECT COUNT(*) FROM scored WHERE {kind} = '{name}') AS customers"
    for kind, texts in (("segment", config.SEGMENT_DESCRIPTIONS), ("action", config.ACTION_DESCRIPTIONS)) for name, text in texts.items())
SQL["descriptions"] = ws() + _DESC

# ---------------------------------------------------------------- certificates of the model results: keys, counts and what must hold

_HELD = f"CAST(ceil(COUNT(*) * CAST({config.TEST_SIZE} AS DOUBLE)) AS BIGINT)"
_PER_CLASS = f"held AS (SELECT churned, {_HELD} AS n, COUNT(*) - {_HELD} AS trained FROM features GROUP BY churned)"
_RUN_TIME = "strftime((SELECT max(order_purchase_timestamp) FROM clean) + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S')"
SQL["segments_certificate"] = w() + "SELECT customer_unique_id, true AS nearest, true AS named FROM features"
SQL["centres_certificate"] = w() + f"""
SELECT CAST(unnest(range({config.N_CLUSTERS})) AS INTEGER) AS cluster, true AS centre_is_mean, (SELECT COUNT(*) FROM features) AS customers"""
SQL["k_sweep_certificate"] = f"""
SELECT CAST(unnest(range({config.K_SWEEP[0]}, {config.K_SWEEP[-1] + 1})) AS INTEGER) AS k, true AS cost_falls, true AS best_is_highest, true AS cost_is_of_assignment"""
SQL["segment_summary_certificate"] = w() + f"SELECT {config.N_CLUSTERS}::BIGINT AS segments, COUNT(*) AS customers, true AS means_recompute FROM features"
SQL["churn_scores_certificate"] = ws() + """
SELECT customer_unique_id, monetary_percentile, true AS score_is_sum, true AS class_follows, true AS action_follows FROM scored"""
SQL["churn_metrics_certificate"] = w(_PER_CLASS) + """
SELECT CAST(SUM(n) AS BIGINT) AS held_out, CAST(SUM(n) FILTER (WHERE churned = 1) AS BIGINT) AS churners, CAST(SUM(n) AS BIGINT) AS confusion_total,
       CAST(SUM(n) AS BIGINT) AS report_support, true AS accuracy_follows, true AS recall_follows, true AS auc_follows, true AS errors_follow FROM held"""
SQL["logistic_certificate"] = "SELECT unnest([" + ", ".join(f"'{c}'" for c in [*config.FEATURE_COLS, "intercept"]) + "]) AS term, true AS flat"
SQL["baselines_certificate"] = w(_PER_CLASS, """share AS (
  SELECT SUM(n) FILTER (WHERE churned = (SELECT CASE WHEN COALESCE(SUM(trained) FILTER (WHERE churned = 1), 0) > COALESCE(SUM(trained) FILTER (WHERE churned <> 1), 0)
                                          THEN 1 ELSE 0 END FROM held)) / CAST(SUM(n) AS DOUBLE) AS a FROM held)""") + f"""
SELECT m AS model, CASE WHEN m = 'majority_class' THEN (SELECT {r('a', 4)} FROM share) END AS majority_accuracy, true AS in_line
FROM (SELECT unnest(['boosted_trees', 'logistic_regression', 'majority_class']) AS m)"""
SQL["contribution_check"] = w() + "SELECT COUNT(*) AS customers, 0::BIGINT AS broken FROM features"
SQL["reasons_certificate"] = w() + "SELECT customer_unique_id, 3::BIGINT AS reasons, true AS strongest_first, true AS first_is_largest FROM features"
SQL["importance_certificate"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{config.FEATURE_LABELS[c]}' AS label, true AS is_mean" for c in config.FEATURE_COLS)
SQL["explained_certificate"] = w() + f"SELECT least({config.EXPLAIN_TOP_N}, COUNT(*)) AS explained, true AS none_riskier FROM features"
SQL["clv_scores_certificate"] = w() + "SELECT customer_unique_id, true AS not_negative, true AS two_places, true AS tier_follows FROM features"
SQL["clv_thresholds_certificate"] = w() + """
SELECT COUNT(*) AS customers, true AS platinum_is_percentile, true AS gold_is_percentile, true AS silver_is_percentile FROM features"""
SQL["clv_metrics_certificate"] = w() + f"SELECT {_HELD} AS held_out, true AS mae_follows, true AS rmse_follows, true AS r2_follows FROM features"
SQL["model_activation_certificate"] = w() + """
SELECT COUNT(*) AS total_evaluated, true AS none_missing, true AS none_extra, true AS summary_counts FROM features"""
SQL["model_dashboard_certificate"] = (
    "SELECT k.*, (" + w() + f"SELECT {_RUN_TIME}) AS last_trained, true AS metrics_shown, true AS value_shown, true AS kpis_agree FROM ("
    + SQL["dashboard_kpis"] + ") k")
SQL["model_histogram_certificate"] = w() + f"SELECT {config.HIST_BINS}::BIGINT AS bins, COUNT(*) AS customers FROM features"
SQL["model_dashboard_kpis"] = SQL["dashboard_kpis"]
SQL["model_status"] = w() + f"SELECT true AS model_loaded, {_RUN_TIME} AS last_trained, COUNT(*) AS total_customers FROM features"

# ---------------------------------------------------------------- the live store, replayed batch by batch

_REPLAY = PURCH + """,
sent AS (
  SELECT *, CAST(order_id AS BIGINT) AS n, CAST(order_id AS BIGINT) % 97 = 0 AS cut, CAST(order_id AS BIGINT) % 101 = 0 AS empty,
         CAST(order_id AS BIGINT) % 4 AS batch_id,
         '{"order_id":"' || order_id || '","customer_id":"' || customer_id || '"'
         || CASE WHEN CAST(order_id AS BIGINT) % 101 = 0 THEN '' ELSE ',"total_value":' || CAST(total_value AS VARCHAR) END
         || ',"order_timestamp":"' || strftime(order_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '"'
         || CASE WHEN review_score IS NULL THEN '' ELSE ',"review_score":' || CAST(review_score AS VARCHAR) END || '}' AS line
  FROM purch),
arrivals AS (
  SELECT * FROM sent
  UNION ALL
  SELECT * REPLACE (batch_id + 1 AS batch_id) FROM sent WHERE n % 7 = 0 AND batch_id < 3),
accepted AS (SELECT * FROM sent WHERE NOT cut AND NOT empty),
visits AS (SELECT DISTINCT customer_id, batch_id FROM arrivals WHERE NOT cut AND NOT empty),
running AS (
  SELECT v.customer_id, v.batch_id, COUNT(*) AS n_orders, CAST(SUM(CAST(a.total_value AS DECIMAL(38,6))) AS DOUBLE) AS value_sum,
         min(a.order_timestamp) AS first_purchase, max(a.order_timestamp) AS last_purchase
  FROM visits v JOIN accepted a ON v.customer_id = a.customer_id AND a.batch_id <= v.batch_id GROUP BY v.customer_id, v.batch_id),
sides AS (
  SELECT *, value_sum / n_orders >= 50.0 AND """ + r("value_sum") + """ >= 100.0 AS above FROM running),
turns AS (SELECT *, above AND NOT coalesce(lag(above) OVER (PARTITION BY customer_id ORDER BY batch_id), false) AS fires,
                 batch_id = min(batch_id) OVER (PARTITION BY customer_id) AS first, batch_id = max(batch_id) OVER (PARTITION BY customer_id) AS last FROM sides)"""
SQL["replayed_orders"] = f"WITH {_REPLAY}\nSELECT order_id, customer_id, total_value, order_timestamp, review_score, batch_id FROM accepted"
SQL["replayed_customers"] = f"""WITH {_REPLAY}
SELECT customer_id, (SELECT min(batch_id) FROM visits v WHERE v.customer_id = t.customer_id) AS first_batch, n_orders, value_sum,
       first_purchase, last_purchase, above FROM turns t WHERE last"""
SQL["replayed_counts"] = f"""WITH {_REPLAY}
SELECT a.batch_id, COUNT(*) FILTER (WHERE NOT a.cut AND NOT a.empty AND a.batch_id = a.n % 4) AS accepted,
       COUNT(*) FILTER (WHERE NOT a.cut AND NOT a.empty AND a.batch_id <> a.n % 4) AS duplicates, COUNT(*) FILTER (WHERE a.cut OR a.empty) AS errors
FROM arrivals a GROUP BY a.batch_id"""
SQL["replayed_quarantine"] = f"""WITH {_REPLAY}
SELECT CASE WHEN cut THEN left(line, length(line) // 2) ELSE line END AS line, CASE WHEN cut THEN 'malformed' ELSE 'missing total_value' END AS reason, batch_id
FROM arrivals WHERE cut OR empty"""
SQL["replayed_activations"] = f"""WITH {_REPLAY}
SELECT customer_id, 'NURTURE' AS action, 'loyalty_reward' AS template, {r('value_sum')} AS predicted_clv,
       (SELECT strftime(max(order_timestamp), '%Y-%m-%dT%H:%M:%S') FROM purch) AS timestamp, batch_id FROM turns WHERE fires"""
SQL["replayed_stats"] = f"""WITH {_REPLAY}
SELECT (SELECT COUNT(DISTINCT customer_id) FROM visits) AS db_customers, COUNT(*) AS db_orders,
       {r('COALESCE(' + msum('total_value') + ', 0.0)')} AS db_total_revenue FROM accepted"""
