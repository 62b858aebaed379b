"""Certificates of model results: what can be recomputed about a fit without fitting again.

A trained model's numbers cannot be restated in SQL, but the properties that
make them right can be checked row by row: every customer sits in the nearest
cluster, a centre is the mean of its members, contributions add up to the
score, the logistic gradient vanishes, metrics follow from the stored scores
by a second path, tiers and actions follow from the stored values.  Each
function returns rows whose keys and counts SQL derives from the orders, and
booleans that are true when the property holds.  All are aggregates, equi-joins
or expressions over the result tables, so they run on results of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnwise import config
from churnwise.operators import actions, ml

CUST = "customer_unique_id"
#: A centre may differ from its members' mean by the step at which Lloyd's rounds stop.
CENTRE_TOLERANCE = 1e-3
#: Largest share of a coefficient's absolute residual mass that its gradient may keep.
GRADIENT_TOLERANCE = 1e-2


def _close(a, b, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def _squared(x: Column, centre) -> Column:
    return reduce(lambda a, b: a + b, [F.pow(F.get(x, F.lit(i)) - float(c), 2) for i, c in enumerate(centre)])


def _placed(customers: DataFrame, scaled: DataFrame) -> DataFrame:
    """Customers with their scaled point as an array ``x``."""
    points = scaled.select(CUST, vector_to_array("rfm_scaled").alias("x"))
    return customers.select(CUST, "cluster", "segment").join(points, CUST)


def nearest_centres(customers: DataFrame, scaled: DataFrame, centres) -> DataFrame:
    """M4 + J8, a row per customer: its cluster is the nearest centre, and its segment is one of the names."""
    d = F.array(*[_squared(F.col("x"), c) for c in centres])
    return _placed(customers, scaled).select(
        CUST, (F.get(d, F.col("cluster")) <= F.array_min(d) + 1e-9).alias("nearest"),
        F.col("segment").isin(*config.SEGMENT_NAMES).alias("named"))


def centre_means(customers: DataFrame, scaled: DataFrame, centres) -> DataFrame:
    """M3, a row per cluster: the centre is the mean of its members; ``customers`` is the sum over all clusters."""
    dims = range(len(centres[0]))
    means = _placed(customers, scaled).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in dims])
    want = customers.sparkSession.createDataFrame([(j, *map(float, c)) for j, c in enumerate(centres)],
                                                  "cluster int, " + ", ".join(f"c{i} double" for i in dims))
    gap = reduce(F.greatest, [F.abs(F.col(f"m{i}") - F.col(f"c{i}")) for i in dims])
    return want.join(means, "cluster", "left").select(
        "cluster", F.coalesce(gap <= CENTRE_TOLERANCE, F.lit(False)).alias("centre_is_mean"), means.agg(F.sum("members")).scalar().alias("customers"))


def sweep_check(sweep: DataFrame, customers: DataFrame, scaled: DataFrame, centres) -> DataFrame:
    """M2, a row per k: costs fall with k, the best k has the highest silhouette, and the cost of the k in use is that of the stored assignment."""
    d = F.array(*[_squared(F.col("x"), c) for c in centres])
    cost = _placed(customers, scaled).agg(F.sum(F.get(d, F.col("cluster")))).scalar()
    above = sweep.select((F.col("k") + 1).alias("k"), F.col("inertia").alias("before"))
    top = sweep.agg(F.max("silhouette")).scalar()
    same = F.when(F.col("k") == len(centres), _close(F.col("inertia") / cost, F.lit(1.0), 1e-6)).otherwise(True)
    return sweep.join(above, "k", "left").select(
        "k", F.coalesce(F.col("inertia") <= F.col("before"), F.lit(True)).alias("cost_falls"),
        (F.col("best_k") == (F.col("silhouette") == top)).alias("best_is_highest"), same.alias("cost_is_of_assignment"))


def segment_totals(summary: DataFrame, customers: DataFrame) -> DataFrame:
    """R2: the summary's sizes add up to all customers, and its means recompute from the rows."""
    again = customers.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_{c}") for c in ml.RFM])
    means = reduce(lambda a, b: a & b, [_close(F.col(f"avg_{c}"), F.col(f"_{c}"), 0.0051) for c in ml.RFM])
    return summary.join(again, "segment", "left").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("customer_count").alias("customers"),
        F.bool_and(F.coalesce(means & (F.col("n") == F.col("customer_count")), F.lit(False))).alias("means_recompute"))


def score_check(scored: DataFrame, contrib: DataFrame) -> DataFrame:
    """M9, a row per customer: the probability is the sigmoid of the summed contributions, class and action follow from it."""
    p, v = F.col("churn_probability"), F.col("monetary_percentile")
    margin = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x)
    high, rich = p >= config.HIGH_RISK_CUT, v >= config.HIGH_VALUE_CUT
    action = (F.when(high & rich, "SAVE_NOW").when(high, "LET_GO").when(rich, "NURTURE").otherwise("MONITOR"))
    return scored.join(contrib.select(CUST, "contributions", "base_value"), CUST).select(
        CUST, "monetary_percentile", _close(p, 1 / (1 + F.exp(-margin)), 5.1e-5).alias("score_is_sum"),
        ((F.col("churn_score") > 0.5) == (F.col("churn_prediction") == 1)).alias("class_follows"), (F.col("action") == action).alias("action_follows"))


def contribution_check(contrib: DataFrame, customers: DataFrame, model) -> DataFrame:
    """Customers, and how many of them have contributions that do not add up to the margin of walking the model's trees, or none at all."""
    total = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x)
    walked = customers.select(F.col(CUST).alias("_id"), model.margin().alias("_walked"))
    both = walked.join(contrib.select(CUST, total.alias("_total")), F.col("_id").eqNullSafe(F.col(CUST)), "full")
    return both.agg(F.count(F.lit(1)).alias("customers"), F.count_if(~_close(F.col("_total"), F.col("_walked"), 1e-6)).alias("broken"))


def metrics_check(test: DataFrame, metrics: DataFrame, confusion: DataFrame, report: DataFrame, errors: DataFrame) -> DataFrame:
    """Held-out rows and churners, and whether every reported figure follows from the stored scores by another path."""
    y, p = F.col("churned"), F.col("churn_prediction")
    area = BinaryClassificationEvaluator(rawPredictionCol="churn_score", labelCol="churned", numBins=0).evaluate(test.select("churn_score", y.cast("double").alias("churned")))
    m = metrics.select(F.struct(*metrics.columns)).scalar()
    c = confusion.select(F.struct(*confusion.columns)).scalar()
    by_class = report.filter(F.col("class").isin("0", "1")).agg(F.sum("support")).scalar()
    wrong = errors.agg(F.sum("n")).scalar()
    s = test.agg(F.count(F.lit(1)).alias("held_out"), F.sum(y).cast("long").alias("churners"), F.avg((y == p).cast("double")).alias("acc"),
                 F.count_if(y != p).alias("wrong"), (F.count_if((y == 1) & (p == 1)) / F.count_if(y == 1)).alias("found"))
    s = s.withColumns({"m": m, "c": c})
    return s.select("held_out", "churners", (F.col("c.tn") + F.col("c.fp") + F.col("c.fn") + F.col("c.tp")).alias("confusion_total"),
                    by_class.alias("report_support"), _close(F.col("m.accuracy"), F.col("acc"), 5.1e-5).alias("accuracy_follows"),
                    _close(F.col("m.recall"), F.col("found"), 5.1e-5).alias("recall_follows"),
                    _close(F.col("m.roc_auc"), F.lit(float(area)), 1e-4).alias("auc_follows"),
                    (F.col("wrong") == wrong).alias("errors_follow"))


def logistic_gradient(train: DataFrame, label: str = "churned") -> DataFrame:
    """M13, a row per coefficient and one for the intercept: the penalised loss has no slope left at the fitted values."""
    fitted, weights, penalty = ml.fit_logistic(train, label)
    x = vector_to_array(F.col("features"))
    coef = [float(c) for c in fitted.coefficients]
    margin = sum((F.get(x, F.lit(i)) * c for i, c in enumerate(coef)), F.lit(float(fitted.intercept)))
    rows = train.drop("weight").join(F.broadcast(weights), label, "left")                # two rows
    gap = F.col("weight") * (1 / (1 + F.exp(-margin)) - F.col(label))
    terms = [F.get(x, F.lit(i)) for i in range(len(coef))] + [F.lit(1.0)]
    sums = rows.agg(F.sum("weight").alias("w"), *[F.sum(gap * t).alias(f"g{i}") for i, t in enumerate(terms)],
                    *[F.sum(F.abs(gap * t)).alias(f"a{i}") for i, t in enumerate(terms)])
    names = [*(config.FEATURE_COLS if len(coef) == len(config.FEATURE_COLS) else map(str, range(len(coef)))), "intercept"]
    out = []
    for i, name in enumerate(names):
        pull = penalty * coef[i] if i < len(coef) else 0.0
        flat = F.abs(F.col(f"g{i}") / F.col("w") + pull) <= GRADIENT_TOLERANCE * F.col(f"a{i}") / F.col("w") + 1e-9
        out.append(F.struct(F.lit(name).alias("term"), flat.alias("flat")))
    return sums.select(F.inline(F.array(*out)))


def baselines_check(base: DataFrame, metrics: DataFrame) -> DataFrame:
    """M13 + M14, a row per model: the majority accuracy (which SQL knows), and whether the boosted row repeats the model's own metrics."""
    boosted = metrics.select("accuracy").scalar()
    return base.select("model", F.when(F.col("model") == "majority_class", F.col("accuracy")).alias("majority_accuracy"),
                       F.when(F.col("model") == "boosted_trees", _close(F.col("accuracy"), boosted, 1e-9))
                       .otherwise(F.col("accuracy").between(0.0, 1.0)).alias("in_line"))


def reasons_check(reasons: DataFrame, contrib: DataFrame, per_customer: int = 3) -> DataFrame:
    """M16 + W5, a row per customer: as many reasons as asked, strongest first, the first being the largest contribution."""
    top = contrib.select(CUST, F.array_max(F.transform("contributions", lambda v: F.abs(v))).alias("top"))
    mags = F.transform(F.array_sort(F.collect_list(F.struct("reason_rank", F.abs("shap_value").alias("m")))), lambda r: r["m"])
    per = reasons.groupBy(CUST).agg(F.count(F.lit(1)).alias("reasons"), mags.alias("mags"))
    return per.join(top, CUST, "left").select(
        CUST, "reasons", (F.col("mags") == F.reverse(F.array_sort("mags"))).alias("strongest_first"),
        _close(F.get("mags", F.lit(0)), F.col("top"), 5.1e-5).alias("first_is_largest"))


def importance_check(importance: DataFrame, contrib: DataFrame, feature_cols=config.FEATURE_COLS) -> DataFrame:
    """M17 + L8, a row per feature with its label: the importance is the mean absolute contribution, regrouped by place."""
    names = F.array(*[F.lit(c) for c in feature_cols])
    again = (contrib.select(F.posexplode("contributions").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("mean"))
             .select(F.get(names, F.col("i")).alias("feature"), "mean"))
    return importance.join(again, "feature").select("feature", "label", _close(F.col("importance"), F.col("mean"), 1e-9).alias("is_mean"))


def explained_check(explained: DataFrame, scored: DataFrame) -> DataFrame:
    """J10 + L6: how many customers are explained, and that nobody unexplained is riskier than one of them."""
    ids = explained.select(CUST).distinct()
    least = scored.join(ids, CUST, "left_semi").agg(F.min("churn_score")).scalar()
    rest = scored.join(ids, CUST, "left_anti").agg(F.max("churn_score").alias("most"))
    return rest.select(ids.agg(F.count(F.lit(1))).scalar().alias("explained"), F.coalesce(F.col("most") <= least, F.lit(True)).alias("none_riskier"))


def tier_check(customers: DataFrame, thresholds: DataFrame) -> DataFrame:
    """M20, a row per customer: the value is clipped and has two places, and the tier follows from the stored thresholds."""
    th = thresholds.select(F.struct("platinum", "gold", "silver")).scalar()
    v = F.col("predicted_clv")
    tier = (F.when(v >= F.col("th.platinum"), "Platinum").when(v >= F.col("th.gold"), "Gold").when(v >= F.col("th.silver"), "Silver").otherwise("Bronze"))
    return customers.withColumn("th", th).select(CUST, (v >= 0).alias("not_negative"), _close(v * 100, F.rint(v * 100), 1e-6).alias("two_places"),
                                                 (F.col("clv_tier") == tier).alias("tier_follows"))


def threshold_check(customers: DataFrame, thresholds: DataFrame) -> DataFrame:
    """As many customers lie below and at each threshold as its percentile asks."""
    th = thresholds.select(F.struct("platinum", "gold", "silver")).scalar()
    v, t = F.col("predicted_clv"), customers.select("predicted_clv").withColumn("th", th)
    counts = t.agg(F.count(F.lit(1)).alias("customers"), *[F.count_if(v < F.col(f"th.{c}")).alias(f"{c}_lt") for c in ("platinum", "gold", "silver")],
                   *[F.count_if(v <= F.col(f"th.{c}")).alias(f"{c}_le") for c in ("platinum", "gold", "silver")])
    n = F.col("customers")
    return counts.select("customers", *[((F.col(f"{c}_lt") <= F.ceil((n - 1) * F.lit(p))) & (F.col(f"{c}_le") >= F.floor((n - 1) * F.lit(p)) + 1)).alias(f"{c}_is_percentile")
                                        for c, p in zip(("platinum", "gold", "silver"), config.TIER_PERCENTILES)])


def regression_check(test: DataFrame, metrics: DataFrame) -> DataFrame:
    """M18 + M19: held-out rows, and the reported errors recomputed by Spark's own evaluator."""
    rows = test.select(F.col("clv_target").cast("double").alias("label"), F.col("predicted_clv").cast("double").alias("prediction"))
    mae, rmse, r2 = (float(RegressionEvaluator(metricName=m).evaluate(rows)) for m in ("mae", "rmse", "r2"))
    return metrics.select(test.agg(F.count(F.lit(1))).scalar().alias("held_out"), _close(F.col("mae"), F.lit(mae), 0.0051).alias("mae_follows"),
                          _close(F.col("rmse"), F.lit(rmse), 0.0051).alias("rmse_follows"), _close(F.col("r2_score"), F.lit(r2), 5.1e-5).alias("r2_follows"))


def activation_check(customers: DataFrame, events: DataFrame, summary: DataFrame) -> DataFrame:
    """Run time of the events, and that exactly the customers who meet the rule have one, as the summary counts them."""
    due = customers.filter(actions.eligible()).select(F.col(CUST).alias("customer_id"))
    missing = due.join(events, "customer_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    extra = events.join(due, "customer_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    n, late = events.agg(F.count(F.lit(1))).scalar(), events.agg(F.count_if(F.col("status") != config.ACTIVATION_STATUS)).scalar()
    return summary.select("total_evaluated", (missing == 0).alias("none_missing"), ((extra == 0) & (late == 0)).alias("none_extra"),
                          ((F.col("total_activated") == n) & (F.col("save_now_fired") + F.col("nurture_fired") == n)).alias("summary_counts"))


def dashboard_check(stats: DataFrame, kpis: DataFrame, churn_metrics: DataFrame, clv_metrics: DataFrame, customers: DataFrame) -> DataFrame:
    """The KPIs (which SQL knows), and that the model figures shown are those of the stored metrics and scores."""
    a, b = churn_metrics.select("roc_auc").scalar(), clv_metrics.select("rmse").scalar()
    total = customers.agg(F.sum(F.col("predicted_clv").cast("decimal(38,6)")).cast("double")).scalar()
    shown = stats.select("total_customers", "total_revenue", "avg_order_value", "churn_rate", "last_trained",
                         (_close(F.col("roc_auc"), a, 1e-9) & _close(F.col("rmse"), b, 1e-9)).alias("metrics_shown"),
                         _close(F.col("total_predicted_value"), total, 0.0051).alias("value_shown"))
    same = kpis.select(F.struct("total_customers", "total_revenue", "avg_order_value", "churn_rate")).scalar()
    return shown.withColumn("kpis_agree", F.struct("total_customers", "total_revenue", "avg_order_value", "churn_rate") == same)


def histogram_check(hist: DataFrame, customers: DataFrame, count: str = "count") -> DataFrame:
    """Bins and the customers in them."""
    return hist.agg(F.count(F.lit(1)).alias("bins"), F.sum(count).cast("long").alias("customers"))
