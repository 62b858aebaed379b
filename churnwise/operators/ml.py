"""Spark ML stages: segments, churn classifier, value regressor.

K-Means is that of :mod:`churnwise.operators.clustering`, boosted trees those
of :mod:`churnwise.operators.boosting`, the logistic baseline a Spark ML fit; inputs are written stages, dealt by id
hash and sorted by id in a number of partitions that follows the row count,
so a fit replays no join and does not depend on the cluster.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnwise import config
from churnwise.config import Params
from churnwise.functions.scalar import finite_or_zero, round_half_even
from churnwise.operators import boosting, clustering, evaluation, segments, silhouette
from churnwise.operators.ranking import value_positions
from churnwise.session import cut_lineage

CUST = "customer_unique_id"
RFM = ("recency", "frequency", "monetary")


# --------------------------------------------------------------------------- segments

def scale_rfm(df: DataFrame) -> DataFrame:
    """M1: R, F, M standardised (mean 0, unit sample std; a population std
    scales every axis by the same factor, so clusters are unchanged)."""
    v = VectorAssembler(inputCols=list(RFM), outputCol="_rfm").transform(
        df.withColumns({c: finite_or_zero(c) for c in RFM}))
    model = StandardScaler(inputCol="_rfm", outputCol="rfm_scaled", withMean=True, withStd=True).fit(v)
    return model.transform(v).drop("_rfm")


def best_kmeans(scaled: DataFrame, ks, n_init: int, seed: int) -> dict:
    """M3 for every k: ``n_init`` starts, the one of lowest cost; all starts of all k share their scans."""
    return clustering.fit_all(scaled, ks, n_init, seed)


def k_sweep(scaled: DataFrame, models: dict, every: int = 1) -> DataFrame:
    """M2: inertia and Euclidean silhouette per k, best k = highest silhouette; the final k stays fixed.

    The silhouette is that of all rows (``every`` = 1) or of the rows whose hash ``every`` divides, each against all rows."""
    labels = {k: f"_k{k}" for k in sorted(models)}
    points = scaled
    for k, c in labels.items():
        points = models[k].transform(points, out=c)
    found = silhouette.silhouettes(points, labels, every=every)
    best = max(labels, key=lambda k: found[k])
    return scaled.sparkSession.createDataFrame(
        [(k, float(models[k].cost), found[k], k == best) for k in labels],
        "k int, inertia double, silhouette double, best_k boolean")


def kmeans_segments(feat: DataFrame, params: Params = Params(), models: dict | None = None,
                    scaled: DataFrame | None = None) -> tuple:
    """M4: scale -> best-of-n K-Means -> cluster summary -> names -> join.
    Returns (customers with cluster + segment, named cluster summary, models)."""
    if scaled is None:
        scaled = scale_rfm(feat.select(CUST, *RFM))
    if models is None:
        models = best_kmeans(scaled, [params.n_clusters], params.n_init, params.seed)
    model = models[params.n_clusters]
    clusters = model.transform(scaled).select(CUST, "cluster")
    with_cluster = feat.join(clusters, CUST, "inner")
    named = segments.name_clusters(segments.cluster_summary(with_cluster), params.n_clusters)
    return segments.attach_segments(with_cluster, named), named, models


# --------------------------------------------------------------------------- splits

def split_flag(df: DataFrame, test_size: float, seed: int, strata: str | None = None) -> DataFrame:
    """M5 / M6: ``is_test`` for an exact share of rows (per class when
    ``strata`` is given), chosen by a seeded hash of the customer id.

    The position of each hash inside its class comes from the distributed
    ranking operator, so no class is gathered into one task."""
    h = F.xxhash64(F.col(CUST), F.lit(seed)).alias("_h")
    g = [strata] if strata else []
    keyed = df.withColumn("_h", h)
    pos = value_positions(keyed, "_h", g)
    test = F.col("before") < F.ceil(F.col("n") * F.lit(float(test_size)))
    pos = pos.select(*g, "_h", test.alias("is_test"))
    return keyed.join(pos, [*g, "_h"], "left").drop("_h")


def training_layout(df: DataFrame, rows: int | None = None, per_partition: int = config.TRAIN_ROWS_PER_PARTITION) -> DataFrame:
    """Rows dealt by id hash into as many partitions as their number asks for, sorted by id: boosted trees draw
    their row samples per partition, so a seed gives the same model on any cluster."""
    rows = df.count() if rows is None else rows
    parts = max(1, -(-rows // per_partition))
    return df.repartition(parts, CUST).sortWithinPartitions(CUST)


# --------------------------------------------------------------------------- churn

def assemble(df: DataFrame, cols=config.FEATURE_COLS, out: str = "features") -> DataFrame:
    """F9 + F10: the feature vector with +-Inf / NaN / null as 0."""
    clean = df.withColumns({f"_f_{c}": finite_or_zero(c) for c in cols})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol=out).transform(clean) \
        .drop(*[f"_f_{c}" for c in cols])


def with_class_weight(train: DataFrame, label: str = "churned") -> DataFrame:
    """M7: positives weighted n_neg / n_pos (1.0 without positives)."""
    c = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    ratio = c.select(F.when(F.col("p") > 0, F.col("q") / F.col("p")).otherwise(1.0)).scalar()
    return train.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def _tree_settings(params: Params) -> dict:
    return {"n_trees": params.n_trees, "max_depth": params.max_depth, "learning_rate": params.learning_rate,
            "row_sample": params.row_sample, "feature_sample": params.feature_sample, "seed": params.seed}


def fit_churn_trees(train: DataFrame, params: Params) -> boosting.BoostedTrees:
    """M8: second-order boosted trees with logistic loss and class weights."""
    return boosting.fit(train, list(params.feature_cols), "churned", "logistic", weight="weight", **_tree_settings(params))


def score_churn(model: boosting.BoostedTrees, df: DataFrame) -> DataFrame:
    """M9: class from the raw score, probability to 4 places."""
    return (df.withColumn("churn_score", 1 / (1 + F.exp(-model.margin())))
            .withColumn("churn_probability", round_half_even("churn_score", 4))
            .withColumn("churn_prediction", (F.col("churn_score") > 0.5).cast("int")))


def auc(scored: DataFrame, label: str = "churned", score: str = "churn_score",
        buckets: int = config.RANK_BUCKETS) -> DataFrame:
    """M10 (AUC part): exact area under ROC as the rank sum of the positives
    (ties share their mean rank), 0.5 with one class."""
    known = scored.filter(F.col(score).isNotNull())
    pos = value_positions(known, score, buckets=buckets).select(score, "before", "cnt")
    hits = known.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    rank = F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)
    s = pos.join(hits, score).agg(F.sum("_p").alias("p"), F.sum("_q").alias("q"), F.sum(F.col("_p") * rank).alias("r"))
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return s.select(F.when((F.col("p") > 0) & (F.col("q") > 0), round_half_even(area, 4)).otherwise(F.lit(0.5)).alias("roc_auc"))


def fit_logistic(train: DataFrame, label: str = "churned"):
    """Class-balanced logistic regression: (fitted model, weight per class, penalty)."""
    n = train.count()
    counts = train.groupBy(label).count()
    bal = counts.select(label, (F.lit(n) / (F.lit(2.0) * F.col("count"))).alias("weight"))
    lr_train = train.drop("weight").join(F.broadcast(bal), label, "left")     # two rows
    penalty = 1.0 / max(n, 1)
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=1000,
                            regParam=penalty, standardization=False)
    return lr.fit(lr_train), bal, penalty


def baselines(train: DataFrame, test: DataFrame, gbt_test: DataFrame, label: str = "churned") -> DataFrame:
    """M13 + M14: accuracy of a class-balanced logistic regression and of the
    majority class, beside the boosted model."""
    fitted, _, _ = fit_logistic(train, label)
    # scored from its coefficients: the fitted model holds a training summary and with it the session
    x = vector_to_array(F.col("features"))
    margin = sum((F.get(x, F.lit(i)) * F.lit(float(c)) for i, c in enumerate(fitted.coefficients)), F.lit(float(fitted.intercept)))
    lr_pred = test.withColumn("prediction", (margin > 0).cast("double"))
    majority = train.agg(F.when(F.count_if(F.col(label) == 1) > F.count_if(F.col(label) != 1), 1)
                         .otherwise(0)).scalar()          # argmax of the prior, class 0 on a tie

    def acc(df, pred):
        return df.agg(F.avg((F.col(label) == pred).cast("double"))).scalar()

    major_acc = (test.agg(F.count_if(F.col(label) == 1).alias("t1"), F.count(F.lit(1)).alias("tn"))
                 .select(F.when(majority == 1, F.col("t1") / F.col("tn"))
                         .otherwise((F.col("tn") - F.col("t1")) / F.col("tn"))).scalar())
    spark = train.sparkSession
    return spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("boosted_trees").alias("model"),
                 round_half_even(acc(gbt_test, F.col("churn_prediction")), 4).alias("accuracy")),
        F.struct(F.lit("logistic_regression").alias("model"),
                 round_half_even(acc(lr_pred, F.col("prediction")), 4).alias("accuracy")),
        F.struct(F.lit("majority_class").alias("model"),
                 round_half_even(major_acc, 4).alias("accuracy")))).alias("r")).select("r.*")


def train_churn(feat: DataFrame, params: Params = Params()):
    """M5, M7, M8 and the held-out evaluation inputs.  Returns (model,
    scored test rows, train rows, test rows)."""
    data = cut_lineage(split_flag(feat, params.test_size, params.seed, "churned"), "churn_split")
    train = with_class_weight(assemble(training_layout(data.filter(~F.col("is_test")))))
    test = assemble(data.filter(F.col("is_test")))
    model = fit_churn_trees(train, params)
    return model, cut_lineage(score_churn(model, test), "churn_test"), train, test


def churn_metrics(test_scored: DataFrame) -> DataFrame:
    """Threshold metrics and AUC in one row."""
    return evaluation.threshold_metrics(test_scored).select("*", auc(test_scored).scalar().alias("roc_auc"))


# --------------------------------------------------------------------------- value

def fit_value_trees(train: DataFrame, params: Params) -> boosting.BoostedTrees:
    """Second-order boosted trees with squared error."""
    return boosting.fit(train, list(params.feature_cols), "clv_target", "squared", **_tree_settings(params))


def train_clv(feat: DataFrame, params: Params = Params()):
    """M6 + M18: plain split, fit on the training rows.  Returns (model, test rows)."""
    data = cut_lineage(split_flag(feat.withColumn("clv_target", F.coalesce(F.col("clv_target"), F.lit(0.0))),
                                  params.test_size, params.seed), "clv_split")
    model = fit_value_trees(training_layout(data.filter(~F.col("is_test"))), params)
    return model, assemble(data.filter(F.col("is_test")))


def score_clv(model: boosting.BoostedTrees, df: DataFrame) -> DataFrame:
    """M20 + F12: predicted value clipped at 0, 2 places."""
    return (df.withColumn("_margin", model.margin())
            .withColumn("predicted_clv", round_half_even(F.greatest(F.col("_margin"), F.lit(0.0)), 2)).drop("_margin"))
