"""Boosted-tree and forest jobs on Spark ML: fit, score, cross-validate, search, compare."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.forecast.search import propose
from demandloom.operators.datasets import (
    encode_product,
    encode_store,
    normalize_shares,
    reconcile,
    select_features,
    time_folds,
)
from demandloom.operators.guards import assert_no_missing
from demandloom.operators.metrics import error_metrics, weighted_mae
from demandloom.sources.staging import broadcast_if_small, stage

SEED = 42
ESTIMATORS = {"gbt": GBTRegressor, "rf": RandomForestRegressor}
DEFAULTS = {
    "gbt": {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1},
    "rf": {"numTrees": 30, "maxDepth": 8},
}
# Search ranges (fixed values): trees, depth, learning rate, row and column samples, least gain of a split, leaf size.
SEARCH_SPACE = {
    "gbt": {
        "maxIter": (50, 300),
        "maxDepth": (3, 15),
        "stepSize": (0.01, 0.3, "log"),
        "subsamplingRate": (0.5, 1.0),
        "featureShare": (0.5, 1.0),
        "minInfoGain": (0.0, 5.0),
        "minInstancesPerNode": (1, 10),
    },
    "rf": {
        "numTrees": (50, 500),
        "maxDepth": (3, 20),
        "minInstancesPerNode": (1, 10),
        "featureShare": (0.2, 1.0),
        "bootstrap": (0, 1),
    },
}
# Ranges of the share model where they differ (fixed values).
SHARE_SEARCH_SPACE = {
    "maxIter": (200, 600),
    "maxDepth": (3, 12),
    "stepSize": (0.01, 0.20),
    "subsamplingRate": (0.5, 1.0),
    "featureShare": (0.4, 1.0),
    "minInstancesPerNode": (1, 20),
}
TREE_COUNT = "maxIter"
# Metrics that one pass gives for every number of trees of a boosted model.
PREFIX_LOSSES = {"mae": "absolute", "mse": "squared"}
COUNTS_PER_FIT = 5


def search_space(model_type: str, kind: str = "gbt") -> dict[str, tuple]:
    return SHARE_SEARCH_SPACE if (model_type, kind) == ("xgb_share", "gbt") else SEARCH_SPACE[kind]


def estimator(kind: str, **params):
    settings = {**DEFAULTS[kind], **params}
    share = settings.pop("featureShare", None)
    if share is not None:
        settings["featureSubsetStrategy"] = str(round(share, 3))
    if "bootstrap" in settings:
        settings["bootstrap"] = bool(settings["bootstrap"])
    return ESTIMATORS[kind](featuresCol="features", labelCol="label", predictionCol="y_pred", seed=SEED, **settings)


def with_label(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double")).withColumns(
        {c: F.col(c).cast("double") for c in features}
    )


def fit(df: DataFrame, features: list[str], label: str, kind: str = "gbt", **params) -> PipelineModel:
    """Assemble features and fit; a missing value in a feature fails the job."""
    train = with_label(df, features, label).select(*features, "label")
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")]
    return Pipeline(stages=[*stages, estimator(kind, **params)]).fit(train)


def score(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """Input columns plus ``y_true`` and ``y_pred``; feature names come from the saved assembler."""
    features = feature_names(model)
    keys = [c for c in df.columns if c not in features]
    scored = model.transform(with_label(df, features, label))
    return scored.select(*keys, F.col("label").alias("y_true"), "y_pred")


def feature_names(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train(df: DataFrame, model_type: str, kind: str = "gbt", **params) -> PipelineModel:
    """Gate, select features and fit one model type."""
    features, label = select_features(df, model_type)
    assert_no_missing(df, [*features, label])
    return fit(df, features, label, kind, **params)


def train_and_score(train_df: DataFrame, test_df: DataFrame, model_type: str, kind: str = "gbt", **params) -> DataFrame:
    _, label = select_features(train_df, model_type)
    return score(train(train_df, model_type, kind, **params), test_df, label)


def load_and_test(path: str, test_df: DataFrame, model_type: str) -> DataFrame:
    """Metrics of a saved model against the label of its type."""
    _, label = select_features(test_df, model_type)
    return error_metrics(score(load_model(path), test_df, label))


def feature_importance(model: PipelineModel, spark, top_k: int | None = 20) -> DataFrame:
    """(feature, importance), most important first; unused features are listed with 0."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(feature_names(model), weights))
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return table.limit(top_k) if top_k else table


# --- cross-validation ----------------------------------------------------------------


def expanding_folds(df: DataFrame, n_splits: int = 5, test_days: int = 90) -> DataFrame:
    """(date, fold): the last ``n_splits`` x ``test_days`` observed dates in blocks 1..n; fold 0
    before them. Block k validates a model trained on all earlier dates."""
    dates = df.select("date").distinct()
    from_end = F.row_number().over(Window.orderBy(F.desc("date"))) - 1
    block = n_splits - F.floor(from_end / test_days)
    return dates.select("date", F.greatest(block, F.lit(0)).cast("int").alias("fold"))


def expanding_cv(
    df: DataFrame, model_type: str, kind: str = "gbt", folds: DataFrame | None = None, metric: str = "mae", **params
) -> DataFrame:
    """(fold, score) with the table written once and read per fold with a fold filter."""
    features, label = select_features(df, model_type)
    folds = broadcast_if_small(expanding_folds(df)) if folds is None else folds
    table = stage(with_label(df, features, label).select("date", *features, "label").join(folds, "date"), "cv")
    return _cv_scores(table, features, kind, metric, parallelism=4, **params)


def _cv_scores(
    table: DataFrame, features: list[str], kind: str, metric: str, parallelism: int | None = 1, **params
) -> DataFrame:
    """Folds are independent jobs, submitted a few at a time (``None``: all at once)."""
    last = table.agg(F.max("fold")).first()[0]

    def run(fold: int) -> tuple[int, float]:
        model = fit(table.filter(F.col("fold") < fold), features, "label", kind, **params)
        scored = score(model, table.filter(F.col("fold") == fold), "label")
        if metric == "weighted_mae":
            result = weighted_mae(scored).withColumnRenamed("weighted_mae", "score")
        else:
            result = error_metrics(scored).select(F.col(metric).alias("score"))
        return fold, result.first()["score"]

    with ThreadPoolExecutor(parallelism or max(1, last)) as pool:
        parts = list(pool.map(run, range(1, last + 1)))
    return table.sparkSession.createDataFrame(parts, "fold int, score double")


def prefix_scores(model: PipelineModel, df: DataFrame, label: str, metric: str = "mae") -> list[float]:
    """Error of a boosted model cut after 1, 2, .. trees, all from one pass over ``df``."""
    features = feature_names(model)
    rows = PipelineModel(model.stages[:-1]).transform(with_label(df, features, label))
    return model.stages[-1].evaluateEachIteration(rows, PREFIX_LOSSES[metric])


def _prefix_cv_scores(
    table: DataFrame, features: list[str], metric: str, counts: list[int], parallelism: int | None = 1, **params
) -> dict[int, float]:
    """Mean score over the folds per number of trees: one fit per fold with the most trees."""
    last = table.agg(F.max("fold")).first()[0]

    def run(fold: int) -> list[float]:
        train, test = table.filter(F.col("fold") < fold), table.filter(F.col("fold") == fold)
        model = fit(train, features, "label", "gbt", **params | {TREE_COUNT: max(counts)})
        scores = prefix_scores(model, test, "label", metric)
        return [scores[min(count, len(scores)) - 1] for count in counts]

    with ThreadPoolExecutor(parallelism or max(1, last)) as pool:
        folds = list(pool.map(run, range(1, last + 1)))
    return {count: sum(scores) / len(folds) for count, scores in zip(counts, zip(*folds))}


def param_search(
    df: DataFrame,
    model_type: str,
    kind: str = "gbt",
    n_trials: int = 50,
    space: dict | None = None,
    folds: DataFrame | None = None,
    metric: str = "mae",
    parallelism: int | None = None,
    counts_per_fit: int = COUNTS_PER_FIT,
    seed: int = SEED,
) -> DataFrame:
    """(trial, params, cv_score) best first, over expanding date folds; the sampler is :mod:`search`.

    A boosted model with fewer trees is the beginning of one with more. So ``counts_per_fit`` trials in turn share
    their other parameters and one fit per fold; the sampler proposes a number of trees for each of them. With
    ``counts_per_fit=1``, for forests, and for metrics that need the whole prediction, every trial is a fit of its own.
    Folds are fitted side by side, each by Spark jobs, all at once unless ``parallelism`` says fewer: a fit is a chain
    of small jobs that leaves most cores idle, and a fold left over would take as long as all others together. The same
    seed gives the same trials however they are timed.
    """
    features, label = select_features(df, model_type)
    folds = broadcast_if_small(expanding_folds(df)) if folds is None else folds
    table = stage(with_label(df, features, label).select("date", *features, "label").join(folds, "date"), "search")
    space = space or search_space(model_type, kind)
    shared = counts_per_fit if kind == "gbt" and metric in PREFIX_LOSSES and TREE_COUNT in space else 1
    done: list[tuple[dict, float]] = []
    while len(done) < n_trials:
        first, width = len(done), min(shared, n_trials - len(done))
        params = propose(space, done, first, seed)
        if shared == 1:
            scores = [r["score"] for r in _cv_scores(table, features, kind, metric, parallelism, **params).toLocalIterator()]
            done.append((params, sum(scores) / len(scores)))
            continue
        counts = [propose({TREE_COUNT: space[TREE_COUNT]}, done, first + i, seed)[TREE_COUNT] for i in range(width)]
        scored = _prefix_cv_scores(table, features, metric, counts, parallelism, **params)
        done += [(params | {TREE_COUNT: count}, scored[count]) for count in counts]
    text = lambda params: ", ".join(f"{k}={round(v, 6)}" for k, v in sorted(params.items()))
    rows = [(trial, text(params), float(found)) for trial, (params, found) in enumerate(done)]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, cv_score double").orderBy("cv_score", "trial")


def share_folds(df: DataFrame) -> DataFrame:
    return broadcast_if_small(time_folds(df, 5))


# --- comparisons ---------------------------------------------------------------------


def prune_compare(
    train_df: DataFrame,
    test_df: DataFrame,
    model_type: str,
    top_k: int = 20,
    threshold: float | None = None,
    kind: str = "gbt",
    **params,
) -> DataFrame:
    """Metrics of the full feature set and of its most important features, one row each."""
    features, label = select_features(train_df, model_type)
    base = fit(train_df, features, label, kind, **params)
    ranked = sorted(
        zip(features, base.stages[-1].featureImportances.toArray()), key=lambda pair: (-pair[1], pair[0])
    )
    kept = [f for f, w in ranked if w > threshold] if threshold is not None else [f for f, _ in ranked[:top_k]]
    if not kept:
        raise ValueError("no feature is important enough to keep")
    pruned = fit(train_df, kept, label, kind, **params)

    def row(name: str, model: PipelineModel, n: int) -> DataFrame:
        return error_metrics(score(model, test_df, label)).select(
            F.lit(name).alias("variant"), F.lit(n).alias("n_features"), "*"
        )

    return row("baseline", base, len(features)).unionByName(row("pruned", pruned, len(kept)))


def hierarchical_predictions(
    store: DataFrame, shares: DataFrame, split, normalize: bool = False, **params
) -> DataFrame:
    """Product rows with predicted share, store total and quantity for the test part of ``split``."""
    store_train, store_test = encode_store(*split(store))
    share_train, share_test = encode_product(*split(shares))
    share_train, share_test = encode_store(share_train, share_test)
    totals = train_and_score(store_train, store_test, "xgb_total", **params)
    product = train_and_score(share_train, share_test, "xgb_share", **params)
    product = product.withColumnRenamed("y_pred", "pred_share")
    if normalize:
        product = product.transform(normalize_shares)
    return reconcile(product, totals.withColumnRenamed("y_pred", "pred_total"))


def evaluate_hierarchical(store: DataFrame, shares: DataFrame, split, normalize: bool = False, **params) -> DataFrame:
    frame = hierarchical_predictions(store, shares, split, normalize, **params)
    return error_metrics(frame, "quantity", "pred_quantity")
