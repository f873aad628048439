"""Churn and revenue models, tuning and explanation.

Folds are the keyed-hash fold column (E2), so a fold never depends on
partitioning, and fold metrics are computed for all folds and settings in one
grouped pass.  Learners by the reference's names:

* logistic regression and ridge: :mod:`linear`, all folds and penalties in one
  scan a step.  Of the two solvers in the grid, ``liblinear`` penalises the
  intercept too, ``lbfgs`` doesn't;
* gradient boosting: :mod:`boosting`, with the L2 term of the leaf values;
* random forests: MLlib; ``max_depth=None`` is MLlib's cap of 30,
  ``min_samples_split`` → ``minInstancesPerNode = ceil(min_samples_split / 2)``.

Every fitted model has ``score(df, out)`` and ``importances()``.
"""

from __future__ import annotations

import math
import random
import threading
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting as B
from . import forest as RF
from . import linear as L
from . import metrics as X
from . import ranks as R

MLLIB_MAX_DEPTH = 30

Sampler = Callable[[random.Random], float | int | str | None]


def whole(lo: int, hi: int) -> Sampler:
    return lambda rng: rng.randint(lo, hi)


def whole_or_unlimited(lo: int, hi: int) -> Sampler:
    """An integer, or no limit with the chance of one more value."""
    return lambda rng: rng.choice([*range(lo, hi + 1), None])


def uniform(lo: float, hi: float) -> Sampler:
    return lambda rng: rng.uniform(lo, hi)


def log_uniform(lo: float, hi: float) -> Sampler:
    return lambda rng: math.exp(rng.uniform(math.log(lo), math.log(hi)))


def one_of(*values) -> Sampler:
    return lambda rng: rng.choice(values)


# --- fixed values shared with the reference -------------------------------------------
CHURN_MODELS = {
    "Logistic Regression": {"C": 0.1},
    "Random Forest": {"n_estimators": 200, "max_depth": 6},
    "Hist Gradient Boosting": {"max_iter": 200, "learning_rate": 0.05, "max_depth": 3},
}
GRIDS = {
    "Random Forest": {"n_estimators": [100, 200], "max_depth": [None, 6, 10], "min_samples_split": [2, 5]},
    "Hist Gradient Boosting": {"max_iter": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [3, 5]},
    "Logistic Regression": {"C": [0.01, 0.1, 1, 10], "solver": ["lbfgs", "liblinear"]},
}
REVENUE_GRIDS = {
    "Ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "Random Forest": {"n_estimators": [100, 200], "max_depth": [6, 10, None], "max_features": ["sqrt", 0.5]},
    "Gradient Boosting": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [3, 5]},
}
# ranges of the random search: a sampler for each parameter
SEARCH_SPACES = {
    "Random Forest": {"n_estimators": whole(50, 300), "max_depth": whole_or_unlimited(3, 20),
                      "min_samples_split": whole(2, 10)},
    "Hist Gradient Boosting": {"max_iter": whole(50, 300), "learning_rate": log_uniform(0.01, 0.3),
                               "max_depth": whole(2, 8), "l2_regularization": uniform(0.0, 10.0)},
    "Logistic Regression": {"C": log_uniform(0.001, 100), "solver": one_of("lbfgs", "liblinear")},
}
REVENUE_SEARCH_SPACES = {
    "Ridge": {"alpha": log_uniform(0.001, 1000)},
    "Random Forest": {"n_estimators": whole(50, 300), "max_depth": whole_or_unlimited(3, 20),
                      "max_features": uniform(0.3, 1.0)},
    "Gradient Boosting": {"n_estimators": whole(50, 300), "learning_rate": log_uniform(0.01, 0.3),
                          "max_depth": whole(2, 8), "subsample": uniform(0.6, 1.0)},
}


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def forest(params: dict, label: str, features: str, weight: str | None = None, regression: bool = False, seed: int = 42) -> Estimator:
    """MLlib estimator of a random forest by the reference's parameters."""
    depth = params.get("max_depth", 8 if regression else 6)
    common = dict(labelCol=label, featuresCol=features, maxDepth=MLLIB_MAX_DEPTH if depth is None else depth, seed=seed,
                  **({"weightCol": weight} if weight else {}))
    if regression:
        return RandomForestRegressor(numTrees=params.get("n_estimators", 200), featureSubsetStrategy=str(params.get("max_features", "all")), **common)
    return RandomForestClassifier(numTrees=params.get("n_estimators", 100),
                                  minInstancesPerNode=max(1, math.ceil(params.get("min_samples_split", 2) / 2)), **common)


def boost(name: str, params: dict, seed: int = 42) -> B.Boost:
    """Boosting settings by the reference's parameters."""
    if name == "Hist Gradient Boosting":
        return B.Boost("logistic", params.get("max_iter", 100), params.get("learning_rate", 0.1), params.get("max_depth", 3),
                       params.get("l2_regularization", 0.0), least=20, leaves=31, seed=seed)
    if name == "Gradient Boosting":
        return B.Boost("squared", params.get("n_estimators", 200), params.get("learning_rate", 0.1), params.get("max_depth", 4),
                       least=1, leaves=None, subsample=params.get("subsample", 1.0), seed=seed)
    raise ValueError(name)


def _penalised(params: dict) -> bool:
    return params.get("solver", "lbfgs") == "liblinear"


TARGET_PARTITION_BYTES = 4 * 1024 * 1024


def parts_for(n_rows: int, n_features: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Partitions of a model's rows, by ~``target_bytes`` of feature data each: iterative learners scan the rows in every
    step and compute far longer than they read, so a few MB are work for a core; tiny partitions only add scheduling."""
    return max(1, math.ceil(n_rows * max(1, n_features) * 8 / target_bytes))


def positive_probability(pred: DataFrame, out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


# -- M10: cross-validation with all fold metrics in one pass -------------------------------

def grouped_binary_metrics(df: DataFrame, by: Sequence[str], label: str = "Churn", score: str = "p",
                           threshold: float = 0.5) -> DataFrame:
    """ROC-AUC, average precision, F1 and recall per group (e.g. model × fold).

    One count aggregation per (group, score), one distributed prefix-sum pass
    (ascending); descending cumulative counts are ``total − before`` and the
    threshold counts are conditional sums over the same per-score rows.
    """
    y = F.col(label)
    counts = (df.groupBy(*by, F.col(score).cast("double").alias("score"))
              .agg(F.count_if(y == 1).cast("long").alias("pos"), F.count_if(y != 1).cast("long").alias("neg")))
    asc = R.prefix_sums(counts, list(by), "score", ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_before")          # positives with score ≥ this score
    fp = F.col("neg_total") - F.col("neg_before")
    at = F.col("score") >= threshold
    g = asc.groupBy(*by).agg(
        (F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
         / (F.max("pos_total").cast("double") * F.max("neg_total"))).alias("roc_auc"),
        F.sum(F.col("pos") / F.col("pos_total") * (tp / (tp + fp))).alias("pr_auc"),
        F.sum(F.when(at, F.col("pos")).otherwise(0)).cast("double").alias("__tp"),
        F.sum(F.when(at, F.col("neg")).otherwise(0)).cast("double").alias("__fp"),
        F.max("pos_total").cast("double").alias("__P"))
    rec = F.coalesce(F.try_divide(F.col("__tp"), F.col("__P")), F.lit(0.0))
    pre = F.coalesce(F.try_divide(F.col("__tp"), F.col("__tp") + F.col("__fp")), F.lit(0.0))
    return g.select(*by, "roc_auc", "pr_auc", rec.alias("recall"),
                    F.coalesce(F.try_divide(2 * pre * rec, pre + rec), F.lit(0.0)).alias("f1"))


@dataclass
class ForestModel:
    """An MLlib forest (classification or regression)."""

    inner: object
    regression: bool = False

    def score(self, df: DataFrame, out: str) -> DataFrame:
        p = self.inner.transform(df)
        if self.regression:
            return p if out == "prediction" else p.withColumnRenamed("prediction", out)
        return positive_probability(p, out).drop("rawPrediction", "probability", "prediction")

    def importances(self) -> list[float]:
        return self.inner.featureImportances.toArray().tolist()


@dataclass
class OnComponents:
    """A model on PCA components; a component's importance goes to the inputs by the size of their loadings."""

    pca: object
    inner: object

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return self.inner.score(self.pca.transform(df), out).drop(self.pca.getOutputCol())

    def importances(self) -> list[float]:
        return (abs(self.pca.pc.toArray()) @ self.inner.importances()).tolist()


def restore(d: dict):
    """A linear or boosted model from its saved form."""
    return {"linear": L.LinearModel, "boosted": B.BoostedTrees}[d["type"]].from_dict(d)


def fit_classifier(rows: DataFrame, name: str, params: dict, features: str = "features", label: str = "Churn",
                   weight: str = "weight", key: str = "CustomerID"):
    """One model on all rows."""
    if name == "Logistic Regression":
        return L.fit_logistic(rows, [L.LogisticJob("m", params.get("C", 1.0), None, _penalised(params))], features, label, weight, None)[0]
    if name == "Random Forest":
        return ForestModel(forest(params, label, features, weight).fit(rows))
    return B.fit(B.bin_rows(rows, features, label, key, weight, None), boost(name, params))


def fit_regressor(rows: DataFrame, name: str, params: dict, features: str = "features", label: str = "label", key: str = "CustomerID"):
    if name == "Ridge":
        return L.ridge_from_gram(sum(L.fold_grams(rows, features, label).values()), params.get("alpha", 1.0), features)
    if name == "Random Forest":
        return ForestModel(forest(params, label, features, regression=True).fit(rows), True)
    return B.fit(B.bin_rows(rows, features, label, key, None, None), boost(name, params))


Settings = dict[str, tuple[str, dict]]      # tag -> (learner, parameters)


def forest_spec(params: dict, regression: bool, seed: int = 42) -> RF.Forest:
    """:func:`forest` for the kernel of :mod:`forest`."""
    depth = params.get("max_depth", 8 if regression else 6)
    return RF.Forest(params.get("n_estimators", 200 if regression else 100), MLLIB_MAX_DEPTH if depth is None else depth,
                     1 if regression else max(1, math.ceil(params.get("min_samples_split", 2) / 2)),
                     str(params.get("max_features", "all")) if regression else "sqrt", not regression, seed)


def _mllib_folds(df: DataFrame, specs: dict[str, dict], features, label, weight, regression, folds, parallelism: int = 8) -> DataFrame:
    """Fold predictions of MLlib forests; fits run side by side from a thread pool."""
    def one(t):
        tag, f = t
        m = ForestModel(forest(specs[tag], label, features, weight, regression).fit(df.where(F.col("fold") != f)), regression)
        return m.score(df.where(F.col("fold") == f), "p").select(F.lit(tag).alias("model"), F.lit(f).alias("fold"), F.col(label).cast("double").alias(label), "p")

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(one, [(tag, f) for tag in specs for f in folds]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Binned:
    """The binned rows of ``bin_rows``'s arguments, made when a learner first asks for them."""

    def __init__(self, *args):
        self.args, self.lock, self.rows = args, threading.Lock(), None

    def __call__(self) -> B.Rows:
        with self.lock:
            if self.rows is None:
                self.rows = B.bin_rows(*self.args)
            return self.rows


def fold_predictions(df: DataFrame, specs: Settings, features: str = "features", label: str = "Churn", weight: str | None = "weight",
                     key: str = "CustomerID", k: int = 5, binned: Binned | None = None) -> DataFrame:
    """Out-of-fold predictions (model, fold, label, p) of every setting; those of one learner are fitted together, the
    learners side by side, and trees of both kinds share the binned rows (``binned`` where calls share them too).

    ``weight=None`` and a real label mean regression.
    """
    folds, binned = range(k), binned or Binned(df, features, label, key, weight)
    by: dict[str, dict[str, dict]] = {}
    for tag, (name, params) in specs.items():
        by.setdefault(name, {})[tag] = params

    def one(name: str) -> DataFrame:
        own = by[name]
        if name == "Logistic Regression":
            jobs = [L.LogisticJob(t, p.get("C", 1.0), f, _penalised(p)) for t, p in own.items() for f in folds]
            models = L.fit_logistic(df, jobs, features, label, weight)
            return L.predict_folds(df, {(j.tag, j.leave): m for j, m in zip(jobs, models)}, label)
        if name == "Ridge":
            models = L.ridge_folds(L.fold_grams(df, features, label), {p.get("alpha", 1.0) for p in own.values()}, features)
            return L.predict_folds(df, {(t, f): models[p.get("alpha", 1.0), f] for t, p in own.items() for f in folds}, label)
        if name == "Random Forest":
            forests = {t: forest_spec(p, weight is None) for t, p in own.items()}
            if max(s.depth for s in forests.values()) <= RF.MOST_DEPTH and binned().is_small:
                return RF.cross_validate(binned(), forests, folds, label)
            return _mllib_folds(df, own, features, label, weight, weight is None, folds)
        return B.cross_validate(binned(), {t: boost(name, p) for t, p in own.items()}, folds, label)
    with ThreadPoolExecutor(max_workers=len(by)) as pool:
        parts = list(pool.map(one, by))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(df: DataFrame, specs: Settings, **how) -> DataFrame:
    """Per (model, fold) metrics of every setting; training on the other folds."""
    return grouped_binary_metrics(fold_predictions(df, specs, **how), ["model", "fold"], how.get("label", "Churn"), "p")


def cross_validate_regression(df: DataFrame, specs: Settings, **how) -> DataFrame:
    """R2, MAE and the other regression metrics per (model, fold)."""
    preds = fold_predictions(df, specs, weight=None, **({"label": "label"} | how))
    return X.regression_metrics(preds, how.get("label", "label"), "p", by=["model", "fold"])


def cv_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population std over folds per model."""
    ms = ["pr_auc", "roc_auc", "f1", "recall"]
    return fold_metrics.groupBy("model").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in ms], *[F.stddev_pop(m).alias(f"{m}_std") for m in ms])


# -- M12 / M13 / M14: tuning --------------------------------------------------------------

def _grid_points(grid: dict[str, list]) -> list[dict]:
    pts = [{}]
    for k, vals in grid.items():
        pts = [dict(p, **{k: v}) for p in pts for v in vals]
    return pts


def random_points(space: dict[str, Sampler], n: int, seed: int = 42) -> list[dict]:
    """M13 re-aimed: ``n`` seeded random draws, every parameter by its own sampler."""
    rng = random.Random(seed)
    return [{name: draw(rng) for name, draw in space.items()} for _ in range(n)]


Trials = list[tuple[dict, float]]


def search(df: DataFrame, name: str, points: list[dict], features: str = "features", regression: bool = False,
           binned: Binned | None = None) -> tuple[Trials, dict]:
    """Mean metric over the folds (PR-AUC, or R2) of each parameter point (M12/M13) and the best point.

    All points of a linear or boosted learner are fitted and scored together; forests go point by point, so that at most
    one point's models are alive.  The rows are binned once (``binned``: for several searches).
    """
    cv, metric, label, weight = (cross_validate_regression, "r2", "label", None) if regression else (cross_validate, "pr_auc", "Churn", "weight")
    specs, binned = {f"t{i}": (name, p) for i, p in enumerate(points)}, binned or Binned(df, features, label, "CustomerID", weight)
    groups = [{t: s} for t, s in specs.items()] if name == "Random Forest" else [specs]
    got: dict[str, float] = {}
    for g in groups:
        got |= {r["model"]: float(r["m"]) for r in cv(df, g, features=features, binned=binned).groupBy("model").agg(F.avg(metric).alias("m")).collect()}
    results = [(p, got[f"t{i}"]) for i, p in enumerate(points)]
    return results, max(results, key=lambda r: r[1])[0]


# -- M8 / M15 / M16: explanation ----------------------------------------------------------

def importances(model, features: Sequence[str], top: int | None = None) -> list[tuple[str, float]]:
    """Feature importances (trees) or |coefficients| (linear), sorted desc."""
    pairs = sorted(zip(features, model.importances()), key=lambda t: (-t[1], t[0]))
    return pairs[:top] if top else pairs


def surrogate_tree(df: DataFrame, pseudo_label: str, max_depth: int = 3, seed: int = 42):
    """M8: depth-3 tree fitted to the thresholded (calibrated) predictions."""
    return DecisionTreeClassifier(labelCol=pseudo_label, maxDepth=max_depth, seed=seed).fit(df)


def pca_fit(df: DataFrame, features: str, k_max: int, threshold: float = 0.95):
    """PCA on (already centred, scaled) features; k = first cumulative
    explained variance ≥ threshold.  Returns (model with k, explained variance list)."""
    full = PCA(k=k_max, inputCol=features, outputCol="pca").fit(df)
    ev = full.explainedVariance.toArray().tolist()
    cum, k = 0.0, k_max
    for i, v in enumerate(ev):
        cum += v
        if cum >= threshold:
            k = i + 1
            break
    model = PCA(k=k, inputCol=features, outputCol="pca").fit(df) if k != k_max else full
    return model, ev
