"""Stages of the churn and revenue trainings, each kept in the model store.

A stage asks the store for its result and only computes what isn't there: prepared rows, fold metrics, components, the
choice of model, trials, the final model with its calibration and threshold, scored rows.  Queries ask for the stage they
show, so none waits for another's fits, and a second process reads what a first one has fitted.  An entry's settings hold
all parameters that it depends on.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import PCAModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import isotonic as I
from ..operators import metrics as X
from ..operators import models as M
from ..operators import split as E
from ..sources.store import Store, store_of
from .catalog import _fingerprint, c360

N_RANDOM_TRIALS = 30  # as the reference
THRESHOLD_FLOOR = 0.40
# fixed values: columns derived from the revenue target; models of its comparison
REVENUE_DROP = ["MonetaryTotal", "AvgBasketValue", "RevenueIndex", "MonetaryAvg", "MonetaryMax"]
REVENUE_MODELS = {"Ridge": {"alpha": 1.0}, "Random Forest": {"n_estimators": 200, "max_depth": 8},
                  "Gradient Boosting": {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8}}


def store(spark, sf) -> Store:
    return store_of(spark, _fingerprint(sf))


def split_customers(spark, sf) -> DataFrame:
    return E.hash_split(c360(spark, sf), "CustomerID")


def prepared(spark, sf) -> FE.FittedPrep:
    """The transform fitted on the train rows, shared by both models and the segments."""
    state = store(spark, sf).value("prep", {}, lambda: json.loads(
        FE.fit_prep(split_customers(spark, sf), F.col("split") == "train", passthrough=["split"]).to_json()))
    return FE.FittedPrep.from_json(json.dumps(state))


def feature_rows(spark, sf) -> DataFrame:
    """Customers with split, fold, calibration split, label, features (each and as a vector) and class weight (train rows)."""
    def build():
        prep, df = prepared(spark, sf), split_customers(spark, sf)
        x = E.hash_folds(prep.transform(df, keep=["split"]), "CustomerID")
        x = E.hash_split(x, "CustomerID", salt="calib42", col="calib_split")          # E4 inside train
        x = M.assemble(x, prep.features)
        is_train = F.col("split") == "train"
        weighted = E.balanced_weights(x.where(is_train), "Churn")
        out = weighted.unionByName(x.where(~is_train).withColumn("weight", F.lit(None).cast("double")))
        return out.repartition(M.parts_for(df.count(), len(prep.features)), "CustomerID")
    return store(spark, sf).table("rows", {}, build)


def train_rows(spark, sf) -> DataFrame:
    return feature_rows(spark, sf).where("split = 'train'")


# -- churn: comparison (M10, M11) ----------------------------------------------------------

def _candidates() -> M.Settings:
    return {n: (n, p) for n, p in M.CHURN_MODELS.items()}


def churn_folds(spark, sf) -> DataFrame:
    """Fold metrics of the compared models on the raw features."""
    return store(spark, sf).table("churn-folds", M.CHURN_MODELS, lambda: M.cross_validate(train_rows(spark, sf), _candidates()))


def _means(folds: DataFrame) -> dict[str, float]:
    return {r["model"]: float(r["m"]) for r in folds.groupBy("model").agg(F.avg("pr_auc").alias("m")).collect()}  # a row a model


def side_by_side(*stages) -> list:
    """Results of stages that don't wait for each other: one's last tasks leave cores to the others."""
    with ThreadPoolExecutor(max_workers=len(stages)) as pool:
        return [f.result() for f in [pool.submit(s) for s in stages]]


def best_of(scores: dict[str, float]) -> str:
    return max(scores, key=lambda n: (scores[n], n))


def churn_pca(spark, sf) -> tuple[PCAModel, list[float]]:
    """components of the train rows and the explained variance of all of them."""
    s, n = store(spark, sf), len(prepared(spark, sf).features)
    fitted = {}

    def fit():
        if not fitted:
            fitted["model"], fitted["explained"] = M.pca_fit(train_rows(spark, sf), "features", n)
        return fitted
    explained = s.value("explained", {}, lambda: fit()["explained"])
    return s.model("pca", {}, lambda: fit()["model"], PCAModel), explained


def component_rows(spark, sf) -> DataFrame:
    return store(spark, sf).table("rows-pca", {}, lambda: churn_pca(spark, sf)[0].transform(train_rows(spark, sf)))


def component_folds(spark, sf) -> DataFrame:
    """Fold metrics of the compared models on the components."""
    return store(spark, sf).table("churn-folds-pca", M.CHURN_MODELS, lambda: M.cross_validate(
        component_rows(spark, sf), _candidates(), features="pca"))


def churn_choice(spark, sf, tuned: bool) -> dict:
    """The pair of model and features that goes on (raw wins a tie); untuned runs compare raw features only."""
    raw, reduced = side_by_side(lambda: _means(churn_folds(spark, sf)), lambda: _means(component_folds(spark, sf)) if tuned else {})
    out = dict(raw=raw, reduced=reduced, use_pca=False, model=best_of(raw))
    if tuned:
        out["use_pca"] = reduced[best_of(reduced)] > raw[out["model"]]
        out["model"] = best_of(reduced) if out["use_pca"] else out["model"]
    return out


# -- tuning (M12-M14) ----------------------------------------------------------------------

def both_tuners(search, grid, space) -> dict:
    """Both searches side by side; the random one wins only with a higher score."""
    with ThreadPoolExecutor(max_workers=2) as pool:
        g = pool.submit(search, M._grid_points(grid))
        q = pool.submit(search, M.random_points(space, N_RANDOM_TRIALS))
        (grid_res, grid_best), (rnd_res, rnd_best) = g.result(), q.result()
    tuner = "random" if max(s for _, s in rnd_res) > max(s for _, s in grid_res) else "grid"
    return dict(grid=grid_res, random=rnd_res, tuner=tuner, params=rnd_best if tuner == "random" else grid_best)


def _spaces(grid, space) -> dict:
    """What trials depend on: the grid and the points drawn."""
    return {"grid": grid, "random": M.random_points(space, N_RANDOM_TRIALS)}


def churn_trials(spark, sf) -> dict:
    """M12-M14 for the model and features chosen by M10 and M11."""
    c = churn_choice(spark, sf, True)
    name, features = c["model"], "pca" if c["use_pca"] else "features"
    grid, space = M.GRIDS[name], M.SEARCH_SPACES[name]

    def build():
        rows = component_rows(spark, sf) if c["use_pca"] else train_rows(spark, sf)
        binned = M.Binned(rows, features, "Churn", "CustomerID", "weight")
        return both_tuners(lambda points: M.search(rows, name, points, features, binned=binned), grid, space)
    got = store(spark, sf).value("churn-trials", {"model": name, "on": features, **_spaces(grid, space)}, build)
    return {"best_name": name, **got}


# -- final churn model (M9, M14) -----------------------------------------------------------

def is_tuned(spark) -> bool:
    """``custaris.model.tune`` (default true): false keeps the stated parameters and raw features in the final fits."""
    return spark.conf.get("custaris.model.tune", "true").lower() == "true"


def _kept(s: Store, name: str, settings: dict, fit, kind):
    """A fitted model: linear and boosted ones as values, forests as MLlib models."""
    if settings["model"] != "Random Forest":
        return M.restore(s.value(name, settings, lambda: fit().to_dict()))
    return M.ForestModel(s.model(name, settings, lambda: fit().inner, kind), kind is RandomForestRegressionModel)


class ChurnRun:
    """The final model: fitted on the fit rows, calibrated and given its threshold on the calibration rows."""

    def __init__(self, spark, sf):
        self.spark, self.sf, self.tuned = spark, sf, is_tuned(spark)
        self.prep = prepared(spark, sf)
        self.feats = self.prep.features
        choice = churn_choice(spark, sf, self.tuned)
        self.best_name, self.use_pca = choice["model"], choice["use_pca"]
        self.params = churn_trials(spark, sf)["params"] if self.tuned else M.CHURN_MODELS[self.best_name]
        s = store(spark, sf)
        self.settings = {"model": self.best_name, "pca": self.use_pca, "params": self.params, "floor": THRESHOLD_FLOOR}
        features = "pca" if self.use_pca else "features"

        def rows():
            return (component_rows if self.use_pca else train_rows)(spark, sf).where("calib_split = 'train'")
        inner = _kept(s, "churn-model", self.settings, lambda: M.fit_classifier(rows(), self.best_name, self.params, features),
                      RandomForestClassificationModel)
        self.model = M.OnComponents(churn_pca(spark, sf)[0], inner) if self.use_pca else inner

        def calibrate():
            pred = self.model.score(train_rows(spark, sf).where("calib_split = 'test'"), "p")
            iso = I.fit(pred)
            found = X.f2_threshold(iso.transform(pred), "Churn", "p_cal", THRESHOLD_FLOOR).first()
            return {"iso": iso.to_dict(), "threshold": float(found["threshold"])}
        cal = s.value("churn-calibration", self.settings, calibrate)
        self.iso, self.threshold = I.Isotonic.from_dict(cal["iso"]), cal["threshold"]

    def score(self, df: DataFrame) -> DataFrame:
        """Feature rows with ``p``, ``p_cal`` and ``prediction_cal``."""
        out = self.iso.transform(self.model.score(df, "p"))
        return out.withColumn("prediction_cal", (F.col("p_cal") >= self.threshold).cast("int"))

    def scored(self) -> DataFrame:
        """All rows of the training, scored (a stored table)."""
        return store(self.spark, self.sf).table("churn-scored", self.settings, lambda: self.score(feature_rows(self.spark, self.sf)))

    def test(self) -> DataFrame:
        return self.scored().where("split = 'test'")

    def train(self) -> DataFrame:
        return self.scored().where("split = 'train'")

    def calibration(self) -> DataFrame:
        return self.train().where("calib_split = 'test'")


def churn_run(spark, sf) -> ChurnRun:
    return ChurnRun(spark, sf)


# -- revenue (M4-M6) -----------------------------------------------------------------------

def revenue_cap(spark, sf) -> float:
    """the 0.99 quantile of the train rows' revenue; needs neither features nor models."""
    return store(spark, sf).value("revenue-cap", {"q": 0.99}, lambda: float(FE.cap_at_quantile(
        split_customers(spark, sf).select("split", "MonetaryTotal"), "MonetaryTotal", F.col("split") == "train", 0.99)[1]))


def revenue_features(spark, sf) -> list[str]:
    return [f for f in prepared(spark, sf).features if f not in REVENUE_DROP]


def revenue_rows(spark, sf) -> DataFrame:
    """Feature rows with the raw, capped and log target."""
    def build():
        feats, cap = revenue_features(spark, sf), revenue_cap(spark, sf)
        raw = c360(spark, sf).select("CustomerID", F.col("MonetaryTotal").alias("target_raw"))
        x = feature_rows(spark, sf).select("CustomerID", "split", "fold", *feats).join(raw, "CustomerID")
        x = x.withColumn("target_capped", F.least("target_raw", F.lit(cap)))
        x = M.assemble(x.withColumn("label", F.log1p(F.greatest("target_capped", F.lit(0.0)))), feats)
        return x.repartition(M.parts_for(x.count(), len(feats)), "CustomerID")
    return store(spark, sf).table("revenue-rows", {"drop": REVENUE_DROP}, build)


def _revenue_train(spark, sf):
    return revenue_rows(spark, sf).where("split = 'train'")


def revenue_folds(spark, sf) -> DataFrame:
    """Fold metrics of the compared regression models."""
    return store(spark, sf).table("revenue-folds", REVENUE_MODELS, lambda: M.cross_validate_regression(
        _revenue_train(spark, sf), {n: (n, p) for n, p in REVENUE_MODELS.items()}))


def revenue_choice(spark, sf) -> str:
    got = revenue_folds(spark, sf).groupBy("model").agg(F.avg("r2").alias("m")).collect()  # a row a model
    return best_of({r["model"]: r["m"] for r in got})


def revenue_trials(spark, sf) -> dict:
    name = revenue_choice(spark, sf)
    grid, space = M.REVENUE_GRIDS[name], M.REVENUE_SEARCH_SPACES[name]

    def build():
        rows = _revenue_train(spark, sf)
        binned = M.Binned(rows, "features", "label", "CustomerID", None)
        return both_tuners(lambda points: M.search(rows, name, points, regression=True, binned=binned), grid, space)
    return store(spark, sf).value("revenue-trials", {"model": name, **_spaces(grid, space)}, build)


class RevenueRun:
    """The final revenue model on all train rows (log target)."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.prep, self.feats, self.cap = prepared(spark, sf), revenue_features(spark, sf), revenue_cap(spark, sf)
        self.best_name = revenue_choice(spark, sf)
        self.params = revenue_trials(spark, sf)["params"] if is_tuned(spark) else REVENUE_MODELS[self.best_name]
        self.model = _kept(store(spark, sf), "revenue-model", {"model": self.best_name, "params": self.params},
                           lambda: M.fit_regressor(_revenue_train(spark, sf), self.best_name, self.params), RandomForestRegressionModel)

    def test(self) -> DataFrame:
        pred = self.model.score(revenue_rows(self.spark, self.sf).where("split = 'test'"), "prediction")
        return pred.withColumn("pred_raw", F.expm1(F.greatest(F.col("prediction"), F.lit(0.0))))


def revenue_run(spark, sf) -> RevenueRun:
    return RevenueRun(spark, sf)
