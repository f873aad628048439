"""The tuned chain end to end: the registered settings, and short ones for the ways they don't take."""

import json

import pytest
from pyspark.sql import functions as F

from custaris.operators import models as M
from custaris.plans import q_models as Q
from custaris.plans import training as T
from custaris.plans.catalog import c360
from custaris.sources import requests as RQ
from custaris.streaming import scoring as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tuned(spark):
    spark.conf.set("custaris.model.tune", "true")
    yield
    spark.conf.set("custaris.model.tune", "false")


@pytest.fixture()
def short(tuned, monkeypatch):
    """Forests of a few trees; other settings are other entries of the store."""
    monkeypatch.setattr(M, "CHURN_MODELS", {"Random Forest": {"n_estimators": 3, "max_depth": 2}})
    monkeypatch.setattr(M, "GRIDS", {"Random Forest": {"n_estimators": [2], "max_depth": [2]}})
    monkeypatch.setattr(M, "SEARCH_SPACES", {"Random Forest": {"n_estimators": M.whole(2, 4), "max_depth": M.whole(1, 2)}})
    monkeypatch.setattr(T, "N_RANDOM_TRIALS", 1)


def check_scoring(spark, run):
    """An unreadable body keeps its row."""
    bodies = RQ.request_json(c360(spark, SF).limit(5)).unionByName(
        spark.createDataFrame([("{broken",), (json.dumps({"customer_id": 7}),), (None,)], "body string"))
    rows = ST.score_requests(bodies, run).collect()
    bad = [r for r in rows if r["error"] is not None]
    assert len(rows) == 8 and len(bad) == 2
    assert all(r["probability"] is None and r["label"] is None for r in bad)
    assert all(0 <= r["probability"] <= 1 for r in rows if r["error"] is None)


def test_registered_settings_once(spark, tuned):
    run, tuned_to = T.churn_run(spark, SF), T.churn_trials(spark, SF)
    assert len(tuned_to["random"]) == 30 and len(tuned_to["grid"]) == len(M._grid_points(M.GRIDS[tuned_to["best_name"]]))
    trials = tuned_to["grid"] + tuned_to["random"]
    assert max(s for _, s in trials) == max(s for p, s in trials if p == run.params)
    assert {f for f, _ in M.importances(run.model, run.feats)} == set(run.feats)
    assert Q.m11(spark, SF).where("chosen is not null").count() == 1
    check_scoring(spark, run)


def test_another_session_fits_nothing(spark, tuned, monkeypatch):
    """What is in the store is read: no fit runs again, whoever asks."""
    want = T.churn_run(spark, SF)
    monkeypatch.setattr(T, "store", lambda s, f, own=T.Store(spark, T._fingerprint(SF)): own)
    for name in ("fit_classifier", "search", "cross_validate", "pca_fit"):
        monkeypatch.setattr(M, name, lambda *a, **k: pytest.fail("fitted again"))
    got = T.churn_run(spark, SF)
    assert (got.params, got.threshold, got.iso) == (want.params, want.threshold, want.iso)
    assert json.dumps(got.model.to_dict()) == json.dumps(want.model.to_dict())


def test_forest_on_components(spark, short, monkeypatch):
    choice = T.churn_choice
    monkeypatch.setattr(T, "churn_choice", lambda *a: choice(*a) | {"use_pca": True})
    run = T.churn_run(spark, SF)
    assert isinstance(run.model, M.OnComponents) and isinstance(run.model.inner, M.ForestModel)
    assert {f for f, _ in M.importances(run.model, run.feats)} == set(run.feats)
    check_scoring(spark, run)
    rules = [r.rule for r in Q.m16t(spark, SF).collect()]   # the forest's first tree, on components
    assert len(rules) >= 2 and all(r.startswith("if pca_") for r in rules)
    n = run.train().count()
    assert sum(int(x) for r in rules for x in (r.split("(")[1].split(" ")[0], r.split(", ")[1].split(" ")[0])) == n


def test_search_picks_the_best_revenue_point(spark):
    df = spark.range(200).select((F.col("id") % 5).cast("int").alias("fold"), (F.col("id") * 0.5).alias("label"),
                                 F.col("id").cast("double").alias("x"))
    rows = M.assemble(df, ["x"])
    results, best = M.search(rows, "Ridge", [{"alpha": 0.01}, {"alpha": 1e9}], regression=True)
    assert best == {"alpha": 0.01} and results[0][1] > 0.99 > results[1][1]


def test_replayed_batch_is_not_doubled(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        ST.write_batch(df, str(tmp_path / "sink"), 0)
    ST.write_batch(df, str(tmp_path / "sink"), 1)
    got = spark.read.parquet(str(tmp_path / "sink")).groupBy("batch_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 3), (1, 3)]
