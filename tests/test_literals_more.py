"""More literal-row checks: class report, balanced weights, AUC degradation, request parsing."""

from pyspark.sql import functions as F

from custaris.operators import drift as D
from custaris.operators import metrics as X
from custaris.operators import split as E
from custaris.sources import requests as RQ


def test_class_report_literal(spark):
    # labels 0,0,1,1 ; predictions 0,1,1,1
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int")
    rep = {r["row"]: r for r in X.class_report(df, "y", "p").collect()}
    assert rep["0"]["precision"] == 1.0 and rep["0"]["recall"] == 0.5
    assert abs(rep["1"]["precision"] - 2 / 3) < 1e-12 and rep["1"]["recall"] == 1.0
    assert rep["accuracy"]["f1"] == 0.75 and rep["weighted avg"]["support"] == 4


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    w = {r["y"]: r["weight"] for r in E.balanced_weights(df, "y").distinct().collect()}
    assert abs(w[0] - 4 / 6) < 1e-12 and abs(w[1] - 2.0) < 1e-12


def test_auc_degradation_flag(spark):
    rows = [("reference", 0, 0.1), ("reference", 1, 0.9), ("current", 0, 0.9), ("current", 1, 0.1)]
    df = spark.createDataFrame(rows, "side string, y int, s double")
    r = D.auc_degradation(df, "side", "y", "s").first()
    assert r["auc_ref"] == 1.0 and r["auc_cur"] == 0.0 and r["status"] == "DEGRADED"


def test_request_parsing_defaults_and_bad_json(spark):
    bodies = spark.createDataFrame([('{"customer_id": 7, "frequency": "3", "age": "x"}',), ("not json",)], "body string")
    out = RQ.parse_requests(bodies).orderBy(F.col("CustomerID").asc_nulls_last()).collect()
    good, bad = out[0], out[1]
    assert good["CustomerID"] == 7 and good["Frequency"] == 3.0 and good["Age"] == 35.0
    assert good["CustomerTenureDays"] == 365.0 and good["Country"] == "United Kingdom" and not good["_corrupt"]
    assert bad["_corrupt"] and bad["Frequency"] == 1.0
