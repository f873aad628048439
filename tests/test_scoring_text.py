"""Scoring defaults, money text, the legacy score and the revenue report."""

import pytest
from pyspark.sql import functions as F

from custaris.functions import scalar as SF
from custaris.operators import features as FE

FOLDER = "/root/testdata/sf0.001"


def test_scoring_ordinals_default_where_training_gives_null(spark):
    rows = [("18-24", "Soir", "VIP", "Inconnu"), ("?", "", "low", None), (None, None, None, "Petit")]
    df = spark.createDataFrame(rows, "AgeCategory string, PreferredTimeOfDay string, SpendingCategory string, BasketSizeCategory string")
    got = [tuple(r) for r in SF.scoring_ordinals(df).collect()]
    assert got == [(0, 4, 3, 3), (3, 2, 1, 1), (3, 2, 1, 0)]
    part = SF.scoring_ordinals(df.select("AgeCategory", F.lit(1).alias("other")))
    assert part.columns == ["AgeCategory", "other"]
    assert [r[0] for r in df.select(SF.ordinal(F.col("AgeCategory"), SF.AGE_CATEGORY_ORDER)).collect()] == [0, None, None]


@pytest.mark.parametrize("value,text", [(0.0, "£0"), (0.5, "£0"), (1.5, "£2"), (2.5, "£2"), (999.5, "£1,000"), (1234567.49, "£1,234,567"),
                                        (-1234.6, "£-1,235"), (None, None)])
def test_money_text_rounds_half_to_even(spark, value, text):
    row = spark.createDataFrame([(value,)], "v double").select(SF.money(F.col("v"))).first()
    assert row[0] == text
    assert value is None or text == f"£{value:,.0f}"


def test_legacy_disengagement(spark):
    df = spark.createDataFrame([(0.25, 3), (None, 1), (0.0, None)], "ReturnRatio double, CancelledTransactions int")
    got = [r.DisengagementScore for r in FE.legacy_disengagement(df).collect()]
    assert got[0] == pytest.approx(0.55) and got[1:] == [None, None]


def test_revenue_report_agrees_with_the_scores_and_the_metrics(spark):
    import __spark_entry__ as E
    q = E.queries()
    report = {r.CustomerID: r for r in q["r05_revenue_report"](spark, FOLDER).collect()}
    plain = {r.CustomerID: r for r in q["r05_revenue_scoring"](spark, FOLDER).collect()}
    assert report.keys() == plain.keys() and len(report) > 0
    for k, r in report.items():
        assert (r.tier, r.high_spender) == (plain[k].tier, plain[k].high_spender)
        assert r.predicted_revenue == pytest.approx(plain[k].predicted_revenue, rel=1e-5)
        assert r.predicted_revenue_text.startswith("£") and r.cap_text == f"£{r.cap_value:,.0f}"
    capped = q["x09_model_revenue_metrics"](spark, FOLDER).where("scale = 'capped'").first()
    one = next(iter(report.values()))
    assert one.model_name == capped.model and one.r2 == pytest.approx(capped.r2, abs=1e-4)
    assert one.mae == pytest.approx(capped.mae, rel=1e-5, abs=0.51)
    assert one.medae == pytest.approx(capped.medae, rel=1e-5, abs=0.51)
