"""Stream result = batch result (R8 vs R3), and drift micro-batches cover all features."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_stream_scoring_equals_batch(spark):
    """The stream scores request bodies; its batch twin parses the same bodies."""
    q = E.queries()
    b = q["s08_r02_request_scoring"](spark, SF)
    batch = {tuple(r) for r in b.collect()}
    stream = q["r08_stream_scoring"](spark, SF).select(*b.columns)
    got = {tuple(r) for r in stream.collect()}
    assert got == batch and len(got) > 0


def test_calibrated_probabilities_monotone_and_bounded(spark):
    from custaris.plans.training import churn_run
    r = churn_run(spark, SF)
    rows = r.test().select("p", "p_cal").orderBy("p").collect()
    cal = [x["p_cal"] for x in rows]
    assert all(0.0 <= v <= 1.0 for v in cal)
    assert all(a <= b + 1e-12 for a, b in zip(cal, cal[1:]))
