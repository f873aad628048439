"""The input of ordered statistics is read once, and any number of buckets gives the same result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from custaris.operators import metrics as X
from custaris.operators import ranks as R


@pytest.fixture()
def watched(spark):
    """Rows that count how often they are read."""
    seen = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i % 3, float(v), int(v + rng.normal() > 1)) for i, v in enumerate(np.round(rng.normal(size=900), 2))],
                               "g int, v double, y int")

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(through, df.schema), seen


@pytest.mark.parametrize("ask", [
    lambda d: R.exact_median(d, ["g"], "v"), lambda d: R.exact_quantiles(d, [], "v", [0.1, 0.9]),
    lambda d: X.roc_auc(d, "y", "v"), lambda d: X.pr_areas(d, "y", "v")])
def test_input_is_read_once(watched, ask):
    df, seen = watched
    ask(df).collect()
    assert seen.value == 900


def test_any_number_of_buckets(watched, monkeypatch):
    df, _ = watched
    def both():
        q = sorted(map(tuple, R.exact_quantiles(df, ["g"], "v", [0, 0.25, 0.5, 0.9, 1]).collect()))
        return q, X.roc_auc(df, "y", "v").first()[0], R.prefix_sums(R.value_counts(df, [], "v"), [], "v", ["__c"], descending=True) \
            .agg(F.sum("__c_before"), F.max("__c_total")).first()
    want = both()
    for rows, bound in ((40, 1 << 20), (7, 1 << 20), (7, 0)):
        monkeypatch.setattr(R, "BUCKET_ROWS", rows)
        monkeypatch.setattr(R, "MAX_BROADCAST_BOUNDS", bound)
        assert both() == want
    pdf = df.toPandas()
    assert dict((g, q) for g, p, q in want[0] if p == 0.5) == pytest.approx(pdf.groupby("g").v.median().to_dict())
