"""Steps whose time or memory grew past the limits on larger tables."""

import re
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from custaris.operators import boosting as B
from custaris.operators import kmeans as KM
from custaris.operators import models as M


def test_model_rows_reach_all_cores():
    """Rows of a million customers with few features are work for a dozen cores, small ones stay together."""
    assert M.parts_for(900_000, 11) >= 12
    assert M.parts_for(72_000, 42) >= 5
    assert M.parts_for(1_500, 42) == 1


@pytest.mark.parametrize("spec", [B.Boost(rounds=6, rate=0.1, depth=4, l2=1.0), B.Boost(rounds=4, depth=7, leaves=9),
                                  B.Boost("squared", 5, 0.1, 4, least=1, leaves=None, subsample=0.7)])
def test_columns_give_the_same_trees(spec, monkeypatch):
    """Joint codes and sibling differences: trees and margins as from the sums of every cell."""
    rng = np.random.default_rng(5)
    n = 3000
    bins = np.hstack([rng.integers(0, 255, (n, 3)), rng.integers(0, 2, (n, 9)), rng.integers(0, 24, (n, 2)), np.zeros((n, 1))]).astype(np.uint8)
    y = (bins[:, 0] + 60.0 * bins[:, 3] + 50 * rng.random(n) > 180).astype(float)
    data = (bins, y, np.where(y == 1, 1.5, 0.75), rng.integers(0, 5, n).astype(np.int32), rng.integers(-2 ** 62, 2 ** 62, n))
    got = []
    for many in (1, n + 1):
        monkeypatch.setattr(B, "MANY_ROWS", many)
        got.append(B._fit_here(data, spec, 2, [2, spec.rounds]))
    for a, b in zip(got[0][1], got[1][1], strict=True):
        assert (a.feature, a.cut, a.low, a.high) == (b.feature, b.cut, b.low, b.high)
        assert np.allclose(a.value, b.value)
    assert all(np.allclose(got[0][2][r], got[1][2][r]) for r in (2, spec.rounds))


def test_packed_sums():
    """A feature's sums from its joint code are those of its own bins."""
    rng = np.random.default_rng(6)
    bins = np.hstack([rng.integers(0, 3, (500, 8)), rng.integers(0, 200, (500, 1))]).astype(np.uint8)
    data, v = B.Packed(bins), rng.random(500)
    assert len(data.codes) < 9
    parts = [np.arange(0, 500, 3), np.arange(1, 500, 3)]
    got = data.sums(parts, (v,))
    for k, rows in enumerate(parts):
        for f in range(9):
            assert np.allclose(got[0, k, f], np.bincount(bins[rows, f], v[rows], B.BINS + 1))
            assert (got[1, k, f] == np.bincount(bins[rows, f], minlength=B.BINS + 1)).all()


def test_equal_draws_take_the_smallest_key(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 7), ([3.0, 4.0], 7), ([5.0, 6.0], -9)], "x array<double>, row long").coalesce(1)
    a, b = KM._draw(rows, None, [42, 43], 0), KM._draw(rows.orderBy("x"), None, [42, 43], 0)
    assert a.shape == (2, KM.CANDIDATES, 2) and (a == b).all()


def test_lines_of_a_task_stay_bounded():
    from custaris.plans import customer360 as C
    assert C.line_tasks(0) == 1 and C.line_tasks(600_000) == 6
    for n in (36_000_000, 216_000_000, 10 ** 12):
        assert n / C.line_tasks(n) <= C.MOST_LINES_A_TASK


def test_sums_of_runs_together():
    """The sums of all runs of a step are those of each row's nearest centre, the first one on a tie."""
    rng = np.random.default_rng(7)
    x = np.round(4 * rng.normal(size=(700, 3)))      # whole numbers: ties are exact
    todo = {(k, i): x[rng.choice(len(x), k, False)] for k in (2, 5, 3) for i in range(3)}
    todo[5, 1][3] = todo[5, 1][1]       # two equal centres
    todo[2, 0][1] = todo[2, 0][0]
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(np.arange(len(x)))], names=["x", "row"])
    got = KM._sums(todo)(batch)
    for j, ((k, _), at) in enumerate(todo.items()):
        far = ((x[:, None] - at[None]) ** 2).sum(2)
        near = far.argmin(1)
        assert got[j][0] == pytest.approx(far.min(1).sum())
        assert got[j][1:1 + k].tolist() == np.bincount(near, minlength=k).tolist()
        assert np.allclose(got[j][1 + k:].reshape(k, 3), [x[near == c].sum(0) for c in range(k)])


def test_settled_runs_leave_whatever_the_order_of_the_sums(spark, monkeypatch):
    """Sums that differ by rounding from step to step don't keep a settled run in the scan."""
    rng = np.random.default_rng(8)
    rows = [(i, Vectors.dense([float(v) for v in r])) for i, r in enumerate(rng.normal(size=(60, 2)))]
    df, sizes, summed = spark.createDataFrame(rows, ["k", "features"]), [], KM.summed

    def noisy(rows, reduce, size, *block):
        got = summed(rows, reduce, size, *block)
        if block:
            sizes.append(len(got))
            got = {k: v * (1 + 1e-15 * rng.integers(-1, 2, len(v))) for k, v in got.items()}
        return got
    monkeypatch.setattr(KM, "summed", noisy)
    KM.fit_many(df, [2, 8], "k", seeds=(1, 2, 3), tolerance=0.0, max_steps=40)
    assert sizes[-1] < sizes[0] and len(sizes) < 41


def test_packed_rows_are_the_rows(spark):
    """K-Means reads packed blocks: all rows with their keys, whatever the batches."""
    rows = spark.range(0, 5000, 1, 3).selectExpr("array(id * 1.0D, id / 7.0D) AS x", "id * 11 AS row")
    blocks = KM._blocks(rows)
    got = blocks.toArrow().combine_chunks().to_batches()[0]
    x, keys = KM._matrix(got), KM._keys(got)
    assert blocks.count() < 20 and sorted(keys.tolist()) == [11 * i for i in range(5000)]
    assert np.array_equal(x, np.stack([keys / 11.0, keys / 11.0 / 7.0], 1))
    assert np.array_equal(KM._draw(rows, None, [42, 43], 0), KM._draw(blocks, None, [42, 43], 0))


def test_pairs_of_customers_and_parts_are_dealt_like_the_lines(spark, tmp_path, monkeypatch):
    """Distinct parts of the customers: as many tasks as the lines ask for, not as the session's partitions give."""
    from custaris.plans import customer360 as C
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(k, "c", 0, 0.0, "BUILDING") for k in (1, 2, 3)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(k, 1 + k % 2, "O", 1.0, datetime(2024, 1, 1 + k), "1") for k in range(8)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(k % 6, p, 1, 1, 1.0, 10.0, 0.0, 0.0, "N", "O", datetime(2024, 2, 1)) for k in range(24) for p in (k % 5, 7, None)]),
        "events": ("event_id long, ts timestamp, user_id long, event_type string, value double, props string",
                   [(1, datetime(2024, 1, 1), 5, "error", 0.0, "{}")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(C, "LINES_A_TASK", 6)
    got = C.build_customer360(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(ck#\d+L?, l_partkey#\d+L?, 12\)", plan)
    parts = {c: {p for k in range(24) for p in (k % 5, 7) if 1 + k % 6 % 2 == c} for c in (1, 2, 3)}
    assert {r.CustomerID: r.UniqueProducts for r in got.collect()} == {c: len(p) for c, p in parts.items()}


def test_a_step_of_kmeans_is_one_stage(spark):
    """A step reads the packed rows once and moves one vector a task: no shuffle, no second job."""
    rows = spark.range(0, 5000, 1, 3).selectExpr("array(id * 1.0D, id * 2.0D) AS x", "id AS row")
    blocks, sc = KM._blocks(rows).select("x", "n"), spark.sparkContext
    sc.setJobGroup("one-step", "")
    try:
        got = KM.summed(blocks, lambda b: {0: KM._matrix(b).sum(0), 3: np.ones(1)}, 4, 1)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got[0].tolist() == [12_497_500, 24_995_000, 0, 0] and got[3].tolist() == [blocks.count(), 0, 0, 0]
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("one-step")]
    assert [len(j.stageIds) for j in jobs] == [1]


def _star(spark, home):
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(k, "c", 0, 0.0, "BUILDING") for k in range(1, 6)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
                   [(k or None, 1 + k % 4, "O", 1.0, datetime(2024, 1, 1 + k % 28), "1") for k in [*range(40), 3, 3]]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(k % 37 if k % 11 else None, p, 1, 1, float(k), 10.0 * k, 0.1, 0.0, "R", "O", datetime(2024, 2, 1))
                      for k in range(120) for p in (k % 5, 7, None)]),
        "events": ("event_id long, ts timestamp, user_id long, event_type string, value double, props string",
                   [(1, datetime(2024, 1, 1), 5, "error", 0.0, "{}")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{home}/{name}.parquet")


def test_scans_of_large_tables_write_to_few_shares(spark, tmp_path, monkeypatch):
    """No scan of lines or orders is shuffled to more than SHARES tasks at once, and the rows are those of the direct way."""
    from custaris.plans import customer360 as C
    _star(spark, tmp_path)
    monkeypatch.setattr(C, "LINES_A_TASK", 20)
    direct = C.build_customer360(spark, str(tmp_path))
    monkeypatch.setattr(C, "SHARES", 5, raising=False)
    got = C.build_customer360(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    for key, to in (("l_orderkey", "ok"), ("o_orderkey", "order")):
        assert set(re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\)", plan)) == {"5"}
        assert set(re.findall(rf"hashpartitioning\({to}#\d+L?, (\d+)\)", plan)) == {"18"}
    assert sorted(map(str, got.collect())) == sorted(map(str, direct.collect()))
