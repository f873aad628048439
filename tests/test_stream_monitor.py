"""D6 with state: windows go on across batches, late records, labels that arrive later, replayed batches."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from custaris.streaming import monitor as MO

REC = "CustomerID long, at timestamp, x double, y double, s double, Churn int"
LAB = "CustomerID long, Churn int, labelled_at timestamp"
DAY0 = dt.datetime(1970, 1, 1) + dt.timedelta(days=90 * 100)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def files(folder, batches):
    """One file a batch, with rising modification times, so that the source takes them in order."""
    import os
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        p = folder / f"{i:03d}.json"
        p.write_text("\n".join(json.dumps({k: v.isoformat() + "Z" if isinstance(v, dt.datetime) else v for k, v in r.items()}) for r in rows))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def record(i, at, rng, shift=0.0):
    return {"CustomerID": i, "at": at, "x": round(float(rng.normal(shift)), 1), "y": float(rng.integers(0, 5)),
            "s": round(float(rng.random()), 2), "Churn": int(rng.integers(0, 2))}


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def ks(a, b):
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()


def auc(rows):
    pos, neg = [r["s"] for r in rows if r["Churn"] == 1], [r["s"] for r in rows if r["Churn"] == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.fixture
def case(spark, tmp_path):
    rng = np.random.default_rng(5)
    ref = [record(-i, day(-10), rng) for i in range(1, 81)]
    first = [record(i, day(i % 60), rng) for i in range(60)]
    second = [record(100 + i, day(40 + i % 91), rng, 2.0) for i in range(91)]        # two windows; the first closes at day 120
    late_ok = [record(300 + i, day(95), rng, 2.0) for i in range(6)]                 # behind the watermark, window open
    too_late = [record(400 + i, day(3), rng) for i in range(7)]                      # its window is closed
    last = [record(500 + i, day(150), rng) for i in range(20)] + [{**record(600, day(1), rng), "at": None}]
    batches = [first, second, late_ok, last + too_late]
    m = MO.Monitor(home=str(tmp_path / "home"), cols=("x", "y"))
    MO.store_reference(spark.createDataFrame([tuple(r.values()) for r in ref], REC), m, F.col("s"))
    return dict(m=m, ref=ref, batches=batches, counted=first + second + late_ok + last[:-1],
                folder=files(tmp_path / "in", batches), tmp=tmp_path)


def window_of(r):
    return (r["at"] - (r["at"] - dt.datetime(1970, 1, 1)) % dt.timedelta(days=90)).date()


def test_drift_windows_keep_counts_and_late_records(spark, case):
    m = case["m"]
    q = MO.watch_drift(stream(spark, REC, case["folder"]), m)
    q.awaitTermination()
    got = {(r["window"], r["feature"]): r for r in MO.latest(spark, m, "drift", ["window", "feature"]).collect()}
    windows = {window_of(r) for r in case["counted"]}
    assert set(got) == {(w, f) for w in windows for f in ("x", "y")} and len(windows) == 2
    for (w, f), row in got.items():
        cur = [r[f] for r in case["counted"] if window_of(r) == w]
        ref = [r[f] for r in case["ref"]]
        assert row["n_cur"] == len(cur) and row["n_ref"] == len(ref)
        assert row["ks_stat"] == pytest.approx(ks(ref, cur), abs=1e-12)
        assert row["drifted"] == (row["p_value"] < 0.05)
    # every batch has its own rows: the first one saw the first window only, with fewer records
    per = MO.latest(spark, m, "drift", ["window", "feature"]).sparkSession.read.parquet(m.path("drift"))
    n0 = {r["window"]: r["n_cur"] for r in per.where("batch_id = 0 and feature = 'x'").collect()}
    assert n0 == {min(windows): 60}
    top = [r["ks_stat"] for r in MO.drift_of(MO.latest(spark, m, "drift", ["window", "feature"])).collect()]
    assert len(top) >= 1


def test_a_new_file_goes_on_from_the_kept_state_and_a_replay_doubles_nothing(spark, case):
    m = case["m"]
    MO.watch_drift(stream(spark, REC, case["folder"]), m).awaitTermination()
    before = {(r["window"], r["feature"]): r["n_cur"] for r in MO.latest(spark, m, "drift", ["window", "feature"]).collect()}
    rng = np.random.default_rng(9)
    import os
    more = [record(900 + i, day(151), rng) for i in range(5)]
    p = case["tmp"] / "in" / "900.json"
    p.write_text("\n".join(json.dumps({**r, "at": r["at"].isoformat() + "Z"}) for r in more))
    os.utime(p, (1_700_000_900, 1_700_000_900))
    q = MO.watch_drift(stream(spark, REC, case["folder"]), m)
    q.awaitTermination()
    after = {(r["window"], r["feature"]): r["n_cur"] for r in MO.latest(spark, m, "drift", ["window", "feature"]).collect()}
    w = window_of(more[0])
    assert after == {k: v + (5 if k[0] == w else 0) for k, v in before.items()}


def test_labels_join_when_they_arrive(spark, case):
    m = case["m"]
    known = case["counted"]
    # labels of a batch's records come with the next file; some come after the bound and count nowhere
    groups = [[], case["batches"][0], case["batches"][1], case["batches"][3][:20]]
    labels = [[{"CustomerID": r["CustomerID"], "Churn": r["Churn"], "labelled_at": r["at"] + dt.timedelta(
        days=90 if r["CustomerID"] % 10 == 3 else 20)} for r in g] for g in groups]
    folder = files(case["tmp"] / "labels", labels)
    q = MO.watch_auc(stream(spark, REC.replace(", Churn int", ""), case["folder"]), stream(spark, LAB, folder), m, F.col("s"))
    q.awaitTermination()
    removed = sum(o["numRowsRemoved"] for pr in q.recentProgress for o in pr["stateOperators"])
    assert removed > 0                                     # the join's state is released as time goes on
    with_label = {r["CustomerID"] for g in groups for r in g if r["CustomerID"] % 10 != 3}
    got = {r["window"]: r for r in MO.latest(spark, m, "auc", ["window"]).collect()}
    for w in {window_of(r) for r in known}:
        rows = [r for r in known if window_of(r) == w and r["CustomerID"] in with_label]
        assert got[w]["n_pos"] + got[w]["n_neg"] == len(rows)
        assert got[w]["auc_cur"] == pytest.approx(auc(rows), abs=1e-9)
        assert got[w]["auc_ref"] == pytest.approx(auc(case["ref"]), abs=1e-9)
        drop = (got[w]["auc_ref"] - got[w]["auc_cur"]) * 100
        assert got[w]["status"] == ("DEGRADED" if drop > 5 else "STABLE")
