"""Literal edge-case rows (FIXTURES.md section 5) for the scalar functions."""

import math

from pyspark.sql import functions as F

from custaris.functions import scalar as SF
from custaris.functions.numeric import signed_log1p


def test_mixed_dates(spark):
    df = spark.createDataFrame([("12/09/2009",), ("2010-10-04",), ("18/10/2010",), ("bad",)], "d string")
    ts = SF.parse_mixed_date(F.col("d"))
    rows = df.select(*SF.date_parts(ts)).collect()
    assert tuple(rows[0]) == (2009, 12, 9, 2)
    assert tuple(rows[1]) == (2010, 10, 4, 0)
    assert tuple(rows[2]) == (2010, 10, 18, 0)
    assert tuple(rows[3]) == (None, None, None, None)


def test_ip_flags_and_class(spark):
    ips = ["10.0.0.1", "172.16.0.1", "192.168.1.1", "85.244.30.10", "127.0.0.1", "224.0.0.1", "x", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    rows = df.select(SF.is_private_ip(F.col("ip")).alias("p"), SF.ip_class(F.col("ip")).alias("c")).collect()
    got = [(r["p"], r["c"]) for r in rows]
    assert got[0] == (1, 1) and got[1] == (1, 2) and got[2] == (1, 3)
    assert got[3] == (0, 1)
    assert got[4] == (1, 0)
    assert got[5][1] == 0
    assert got[6] == (-1, 0) and got[7] == (-1, 0)


def test_signed_log(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (math.e - 1,)], "x double")
    v = [r[0] for r in df.select(signed_log1p(F.col("x"))).collect()]
    assert abs(v[0] + 0.693147) < 1e-6 and v[1] == 0 and abs(v[2] - 1) < 1e-12


def test_risk_bands_left_closed(spark):
    df = spark.createDataFrame([(0.2499,), (0.25,), (0.5,), (0.75,)], "p double")
    got = [r[0] for r in df.select(SF.risk_band(F.col("p"))).collect()]
    assert got == ["Faible", "Moyen", "Élevé", "Critique"]


def test_ordinal_unknown_is_null(spark):
    df = spark.createDataFrame([("18-24",), ("Inconnu",), (None,)], "a string")
    got = [r[0] for r in df.select(SF.ordinal(F.col("a"), SF.AGE_CATEGORY_ORDER)).collect()]
    assert got == [0, None, None]


def test_season(spark):
    df = spark.createDataFrame([(m,) for m in [1, 4, 7, 10, 12]], "m int")
    got = [r[0] for r in df.select(SF.month_to_season(F.col("m"))).collect()]
    assert got == ["Hiver", "Printemps", "Été", "Automne", "Hiver"]
