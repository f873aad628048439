"""Registered feature queries (F1-F37) and the full R1 transform parity check."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from ..functions import scalar as SF
from ..functions.numeric import signed_log1p
from ..operators import features as FE
from ..operators import split as E
from .catalog import c360, finish, oracle, register
from .q_split import DUCK_SPLIT

# ------------------------------------------------------------------ DuckDB mirrors of row-local steps
_RX = r"'^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$'"


def duck_octet(ip: str, i: int) -> str:
    return f"TRY_CAST(regexp_extract({ip}, {_RX}, {i}) AS INTEGER)"


# fixed values: networks that the ipaddress module counts as private, and the addresses inside that it doesn't
PRIVATE_NETWORKS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
                    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PUBLIC_INSIDE = ("192.0.0.9", "192.0.0.10")


def duck_is_private(ip: str) -> str:
    a, b, c, d = (duck_octet(ip, i) for i in range(1, 5))
    valid = f"({a} IS NOT NULL AND {a} <= 255 AND {b} <= 255 AND {c} <= 255 AND {d} <= 255)"
    number = f"({a}::BIGINT * 16777216 + {b} * 65536 + {c} * 256 + {d})"
    inside = " OR ".join(f"{number} BETWEEN {int(n[0])} AND {int(n[-1])}" for n in map(ipaddress.ip_network, PRIVATE_NETWORKS))
    priv = f"(({inside}) AND {number} NOT IN ({', '.join(str(int(ipaddress.ip_address(x))) for x in PUBLIC_INSIDE)}))"
    low = f"lower(trim({ip}))"
    v6 = f"(regexp_matches({low}, '^[0-9a-f:]+$') AND contains({low}, ':'))"
    v6p = (f"({low} IN ('::', '::1') OR regexp_matches({low}, '^2001:0?db8:') OR regexp_matches({low}, '^fe[89ab][0-9a-f]:') "
           f"OR regexp_matches({low}, '^f[cd][0-9a-f]{{2}}:'))")
    return (f"(CASE WHEN {valid} THEN (CASE WHEN {priv} THEN 1 ELSE 0 END) "
            f"WHEN {v6} THEN (CASE WHEN {v6p} THEN 1 ELSE 0 END) ELSE -1 END)")


def duck_ip_class(ip: str) -> str:
    f = f"TRY_CAST(split_part({ip}, '.', 1) AS INTEGER)"
    return (f"(CASE WHEN {f} BETWEEN 1 AND 126 THEN 1 WHEN {f} BETWEEN 128 AND 191 THEN 2 "
            f"WHEN {f} BETWEEN 192 AND 223 THEN 3 ELSE 0 END)")


DUCK_TS = ("coalesce(try_strptime(RegistrationDate, '%Y-%m-%d'), try_strptime(RegistrationDate, '%m/%d/%Y'), "
           "try_strptime(RegistrationDate, '%d/%m/%Y'))")
_AGE_MAP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SF.AGE_CATEGORY_ORDER.items())
_TOD_MAP = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SF.TIME_OF_DAY_ORDER.items())

KEPT_NUMERIC = ["Frequency", "MonetaryTotal", "MonetaryAvg", "MonetaryMax", "AvgQuantityPerTransaction",
                "CustomerTenureDays", "PreferredDayOfWeek", "PreferredHour", "WeekendPurchaseRatio",
                "AvgDaysBetweenPurchases", "UniqueProducts", "UniqueCountries", "AvgProductsPerTransaction",
                "ZeroPriceCount", "CancelledTransactions", "ReturnRatio", "Age"]
ONEHOT_SOURCES = ["Region", "WeekendPreference", "ProductDiversity", "Gender", "AccountStatus"]

BASE_CLEAN_CTE = f"""
_ts AS (SELECT *, {DUCK_TS} AS _ts, {DUCK_SPLIT} AS split FROM c360),
_bc AS (
  SELECT CustomerID, Churn, split, Country, {', '.join(KEPT_NUMERIC)}, {', '.join(ONEHOT_SOURCES)},
         year(_ts) AS RegYear, month(_ts) AS RegMonth, day(_ts) AS RegDay, isodow(_ts) - 1 AS RegWeekday,
         CASE WHEN {duck_is_private('LastLoginIP')} = -1 THEN NULL ELSE {duck_is_private('LastLoginIP')} END AS IsPrivateIP,
         {duck_ip_class('LastLoginIP')} AS IPClass,
         CASE WHEN SupportTicketsCount IN (-1, 999) THEN NULL ELSE SupportTicketsCount END AS SupportTicketsCount,
         CAST(CASE AgeCategory {_AGE_MAP} END AS DOUBLE) AS AgeCategory,
         CAST(CASE PreferredTimeOfDay {_TOD_MAP} END AS DOUBLE) AS PreferredTimeOfDay
  FROM _ts)"""


def with_split(spark, sf):
    return E.hash_split(c360(spark, sf), "CustomerID")


# ------------------------------------------------------------------ F1 / F2 / F3 / F5 / F6
@register("f01_registration_date_parts", oracle(f"""
SELECT CustomerID, CAST(year({DUCK_TS}) AS INTEGER) AS RegYear, CAST(month({DUCK_TS}) AS INTEGER) AS RegMonth,
       CAST(day({DUCK_TS}) AS INTEGER) AS RegDay, CAST(isodow({DUCK_TS}) - 1 AS INTEGER) AS RegWeekday FROM c360"""))
def f01(spark, sf):
    df = c360(spark, sf)
    ts = SF.parse_mixed_date(F.col("RegistrationDate"))
    return df.select("CustomerID", *SF.date_parts(ts))


@register("f02_f03_ip_features", oracle(f"""
SELECT CustomerID, LastLoginIP, {duck_is_private('LastLoginIP')} AS IsPrivateIP, {duck_ip_class('LastLoginIP')} AS IPClass
FROM c360"""))
def f02(spark, sf):
    ip = F.col("LastLoginIP")
    return c360(spark, sf).select("CustomerID", "LastLoginIP", SF.is_private_ip(ip).alias("IsPrivateIP"),
                                  SF.ip_class(ip).alias("IPClass"))


@register("f05_f06_sentinels_ordinals", oracle(f"""
SELECT CustomerID, CASE WHEN SupportTicketsCount IN (-1, 999) THEN NULL ELSE SupportTicketsCount END AS SupportTicketsCount,
       CAST(CASE AgeCategory {_AGE_MAP} END AS DOUBLE) AS AgeCategory,
       CAST(CASE PreferredTimeOfDay {_TOD_MAP} END AS DOUBLE) AS PreferredTimeOfDay FROM c360"""))
def f05(spark, sf):
    df = c360(spark, sf)
    return df.select("CustomerID",
                     SF.null_sentinels(F.col("SupportTicketsCount"), SF.TICKET_SENTINELS).alias("SupportTicketsCount"),
                     SF.ordinal(F.col("AgeCategory"), SF.AGE_CATEGORY_ORDER).cast("double").alias("AgeCategory"),
                     SF.ordinal(F.col("PreferredTimeOfDay"), SF.TIME_OF_DAY_ORDER).cast("double")
                     .alias("PreferredTimeOfDay"))


_SCORING_CASES = ", ".join(
    f"coalesce(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" END, {d}) AS {c}"
    for c, (m, d) in SF.SCORING_ORDINALS.items())


@register("f06_scoring_ordinals", oracle(f"SELECT CustomerID, {_SCORING_CASES} FROM c360"))
def f06s(spark, sf):
    """F6 when scoring: unknown categories take their defaults instead of null."""
    return SF.scoring_ordinals(c360(spark, sf).select("CustomerID", *SF.SCORING_ORDINALS))


@register("f17_legacy_disengagement", oracle("""
SELECT CustomerID, ReturnRatio + CAST(CancelledTransactions AS DOUBLE) / 10 AS DisengagementScore FROM c360""",
    "DisengagementScore"))
def f17l(spark, sf):
    return finish(FE.legacy_disengagement(c360(spark, sf)).select("CustomerID", "DisengagementScore"))


@register("f33_money_text", oracle("""
SELECT CustomerID, '£' || format('{:,}', CAST(round_even(MonetaryTotal, 0) AS BIGINT)) AS monetary_text FROM c360"""))
def f33m(spark, sf):
    return c360(spark, sf).select("CustomerID", SF.money(F.col("MonetaryTotal")).alias("monetary_text"))


# ------------------------------------------------------------------ F7 one-hot (long form: columns depend on data)
_ONEHOT_CTES = f"""{BASE_CLEAN_CTE},
_src AS (UNPIVOT (SELECT CustomerID, {', '.join(ONEHOT_SOURCES)} FROM _bc) ON {', '.join(ONEHOT_SOURCES)}
         INTO NAME f VALUE v),
_cats AS (SELECT f, v FROM (SELECT DISTINCT f, v FROM _src) c
          WHERE v > (SELECT min(v) FROM _src s WHERE s.f = c.f)),
_onehot AS (SELECT b.CustomerID, c.f || '_' || c.v AS feature,
                   CASE WHEN s.v = c.v THEN 1 ELSE 0 END AS value
            FROM _bc b CROSS JOIN _cats c LEFT JOIN _src s ON s.CustomerID = b.CustomerID AND s.f = c.f)"""


@register("f07_one_hot_long", oracle("SELECT CustomerID, feature, value FROM _onehot", extra_ctes=_ONEHOT_CTES))
def f07(spark, sf):
    a = FE.base_clean(c360(spark, sf))
    cats = FE.fit_categories(a, ONEHOT_SOURCES)
    x = FE.one_hot(a, cats)
    names = [FE.onehot_name(c, v) for c, vals in cats.items() for v in vals]
    return x.select("CustomerID", *names).unpivot(["CustomerID"], names, "feature", "value")


# ------------------------------------------------------------------ F9 target encoding
_TE_CTES = f"""{BASE_CLEAN_CTE},
_g AS (SELECT avg(CAST(Churn AS DOUBLE)) AS g FROM _bc WHERE split = 'train'),
_te AS (SELECT Country, (count(*) * avg(CAST(Churn AS DOUBLE)) + 10.0 * (SELECT g FROM _g)) / (count(*) + 10.0)
               AS Country_TargetEnc FROM _bc WHERE split = 'train' AND Country IS NOT NULL GROUP BY Country)"""


@register("f09_target_encoding", oracle("SELECT * FROM _te", "Country_TargetEnc", extra_ctes=_TE_CTES))
def f09(spark, sf):
    df = with_split(spark, sf)
    return finish(FE.target_encoding(df.where(F.col("split") == "train"), "Country", "Churn"))


# ------------------------------------------------------------------ F10-F18 fitted statistics
def _duck_stats_sql():
    meds = " UNION ALL ".join(
        f"SELECT 'median:{c}' AS stat, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS value FROM _bc WHERE split = 'train'"
        for c in FE.MEDIAN_FILL)
    return f"""{meds}
UNION ALL SELECT 'mode:IsPrivateIP', CAST(arg_min(IsPrivateIP, (-n, IsPrivateIP)) AS DOUBLE) FROM (
    SELECT IsPrivateIP, count(*) AS n FROM _bc WHERE split = 'train' AND IsPrivateIP IS NOT NULL GROUP BY IsPrivateIP)
UNION ALL SELECT 'mean:ReturnRatio', avg(ReturnRatio) FROM _bc WHERE split = 'train'
UNION ALL SELECT 'std:ReturnRatio', stddev_samp(ReturnRatio) + 1e-8 FROM _bc WHERE split = 'train'
UNION ALL SELECT 'mean:CancelledTransactions', avg(CAST(CancelledTransactions AS DOUBLE)) FROM _bc WHERE split = 'train'
UNION ALL SELECT 'std:CancelledTransactions', stddev_samp(CAST(CancelledTransactions AS DOUBLE)) + 1e-8 FROM _bc WHERE split = 'train'
UNION ALL SELECT 'mean:MonetaryTotal', avg(MonetaryTotal) FROM _bc WHERE split = 'train'"""


@register("f11_f18_fitted_statistics", oracle(_duck_stats_sql(), "value", extra_ctes=BASE_CLEAN_CTE))
def f11(spark, sf):
    df = with_split(spark, sf)
    prep = FE.fit_prep(df, F.col("split") == "train", passthrough=["split"])
    rows = [(f"median:{k}", v) for k, v in prep.medians.items()]
    rows += [("mode:IsPrivateIP", prep.ip_mode), ("mean:ReturnRatio", prep.rr_mean), ("std:ReturnRatio", prep.rr_std),
             ("mean:CancelledTransactions", prep.ct_mean), ("std:CancelledTransactions", prep.ct_std),
             ("mean:MonetaryTotal", prep.revenue_mean)]
    # the statistics were computed by Spark aggregations; this frame only lists them
    return finish(spark.createDataFrame(rows, "stat string, value double"))


# ------------------------------------------------------------------ F15-F20 engineered + signed log (row level)
@register("f15_f20_engineered_log", oracle("""
SELECT CustomerID,
       sign(MonetaryTotal / (Frequency + 1)) * ln(1 + abs(MonetaryTotal / (Frequency + 1))) AS AvgBasketValue_log,
       sign(Frequency / (CustomerTenureDays + 1)) * ln(1 + abs(Frequency / (CustomerTenureDays + 1))) AS EngagementScore_log,
       sign(MonetaryMin) * ln(1 + abs(MonetaryMin)) AS MonetaryMin_log
FROM c360""", "AvgBasketValue_log EngagementScore_log MonetaryMin_log"))
def f15(spark, sf):
    df = c360(spark, sf)
    m, f = F.col("MonetaryTotal"), F.col("Frequency").cast("double")
    return finish(df.select(
        "CustomerID",
        signed_log1p(m / (f + 1)).alias("AvgBasketValue_log"),
        signed_log1p(f / (F.col("CustomerTenureDays").cast("double") + 1)).alias("EngagementScore_log"),
        signed_log1p(F.col("MonetaryMin")).alias("MonetaryMin_log")))


# ------------------------------------------------------------------ R1: the full fitted transform (long form)
def _r1_sql():
    eng_src = KEPT_NUMERIC + ["RegYear", "RegMonth", "RegDay", "RegWeekday", "IsPrivateIP", "IPClass",
                              "AgeCategory", "PreferredTimeOfDay", "SupportTicketsCount"]
    med = {c: f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM _bc WHERE split = 'train')" for c in FE.MEDIAN_FILL}
    ipmode = ("(SELECT CAST(arg_min(IsPrivateIP, (-n, IsPrivateIP)) AS DOUBLE) FROM (SELECT IsPrivateIP, count(*) AS n "
              "FROM _bc WHERE split = 'train' AND IsPrivateIP IS NOT NULL GROUP BY IsPrivateIP))")
    fills = []
    for c in eng_src:
        if c in med:
            fills.append(f"coalesce(CAST({c} AS DOUBLE), {med[c]}) AS {c}")
        elif c == "AvgDaysBetweenPurchases":
            fills.append("coalesce(AvgDaysBetweenPurchases, 0.0) AS AvgDaysBetweenPurchases")
        elif c == "IsPrivateIP":
            fills.append(f"coalesce(CAST(IsPrivateIP AS DOUBLE), {ipmode}) AS IsPrivateIP")
        else:
            fills.append(c)
    st = "(SELECT {} FROM _bc WHERE split = 'train')"
    rr_m, rr_s = st.format("avg(ReturnRatio)"), st.format("stddev_samp(ReturnRatio) + 1e-8")
    ct_m = st.format("avg(CAST(CancelledTransactions AS DOUBLE))")
    ct_s = st.format("stddev_samp(CAST(CancelledTransactions AS DOUBLE)) + 1e-8")
    rev_m = st.format("avg(MonetaryTotal)")
    logc = set(FE.LOG_COLUMNS)
    wide = KEPT_NUMERIC + ["RegYear", "RegMonth", "RegDay", "RegWeekday", "IsPrivateIP", "IPClass",
                           "AgeCategory", "PreferredTimeOfDay", "SupportTicketsCount", "Country_TargetEnc",
                           "Age_IsMissing", "AvgBasketValue", "EngagementScore", "DisengagementScore", "RevenueIndex"]
    wide = list(dict.fromkeys(wide))

    def lg(c):
        v = f"CAST({c} AS DOUBLE)"
        return f"sign({v}) * ln(1 + abs({v}))" if c in logc else v
    return f"""{_TE_CTES.replace(BASE_CLEAN_CTE, _ONEHOT_CTES)},
_imp AS (SELECT CustomerID, split, CAST(Age IS NULL AS INTEGER) AS Age_IsMissing,
                coalesce(t.Country_TargetEnc, (SELECT g FROM _g)) AS Country_TargetEnc, {', '.join(fills)}
         FROM _bc b LEFT JOIN _te t ON b.Country = t.Country),
_eng AS (SELECT *, MonetaryTotal / (Frequency + 1) AS AvgBasketValue,
                CAST(Frequency AS DOUBLE) / (CAST(CustomerTenureDays AS DOUBLE) + 1) AS EngagementScore,
                (ReturnRatio - {rr_m}) / {rr_s} + (CAST(CancelledTransactions AS DOUBLE) - {ct_m}) / {ct_s} AS DisengagementScore,
                MonetaryTotal / ({rev_m} + 1) AS RevenueIndex FROM _imp),
_long AS (SELECT CustomerID, split, feature, value FROM
            (SELECT CustomerID, split, {', '.join(f'{lg(c)} AS {c}' for c in wide)} FROM _eng)
            UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(wide)}))
          UNION ALL SELECT o.CustomerID, b.split, o.feature, CAST(o.value AS DOUBLE) FROM _onehot o JOIN _bc b USING (CustomerID)),
_net AS (SELECT feature, coalesce(quantile_cont(value, 0.5), 0.0) AS med FROM _long WHERE split = 'train' GROUP BY feature),
_filled AS (SELECT l.CustomerID, l.split, l.feature, coalesce(l.value, n.med) AS value FROM _long l JOIN _net n USING (feature)),
_sc AS (SELECT feature, CASE WHEN stddev_pop(value) > 0 THEN avg(value) ELSE min(value) END AS m, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS s
        FROM _filled WHERE split = 'train' GROUP BY feature)"""


@register("r01_preprocess_long", oracle(
    "SELECT f.CustomerID, f.split, f.feature, (f.value - s.m) / s.s AS value FROM _filled f JOIN _sc s USING (feature)",
    "value", extra_ctes=_r1_sql()))
def r01(spark, sf):
    """Fit on the training split, transform every row; long (key, split, feature, value)."""
    df = with_split(spark, sf)
    prep = FE.fit_prep(df, F.col("split") == "train", passthrough=["split"])
    out = prep.transform(df, keep=["split"])
    return finish(out.unpivot(["CustomerID", "split"], prep.features, "feature", "value"))


# ------------------------------------------------------------------ F19 legacy ratios, F36 no-null check
@register("f19_legacy_ratios", oracle("""
SELECT CustomerID, MonetaryTotal / (Recency + 1) AS MonetaryPerDay,
       CAST(Recency AS DOUBLE) / (CustomerTenureDays + 1) AS TenureRatio FROM c360""",
    "MonetaryPerDay TenureRatio"))
def f19(spark, sf):
    """F19 (legacy variant): MonetaryPerDay = total/(Recency+1); TenureRatio = Recency/(Tenure+1)."""
    df = c360(spark, sf)
    return finish(df.select("CustomerID",
                            (F.col("MonetaryTotal") / (F.col("Recency") + 1)).alias("MonetaryPerDay"),
                            (F.col("Recency").cast("double") / (F.col("CustomerTenureDays") + 1)).alias("TenureRatio")))


@register("f36_no_null_check")
def f36(spark, sf):
    """one-pass null count over the model matrix (must be 0 before training)."""
    df = with_split(spark, sf)
    prep = FE.fit_prep(df, F.col("split") == "train", passthrough=["split"])
    x = prep.transform(df)
    return x.agg(F.count("*").cast("long").alias("n_rows"),
                 sum(F.count_if(F.col(c).isNull()) for c in prep.features).cast("long").alias("n_nulls")) \
        .withColumn("ok", F.col("n_nulls") == 0)
