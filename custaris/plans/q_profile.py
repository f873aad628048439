"""Registered profiling queries (P1-P30) over the customer-360 table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as SF
from ..functions.numeric import fix_sql, sig_col, sig_sql
from ..operators import density as KD
from ..operators import profile as P
from ..operators import ranks as R
from .catalog import c360, finish, oracle, register
from .sqlfrag import corr_sql, pairs_sql
from .customer360 import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from .standin import month_to_season as season_sql

NUM = NUMERIC_FEATURES
CAT = CATEGORICAL_FEATURES
ALL_COLS = ["CustomerID", "Country", "Region", "Recency", "Frequency", "TotalTransactions", "UniqueInvoices",
            "MonetaryTotal", "MonetaryAvg", "MonetaryStd", "MonetaryMin", "MonetaryMax", "TotalQuantity",
            "MinQuantity", "MaxQuantity", "AvgQuantityPerTransaction", "CustomerTenureDays",
            "FirstPurchaseDaysAgo", "PreferredDayOfWeek", "PreferredHour", "PreferredMonth",
            "WeekendPurchaseRatio", "AvgDaysBetweenPurchases", "UniqueProducts", "UniqueCountries",
            "AvgLinesPerInvoice", "AvgProductsPerTransaction", "NegativeQuantityCount", "ZeroPriceCount",
            "CancelledTransactions", "ReturnRatio", "Age", "SupportTicketsCount", "SatisfactionScore",
            "NewsletterSubscribed", "RegistrationDate", "LastLoginIP", "WeekendPreference",
            "ProductDiversity", "Gender", "AccountStatus", "AgeCategory", "PreferredTimeOfDay",
            "SpendingCategory", "BasketSizeCategory", "FavoriteSeason", "CustomerType",
            "ChurnRiskCategory", "Churn"]
BOX_FEATURES = NUMERIC_FEATURES


def duck_long(cols, ids=(), typ="DOUBLE") -> str:
    """DuckDB long form of c360 (nulls dropped, as every consumer ignores them)."""
    sel = ", ".join([*ids, *[f"CAST({c} AS {typ}) AS {c}" for c in cols]])
    return f"(UNPIVOT (SELECT {sel} FROM c360) ON {', '.join(cols)} INTO NAME feature VALUE value)"


# ---------------------------------------------------------------- P1 shape
@register("p01_shape", oracle(
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(49 AS BIGINT) AS n_columns, CAST(33 AS BIGINT) AS n_numeric, "
    "CAST(16 AS BIGINT) AS n_string, CAST(0 AS BIGINT) AS n_other FROM c360"))
def p01(spark, sf):
    return P.shape_summary(c360(spark, sf))


# ---------------------------------------------------------------- P2 describe
@register("p02_describe_numeric", oracle(f"""
SELECT feature, CAST(count(value) AS BIGINT) AS count, avg(value) AS mean, stddev_samp(value) AS std,
       min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25,
       quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
FROM {duck_long(NUM)} GROUP BY feature""", "mean std min max q25 q50 q75"))
def p02(spark, sf):
    return finish(P.describe_numeric(c360(spark, sf), NUM))


@register("p02_describe_strings", oracle(f"""
SELECT feature, CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS "unique",
       arg_min(value, (-n, value)) AS top, CAST(max(n) AS BIGINT) AS freq
FROM (SELECT feature, value, count(*) AS n FROM {duck_long(CAT, typ='VARCHAR')} GROUP BY feature, value)
GROUP BY feature"""))
def p02s(spark, sf):
    return P.describe_strings(c360(spark, sf), CAT)


# ---------------------------------------------------------------- P3 missing
def _missing_sql():
    parts = [f"SELECT '{c}' AS feature, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, "
             f"CAST(count_if({c} IS NULL) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE) AS pct_missing FROM c360"
             for c in ALL_COLS]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_missing > 0"


@register("p03_missing_report", oracle(_missing_sql(), "pct_missing"))
def p03(spark, sf):
    return finish(P.missing_report(c360(spark, sf)))


# ---------------------------------------------------------------- P4 duplicates
@register("p04_duplicate_rows", oracle("""
SELECT (SELECT CAST(count(*) - count(DISTINCT c360) AS BIGINT) FROM c360) AS n_duplicates_full,
       (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (
            SELECT count(*) AS n FROM c360 GROUP BY Country, Region, Gender, AccountStatus, AgeCategory)) AS n_duplicates_categorical"""))
def p04(spark, sf):
    df = c360(spark, sf)
    full = P.duplicate_rows(df).withColumnRenamed("n_duplicates", "n_duplicates_full")
    cat = P.duplicate_rows(df.select("Country", "Region", "Gender", "AccountStatus", "AgeCategory")) \
        .withColumnRenamed("n_duplicates", "n_duplicates_categorical")
    return full.withColumn("n_duplicates_categorical", cat.scalar())


# ---------------------------------------------------------------- P5 value counts
@register("p05_value_counts_country", oracle("""
SELECT Country AS value, count(*) AS n,
       count(*) / (SELECT count(*) FROM c360 WHERE Country IS NOT NULL) AS share
FROM c360 WHERE Country IS NOT NULL GROUP BY Country""", "share"))
def p05(spark, sf):
    return finish(P.value_counts(c360(spark, sf), "Country"))


# ---------------------------------------------------------------- P6 class balance
@register("p06_class_balance", oracle("""
SELECT CAST(count_if(Churn = 0) AS BIGINT) AS n_neg, CAST(count_if(Churn = 1) AS BIGINT) AS n_pos,
       avg(CAST(Churn AS DOUBLE)) AS pos_rate,
       CAST(greatest(count_if(Churn = 0), count_if(Churn = 1)) AS DOUBLE)
         / CAST(least(count_if(Churn = 0), count_if(Churn = 1)) AS DOUBLE) AS imbalance_ratio,
       CAST(count_if(Churn = 1) AS DOUBLE) / CAST(count_if(Churn = 0) AS DOUBLE) AS pos_neg_ratio
FROM c360""", "pos_rate imbalance_ratio pos_neg_ratio"))
def p06(spark, sf):
    return finish(P.class_balance(c360(spark, sf), "Churn"))


# ---------------------------------------------------------------- P7 quality report
def _quality_sql():
    miss = " UNION ALL ".join(
        f"SELECT 'missing:{c}' AS metric, CAST(count_if({c} IS NULL) AS DOUBLE) AS value FROM c360" for c in ALL_COLS)
    tot = " + ".join(f"count_if({c} IS NULL)" for c in ALL_COLS)
    return f"""
SELECT 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c360
UNION ALL SELECT 'n_columns', 49.0 UNION ALL SELECT 'n_numeric', 33.0
UNION ALL SELECT 'n_string', 16.0 UNION ALL SELECT 'n_other', 0.0
UNION ALL SELECT * FROM ({miss}) WHERE value > 0
UNION ALL SELECT 'missing:total', CAST({tot} AS DOUBLE) FROM c360"""


@register("p07_quality_report", oracle(_quality_sql(), "value"))
def p07(spark, sf):
    return finish(P.quality_report(c360(spark, sf)))


# ---------------------------------------------------------------- P8 distinct counts
def _distinct_sql():
    parts = [f"SELECT '{c}' AS feature, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM c360" for c in ALL_COLS]
    return "SELECT feature, n_distinct, n_distinct <= 20 AS low_cardinality FROM (" + " UNION ALL ".join(parts) + ")"


@register("p08_distinct_counts", oracle(_distinct_sql()))
def p08(spark, sf):
    return P.distinct_counts(c360(spark, sf), ALL_COLS)


# ---------------------------------------------------------------- P9 group means
@register("p09_group_means", oracle(f"""
SELECT Churn, feature, avg(value) AS mean FROM {duck_long(NUM, ['Churn'])} GROUP BY Churn, feature""", "mean"))
def p09(spark, sf):
    return finish(P.group_means(c360(spark, sf), "Churn", NUM))


# ---------------------------------------------------------------- P10 / P11 target rate per category
@register("p10_target_rate_by_category", oracle(f"""
SELECT feature, value, avg(CAST(Churn AS DOUBLE)) AS rate, count(*) AS n,
       avg(CAST(Churn AS DOUBLE)) > (SELECT avg(CAST(Churn AS DOUBLE)) FROM c360) AS above_global
FROM {duck_long(CAT, ['Churn'], 'VARCHAR')} GROUP BY feature, value""", "rate"))
def p10(spark, sf):
    return finish(P.target_rate_by_category(c360(spark, sf), "Churn", CAT))


@register("p11_country_rate_topk", oracle("""
SELECT Country, avg(CAST(Churn AS DOUBLE)) AS rate, count(*) AS n FROM c360
GROUP BY Country HAVING count(*) >= 10 ORDER BY rate DESC, Country LIMIT 20""", "rate"))
def p11(spark, sf):
    return finish(P.top_rate_categories(c360(spark, sf), "Churn", "Country", 10, 20))


# ---------------------------------------------------------------- P12 missingness vs target
def _missing_corr_sql():
    parts = [f"SELECT '{c}' AS feature, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, "
             f"{corr_sql(f'CAST({c} IS NULL AS INTEGER)', 'Churn')} AS r FROM c360" for c in ALL_COLS]
    return "SELECT feature, n_missing, r, abs(r) > 0.05 AS flag FROM (" + " UNION ALL ".join(parts) + \
        ") WHERE n_missing > 0"


@register("p12_missing_target_corr", oracle(_missing_corr_sql(), "r"))
def p12(spark, sf):
    return finish(P.missing_target_corr(c360(spark, sf), "Churn", ALL_COLS))


# ---------------------------------------------------------------- P13 IQR outliers
@register("p13_iqr_outliers", oracle(f"""
WITH q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                  {fix_sql('skewness(value)')} AS skew FROM {duck_long(NUM)} GROUP BY feature),
     f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT f.feature, q1, q3, iqr, lower, upper,
       CAST(count_if(l.value < lower OR l.value > upper) AS BIGINT) AS n_outliers, skew,
       CAST(count_if(l.value < lower OR l.value > upper) AS BIGINT) * 100.0 / (SELECT count(*) FROM c360) AS pct_outliers,
       abs(skew) > 1 AS log_candidate
FROM {duck_long(NUM)} l JOIN f ON l.feature = f.feature
GROUP BY f.feature, q1, q3, iqr, lower, upper, skew""", "q1 q3 iqr lower upper skew pct_outliers"))
def p13(spark, sf):
    return finish(P.iqr_outliers(c360(spark, sf), NUM))


# ---------------------------------------------------------------- P14 skewness
@register("p14_skewness", oracle(f"""
SELECT feature, {fix_sql('skewness(value)')} AS skew, abs({fix_sql('skewness(value)')}) > 1 AS log_candidate
FROM {duck_long(NUM)} GROUP BY feature""", "skew"))
def p14(spark, sf):
    return finish(P.skewness_table(c360(spark, sf), NUM))


# ---------------------------------------------------------------- P15 rate by registration date part
_DUCK_DATE = ("coalesce(try_strptime(RegistrationDate, '%Y-%m-%d'), try_strptime(RegistrationDate, '%m/%d/%Y'), "
              "try_strptime(RegistrationDate, '%d/%m/%Y'))")


@register("p15_rate_by_registration_part", oracle(f"""
WITH d AS (SELECT CAST(Churn AS DOUBLE) AS y, {_DUCK_DATE} AS ts FROM c360),
     p AS (SELECT 'year' AS part, year(ts) AS value, y FROM d UNION ALL
           SELECT 'month', month(ts), y FROM d UNION ALL
           SELECT 'weekday', isodow(ts) - 1, y FROM d)
SELECT part, CAST(value AS INTEGER) AS value, avg(y) AS rate, count(*) AS n FROM p WHERE value IS NOT NULL
GROUP BY part, value""", "rate"))
def p15(spark, sf):
    df = c360(spark, sf).withColumn("reg_ts", SF.parse_mixed_date(F.col("RegistrationDate")))
    return finish(P.rate_by_date_part(df, "Churn", "reg_ts"))


# ---------------------------------------------------------------- P17 box stats
@register("p17_box_stats_by_class", oracle(f"""
WITH q AS (SELECT Churn, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM {duck_long(BOX_FEATURES, ['Churn'])} GROUP BY Churn, feature),
     f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT f.Churn, f.feature, q1, median, q3,
       min(CASE WHEN value >= lo_fence AND value <= hi_fence THEN value END) AS whisker_lo,
       max(CASE WHEN value >= lo_fence AND value <= hi_fence THEN value END) AS whisker_hi,
       CAST(count_if(NOT (value >= lo_fence AND value <= hi_fence)) AS BIGINT) AS n_fliers
FROM {duck_long(BOX_FEATURES, ['Churn'])} l JOIN f ON l.Churn = f.Churn AND l.feature = f.feature
GROUP BY f.Churn, f.feature, q1, median, q3""", "q1 median q3 whisker_lo whisker_hi"))
def p17(spark, sf):
    return finish(P.box_stats(c360(spark, sf), BOX_FEATURES, "Churn"))


# ---------------------------------------------------------------- P18 histogram
@register("p18_histogram_monetary", oracle("""
WITH b AS (SELECT min(MonetaryTotal) AS lo, max(MonetaryTotal) AS hi, (max(MonetaryTotal) - min(MonetaryTotal)) / 10 AS w FROM c360),
     t AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((MonetaryTotal - lo) / w), 9) END AS INTEGER) AS bin, lo, w
           FROM c360, b WHERE MonetaryTotal IS NOT NULL)
SELECT bin, lo + bin * w AS "left", lo + (bin + 1) * w AS "right", CAST(count(*) AS BIGINT) AS n
FROM t GROUP BY bin, lo, w""", "left right"))
def p18(spark, sf):
    return finish(P.histogram(c360(spark, sf), "MonetaryTotal", 10))


# ---------------------------------------------------------------- P19 scatter sample
_SCATTER = ["MonetaryTotal", "Frequency", "Recency", "CustomerTenureDays", "ReturnRatio"]


@register("p19_scatter_sample", oracle(f"""
SELECT CustomerID, Churn, {', '.join(_SCATTER)} FROM c360""", "MonetaryTotal ReturnRatio"))
def p19(spark, sf):
    """Scatter points of all customers."""
    return finish(c360(spark, sf).select("CustomerID", "Churn", *_SCATTER))


# ---------------------------------------------------------------- P16 density
_DENSE = ["MonetaryTotal", "Frequency", "Recency", "CustomerTenureDays", "ReturnRatio", "UniqueProducts"]


@register("p16_kernel_density", oracle(KD.density_sql(_DENSE, "Churn", 1000), "x"))
def p16(spark, sf):
    """Kernel density of features per class on 1,000 grid points, in units of one over the range (6 digits)."""
    d = KD.kernel_density(c360(spark, sf), _DENSE, "Churn")
    return d.select("feature", "Churn", "point", sig_col(F.col("x")).alias("x"),
                    F.bround(F.col("density") * F.col("range"), 6).alias("scaled_density"), "n")


# ---------------------------------------------------------------- P20 qcut
@register("p20_qcut_rate_monetary", oracle("""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(MonetaryTotal, [0, 0.25, 0.5, 0.75, 1]))) AS edges FROM c360),
     t AS (SELECT CAST(Churn AS DOUBLE) AS y, greatest(1, len(list_filter(edges, lambda b: b < MonetaryTotal))) AS bin, edges
           FROM c360, e WHERE MonetaryTotal IS NOT NULL)
SELECT CAST(bin AS INTEGER) AS bin, edges[bin] AS "left", edges[bin + 1] AS "right", avg(y) AS rate,
       CAST(count(*) AS BIGINT) AS n
FROM t GROUP BY bin, edges""", "left right rate"))
def p20(spark, sf):
    return finish(P.qcut_rate(c360(spark, sf), "Churn", "MonetaryTotal", 4))


# ---------------------------------------------------------------- P21 median split
@register("p21_median_split_rate", oracle("""
WITH m AS (SELECT median(CAST(AvgDaysBetweenPurchases AS DOUBLE)) AS med FROM c360)
SELECT CASE WHEN AvgDaysBetweenPurchases <= med THEN 'low' ELSE 'high' END AS side, med,
       avg(CAST(Churn AS DOUBLE)) AS rate, CAST(count(*) AS BIGINT) AS n
FROM c360, m WHERE AvgDaysBetweenPurchases IS NOT NULL GROUP BY side, med""", "med rate"))
def p21(spark, sf):
    return finish(P.median_split_rate(c360(spark, sf), "Churn", "AvgDaysBetweenPurchases"))


# ---------------------------------------------------------------- P22 crosstab
@register("p22_crosstab_gender_status", oracle("""
SELECT Gender, CAST(count_if(AccountStatus = 'Active') AS BIGINT) AS Active,
       CAST(count_if(AccountStatus = 'Inactive') AS BIGINT) AS Inactive,
       CAST(count_if(AccountStatus = 'Suspended') AS BIGINT) AS Suspended
FROM c360 GROUP BY Gender"""))
def p22(spark, sf):
    return P.crosstab(c360(spark, sf), "Gender", "AccountStatus", ["Active", "Inactive", "Suspended"])


# ---------------------------------------------------------------- P23 describe per group
_P23 = ["MonetaryTotal", "Frequency"]


@register("p23_describe_by_spending", oracle(f"""
SELECT SpendingCategory, feature, CAST(count(value) AS BIGINT) AS count, avg(value) AS mean,
       stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25,
       quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75
FROM {duck_long(_P23, ['SpendingCategory'])} GROUP BY SpendingCategory, feature""",
    "mean std min max q25 q50 q75"))
def p23(spark, sf):
    return finish(P.describe_numeric(c360(spark, sf), _P23, by=["SpendingCategory"]))


# ---------------------------------------------------------------- P24 range overlap
@register("p24_range_overlap_spending", oracle("""
WITH g AS (SELECT SpendingCategory, min(MonetaryTotal) AS min, max(MonetaryTotal) AS max,
                  median(MonetaryTotal) AS median FROM c360 GROUP BY SpendingCategory)
SELECT SpendingCategory, min, max, median, lead(min) OVER (ORDER BY median, SpendingCategory) AS next_min,
       max >= lead(min) OVER (ORDER BY median, SpendingCategory) AS overlaps_next FROM g""",
    "min max median next_min"))
def p24(spark, sf):
    return finish(P.range_overlap(c360(spark, sf), "SpendingCategory", "MonetaryTotal"))


# ---------------------------------------------------------------- P25 derived-column match rates
@register("p25_derived_match_rates", oracle(f"""
SELECT avg(CASE WHEN (SELECT max(Recency) FROM c360) - Recency = CustomerTenureDays THEN 1.0 ELSE 0.0 END)
         AS recency_tenure_match,
       avg(CASE WHEN {season_sql('PreferredMonth')} = FavoriteSeason THEN 1.0 ELSE 0.0 END) AS season_match
FROM c360""", "recency_tenure_match season_match"))
def p25(spark, sf):
    df = c360(spark, sf)
    mx = df.agg(F.max("Recency")).scalar()
    return finish(df.agg(
        P.match_rate(df, mx - F.col("Recency"), F.col("CustomerTenureDays")).alias("recency_tenure_match"),
        P.match_rate(df, SF.month_to_season(F.col("PreferredMonth")), F.col("FavoriteSeason")).alias("season_match")))


# ---------------------------------------------------------------- P26 month → season
@register("p26_month_to_season", oracle(f"""
SELECT PreferredMonth AS month, {season_sql('PreferredMonth')} AS season, CAST(count(*) AS BIGINT) AS n
FROM c360 GROUP BY PreferredMonth"""))
def p26(spark, sf):
    df = c360(spark, sf)
    return (df.groupBy(F.col("PreferredMonth").alias("month"))
            .agg(F.count("*").cast("long").alias("n"))
            .select("month", SF.month_to_season(F.col("month")).alias("season"), "n"))


# ---------------------------------------------------------------- P27 pair correlation + zero counts
@register("p27_pair_corr_zero_counts", oracle(f"""
SELECT {corr_sql('MonetaryTotal', 'TotalQuantity')} AS r,
       CAST(count_if(ZeroPriceCount = 0) AS BIGINT) AS n_zero_price_zero,
       CAST(count_if(CancelledTransactions = 0) AS BIGINT) AS n_cancelled_zero
FROM c360""", "r"))
def p27(spark, sf):
    df = c360(spark, sf)
    return finish(df.agg(P.corr_expr(F.col("MonetaryTotal"), F.col("TotalQuantity")).alias("r"),
                         F.count_if(F.col("ZeroPriceCount") == 0).cast("long").alias("n_zero_price_zero"),
                         F.count_if(F.col("CancelledTransactions") == 0).cast("long").alias("n_cancelled_zero")))


# ---------------------------------------------------------------- P28 head
@register("p28_head_rows", oracle("""
SELECT CustomerID, Recency, CustomerTenureDays, FirstPurchaseDaysAgo FROM c360 ORDER BY CustomerID LIMIT 10"""))
def p28(spark, sf):
    return (c360(spark, sf).select("CustomerID", "Recency", "CustomerTenureDays", "FirstPurchaseDaysAgo")
            .orderBy("CustomerID").limit(10))


# ---------------------------------------------------------------- P29 means per season
@register("p29_means_by_season", oracle("""
SELECT FavoriteSeason, avg(CAST(Recency AS DOUBLE)) AS mean_recency, avg(MonetaryTotal) AS mean_monetary,
       avg(CAST(Churn AS DOUBLE)) AS churn_rate, CAST(count(*) AS BIGINT) AS n
FROM c360 GROUP BY FavoriteSeason""", "mean_recency mean_monetary churn_rate"))
def p29(spark, sf):
    return finish(c360(spark, sf).groupBy("FavoriteSeason").agg(
        F.avg(F.col("Recency").cast("double")).alias("mean_recency"),
        F.avg("MonetaryTotal").alias("mean_monetary"),
        F.avg(F.col("Churn").cast("double")).alias("churn_rate"),
        F.count("*").cast("long").alias("n")))


# ---------------------------------------------------------------- P30 findings summary
@register("p30_findings_summary", oracle(f"""
WITH tc AS (SELECT * FROM ({__import__('custaris.plans.sqlfrag', fromlist=['pairs_sql']).pairs_sql([(c, 'Churn') for c in NUM])})),
     pc AS (SELECT * FROM ({__import__('custaris.plans.sqlfrag', fromlist=['pairs_sql']).pairs_sql(
        [(NUM[i], NUM[j]) for i in range(len(NUM)) for j in range(i + 1, len(NUM))])})),
     sk AS (SELECT feature, {fix_sql('skewness(value)')} AS skew FROM {duck_long(NUM)} GROUP BY feature)
SELECT 'churn_rate' AS finding, (SELECT avg(CAST(Churn AS DOUBLE)) FROM c360) AS value
UNION ALL SELECT 'n_leaky_features_abs_r_gt_0.5', CAST(count_if(abs(r) > 0.5) AS DOUBLE) FROM tc
UNION ALL SELECT 'n_redundant_pairs_abs_r_gt_0.8', CAST(count_if(abs(r) > 0.8) AS DOUBLE) FROM pc
UNION ALL SELECT 'n_log_candidates', CAST(count_if(abs(skew) > 1) AS DOUBLE) FROM sk
UNION ALL SELECT 'n_countries', CAST(count(DISTINCT Country) AS DOUBLE) FROM c360""", "value"))
def p30(spark, sf):
    """One (finding, value) table unioned from P6, C2, C5, P14 and P8."""
    from ..operators import association as A
    df = c360(spark, sf)
    tc = A.target_correlations(df, NUM, "Churn")
    pc = A.correlation_matrix(df, NUM)
    sk = P.skewness_table(df, NUM)
    parts = [
        df.agg(F.avg(F.col("Churn").cast("double")).alias("value")).select(F.lit("churn_rate").alias("finding"), "value"),
        tc.agg(F.count_if(F.abs("r") > 0.5).cast("double").alias("value"))
          .select(F.lit("n_leaky_features_abs_r_gt_0.5").alias("finding"), "value"),
        pc.agg(F.count_if(F.abs("r") > 0.8).cast("double").alias("value"))
          .select(F.lit("n_redundant_pairs_abs_r_gt_0.8").alias("finding"), "value"),
        sk.agg(F.count_if(F.col("log_candidate")).cast("double").alias("value"))
          .select(F.lit("n_log_candidates").alias("finding"), "value"),
        df.agg(F.count_distinct("Country").cast("double").alias("value")).select(F.lit("n_countries").alias("finding"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finish(out)


_TC = f"tc AS (SELECT * FROM ({pairs_sql([(c, 'Churn') for c in NUM])}))"
_PC = f"pc AS (SELECT * FROM ({pairs_sql([(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]])}))"


@register("p30_findings_lists", oracle(f"""
WITH {_TC}, {_PC}, sk AS (SELECT feature, {fix_sql('skewness(value)')} AS skew FROM {duck_long(NUM)} GROUP BY feature),
f AS (SELECT 'leaky' AS finding, feature_a AS item, r AS value FROM tc WHERE abs(r) > 0.5
      UNION ALL SELECT 'redundant', feature_a || ' ~ ' || feature_b, r FROM pc WHERE abs(r) > 0.8
      UNION ALL SELECT 'log_candidate', feature, skew FROM sk WHERE abs(skew) > 1),
k AS (SELECT finding, CAST(row_number() OVER (PARTITION BY finding ORDER BY abs(value) DESC, item) AS INTEGER) AS "rank", item, value FROM f),
k5 AS (SELECT * FROM k WHERE finding <> 'redundant' OR "rank" <= 5)
SELECT finding, "rank", item, value FROM k5
UNION ALL SELECT 'derived_from_churn', CAST(i AS INTEGER), ['{"', '".join(P.DERIVED_FROM_CHURN)}'][i], CAST(NULL AS DOUBLE)
FROM (SELECT unnest(range(1, {len(P.DERIVED_FROM_CHURN) + 1})) AS i)
UNION ALL SELECT 'churn_rate', 1, 'Churn', avg(CAST(Churn AS DOUBLE)) FROM c360
UNION ALL SELECT 'n_countries', 1, 'Country', CAST(count(DISTINCT Country) AS DOUBLE) FROM c360""", "value"))
def p30_lists(spark, sf):
    """The lists behind the counts: leaky columns, the five strongest redundant pairs, log candidates."""
    from ..operators import association as A
    df = c360(spark, sf)
    return finish(P.findings(df, "Churn", "Country", A.target_correlations(df, NUM, "Churn"),
                             A.correlation_matrix(df, NUM), P.skewness_table(df, NUM)))
