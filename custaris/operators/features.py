"""Cleaning, encoding and engineered features as one fitted transform.

``fit_prep`` learns every statistic on the *training* rows (categories on all
rows, as the reference does before its split) and returns a frozen
:class:`FittedPrep`.  ``FittedPrep.transform`` is then pure column
expressions plus one size-checked broadcast join (Country target encoding),
and is used unchanged for training, test, batch scoring and streaming scoring
(R1: one transform, no train/serve skew).

Statistics are gathered in a handful of aggregations over the whole table;
only per-feature scalars (bounded by the feature list) reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks as R
from ..functions import scalar as SF
from ..functions.numeric import signed_log1p
from ..session import ensure_checkpoint_dir

# --- fixed values shared with the reference -------------------------------------------
# Columns removed before modelling (constant / redundant / id / leaky / multicollinear).
DROP_COLUMNS = [
    "NewsletterSubscribed", "UniqueInvoices", "TotalTransactions", "UniqueDescriptions",
    "NegativeQuantityCount", "CustomerID", "ChurnRiskCategory", "RFMSegment", "LoyaltyLevel",
    "CustomerType", "Recency", "FirstPurchaseDaysAgo", "SatisfactionScore", "AvgLinesPerInvoice",
    "TotalQuantity", "MonetaryStd", "MonetaryMin", "MinQuantity", "MaxQuantity", "PreferredMonth",
    "FavoriteSeason", "SpendingCategory", "BasketSizeCategory",
]
# Signed-log columns (16).
LOG_COLUMNS = [
    "MonetaryTotal", "Frequency", "AvgBasketValue", "CancelledTransactions", "SupportTicketsCount",
    "ReturnRatio", "AvgDaysBetweenPurchases", "ZeroPriceCount", "UniqueCountries",
    "AvgProductsPerTransaction", "MonetaryAvg", "WeekendPurchaseRatio", "MonetaryMax",
    "EngagementScore", "RevenueIndex", "AvgQuantityPerTransaction",
]
MEDIAN_FILL = ["Age", "AgeCategory", "SupportTicketsCount", "RegYear", "RegMonth", "RegDay", "RegWeekday"]
TARGET_ENCODE_SMOOTHING = 10.0
STD_EPS = 1e-8
MAX_CATEGORIES = 10_000  # one-hot categories: each is a column of the plan
MAX_INLINE = 10_000      # rows of the target-encoding map that the fitted state holds itself


@dataclass(frozen=True)
class FittedPrep:
    key: str
    label: str | None
    categories: dict[str, list[str]]          # F7: kept (non-reference) categories per column
    onehot_source: list[str]
    te_global: float                           # F9
    te_rows: list[tuple[str, float]]           # F9 map of up to MAX_INLINE categories
    medians: dict[str, float]                  # F11
    ip_mode: float                             # F13
    rr_mean: float
    rr_std: float
    ct_mean: float
    ct_std: float                              # F17
    revenue_mean: float                        # F18
    net_medians: dict[str, float]              # F14
    scale_mean: dict[str, float]               # F22
    scale_std: dict[str, float]
    features: list[str] = field(default_factory=list)
    te_path: str | None = None                 # F9 map of more categories: a table in the shared folder

    # ---------------------------------------------------------------- S5 round trip
    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(s: str) -> "FittedPrep":
        d = json.loads(s)
        d["te_rows"] = [tuple(x) for x in d["te_rows"]]
        return FittedPrep(**d)

    def save(self, spark: SparkSession, path: str) -> None:
        """The state as one row; a map kept as a table is copied beside it, so that the saved state stands alone."""
        state = self
        if self.te_path:
            state = replace(self, te_path=f"{path.rstrip('/')}-encoding")
            self.te_table(spark).write.mode("overwrite").parquet(state.te_path)
        spark.createDataFrame([(state.to_json(),)], "state string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedPrep":
        return FittedPrep.from_json(spark.read.parquet(path).first()["state"])

    # ---------------------------------------------------------------- apply
    def te_table(self, spark: SparkSession) -> DataFrame:
        if self.te_path:
            return spark.read.schema("Country string, Country_TargetEnc double").parquet(self.te_path)
        return spark.createDataFrame(self.te_rows or [("", 0.0)], "Country string, Country_TargetEnc double") \
            .where(F.lit(bool(self.te_rows)))

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Raw customer rows → model features (+ key, label and ``keep`` columns)."""
        spark = df.sparkSession
        x = base_clean(df)
        x = one_hot(x, self.categories)
        tab = self.te_table(spark)
        te = tab if self.te_path else F.broadcast(tab)  # inline: at most MAX_INLINE rows; a table is joined by shuffle
        x = (x.join(te, "Country", "left")
             .withColumn("Country_TargetEnc", F.coalesce("Country_TargetEnc", F.lit(self.te_global)))
             .drop("Country"))
        # absent optional inputs become typed nulls, then the fitted fills apply
        for c in [*self.medians, "IsPrivateIP", "AvgDaysBetweenPurchases"]:
            if c not in x.columns:
                x = x.withColumn(c, F.lit(None).cast("double"))
        x = impute(x, self.medians, self.ip_mode)
        x = engineer(x, self.rr_mean, self.rr_std, self.ct_mean, self.ct_std, self.revenue_mean)
        x = log_columns(x)
        for c in self.features:
            if c not in x.columns:
                x = x.withColumn(c, F.lit(None).cast("double"))
        x = x.select(*[c for c in x.columns if c not in self.features],
                     *[F.coalesce(F.col(c).cast("double"), F.lit(self.net_medians.get(c))).alias(c)
                       for c in self.features])
        scaled = [((F.col(c) - F.lit(self.scale_mean[c])) / F.lit(self.scale_std[c])).alias(c)
                  for c in self.features]
        extra = [c for c in [self.key, self.label, *keep] if c and c in x.columns]
        return x.select(*extra, *scaled)


# --- stage A: row-local cleaning (no fitted state) ---------------------------------------

def base_clean(df: DataFrame) -> DataFrame:
    """F1 dates, F2/F3 IP, F4 drops, F5 sentinels, F6 ordinals."""
    cols = set(df.columns)
    x = df
    if "RegistrationDate" in cols:
        ts = SF.parse_mixed_date(F.col("RegistrationDate"))
        x = x.select("*", *SF.date_parts(ts)).drop("RegistrationDate")
    if "LastLoginIP" in cols:
        x = x.select("*", SF.is_private_ip(F.col("LastLoginIP")).alias("IsPrivateIP"),
                     SF.ip_class(F.col("LastLoginIP")).alias("IPClass")).drop("LastLoginIP")
    keep_key = [c for c in DROP_COLUMNS if c != "CustomerID"]
    x = x.drop(*keep_key)
    if "SupportTicketsCount" in x.columns:
        x = x.withColumn("SupportTicketsCount", SF.null_sentinels(F.col("SupportTicketsCount"), SF.TICKET_SENTINELS))
    if "IsPrivateIP" in x.columns:
        x = x.withColumn("IsPrivateIP", SF.null_sentinels(F.col("IsPrivateIP"), (-1,)))
    if "AgeCategory" in x.columns:
        x = x.withColumn("AgeCategory", SF.ordinal(F.col("AgeCategory"), SF.AGE_CATEGORY_ORDER).cast("double"))
    if "PreferredTimeOfDay" in x.columns:
        x = x.withColumn("PreferredTimeOfDay",
                         SF.ordinal(F.col("PreferredTimeOfDay"), SF.TIME_OF_DAY_ORDER).cast("double"))
    return x


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in exclude]


def fit_categories(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """F7 fit: sorted categories per column minus the first (reference) one."""
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "f", "v")
    d = long.where(F.col("v").isNotNull()).distinct()
    n = d.count()
    if n > MAX_CATEGORIES:
        raise ValueError(f"{n} categories exceed the one-hot bound {MAX_CATEGORIES}")
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in d.collect():  # bounded by MAX_CATEGORIES (checked above)
        cats[r["f"]].append(r["v"])
    return {c: sorted(v)[1:] for c, v in cats.items()}


def onehot_name(col: str, cat: str) -> str:
    return f"{col}_{cat}"


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """F7/F8 apply: 1/0 per kept category; null or unseen → all zeros; source dropped."""
    adds = [F.when(F.col(c) == v, 1).otherwise(0).alias(onehot_name(c, v))
            for c, vals in categories.items() if c in df.columns for v in vals]
    return df.select("*", *adds).drop(*[c for c in categories if c in df.columns])


def target_encoding(train: DataFrame, col: str, label: str, k: float = TARGET_ENCODE_SMOOTHING,
                    overall: float | None = None) -> DataFrame:
    """F9 fit: (n·mean + k·global)/(n + k) per category, from training rows; ``overall``: the global mean if known."""
    glob = train.agg(F.avg(F.col(label).cast("double"))).scalar() if overall is None else F.lit(overall)
    return (train.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("m"))
            .select(col, ((F.col("n") * F.col("m") + k * glob) / (F.col("n") + k)).alias(f"{col}_TargetEnc")))


def impute(df: DataFrame, medians: dict[str, float], ip_mode: float) -> DataFrame:
    """F10 missing flag, F11 median fills, F12 constant fill, F13 mode fill."""
    x = df
    if "Age" in x.columns:
        x = x.withColumn("Age_IsMissing", F.col("Age").isNull().cast("int"))
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in medians if c in x.columns}
    if "AvgDaysBetweenPurchases" in x.columns:
        fills["AvgDaysBetweenPurchases"] = F.coalesce(F.col("AvgDaysBetweenPurchases"), F.lit(0.0))
    if "IsPrivateIP" in x.columns:
        fills["IsPrivateIP"] = F.coalesce(F.col("IsPrivateIP").cast("double"), F.lit(ip_mode))
    return x.withColumns(fills)


def engineer(df: DataFrame, rr_mean: float, rr_std: float, ct_mean: float, ct_std: float,
             revenue_mean: float) -> DataFrame:
    """Basket value (before logs), engagement, disengagement z-sum, revenue index."""
    m, f = F.col("MonetaryTotal"), F.col("Frequency").cast("double")
    return df.withColumns({
        "AvgBasketValue": m / (f + 1),
        "EngagementScore": f / (F.col("CustomerTenureDays").cast("double") + 1),
        "DisengagementScore": (F.col("ReturnRatio") - rr_mean) / rr_std
                              + (F.col("CancelledTransactions").cast("double") - ct_mean) / ct_std,
        "RevenueIndex": m / (revenue_mean + 1),
    })


def legacy_disengagement(df: DataFrame, col: str = "DisengagementScore") -> DataFrame:
    """F17, older variant and the one-record form: ReturnRatio + CancelledTransactions / 10, without fitted state."""
    return df.withColumn(col, F.col("ReturnRatio") + F.col("CancelledTransactions").cast("double") / 10)


def log_columns(df: DataFrame, cols: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    """sign(x)·log1p(|x|) on the named columns that are present."""
    return df.withColumns({c: signed_log1p(F.col(c).cast("double")) for c in cols if c in df.columns})


def feature_columns(df: DataFrame, key: str, label: str | None, exclude: Sequence[str] = ()) -> list[str]:
    skip = {key, label, *exclude}
    return [f.name for f in df.schema.fields if f.name not in skip
            and f.dataType.simpleString() in ("double", "int", "bigint", "float", "boolean", "smallint")]


def _one_row(df: DataFrame, aggs: list[Column]) -> dict:
    return df.agg(*aggs).first().asDict()


def fit_prep(df: DataFrame, train_filter: Column, key: str = "CustomerID", label: str = "Churn",
             passthrough: Sequence[str] = ()) -> FittedPrep:
    """Fit every statistic of the R1 transform.  ``train_filter`` selects the
    training rows; categories use all rows (as the reference does)."""
    a = base_clean(df)
    onehot_src = string_columns(a, exclude=["Country", *passthrough])
    cats = fit_categories(a, onehot_src)
    x = one_hot(a, cats)
    train = x.where(train_filter)

    te_global = float(train.agg(F.avg(F.col(label).cast("double"))).first()[0])
    te_path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/custaris-encoding-{uuid.uuid4().hex[:12]}"
    target_encoding(train, "Country", label, overall=te_global).write.parquet(te_path)
    te = df.sparkSession.read.schema("Country string, Country_TargetEnc double").parquet(te_path)
    small = te.count() <= MAX_INLINE            # from the files' footers
    te_rows = [(r["Country"], float(r["Country_TargetEnc"])) for r in te.collect()] if small else []

    med_cols = [c for c in MEDIAN_FILL if c in train.columns]
    long = train.select(*[F.col(c).cast("double").alias(c) for c in med_cols]).unpivot([], med_cols, "feature", "v")
    meds = {r["feature"]: r["median"] for r in R.exact_median(long, ["feature"], "v").collect()}
    medians = {c: float(meds[c]) if meds.get(c) is not None else 0.0 for c in med_cols}
    ip_mode_row = R.mode_of(train, [], "IsPrivateIP").first()
    ip_mode = float(ip_mode_row[0]) if ip_mode_row and ip_mode_row[0] is not None else 0.0

    s = _one_row(train, [F.avg("ReturnRatio").alias("rr_m"), F.stddev_samp("ReturnRatio").alias("rr_s"),
                         F.avg(F.col("CancelledTransactions").cast("double")).alias("ct_m"),
                         F.stddev_samp(F.col("CancelledTransactions").cast("double")).alias("ct_s"),
                         F.avg("MonetaryTotal").alias("rev_m")])
    rr_std = (s["rr_s"] or 0.0) + STD_EPS
    ct_std = (s["ct_s"] or 0.0) + STD_EPS

    x2 = (x.join(F.broadcast(te) if small else te, "Country", "left")
          .withColumn("Country_TargetEnc", F.coalesce("Country_TargetEnc", F.lit(te_global))).drop("Country"))
    x2 = impute(x2, medians, ip_mode)
    x2 = engineer(x2, s["rr_m"], rr_std, s["ct_m"], ct_std, s["rev_m"])
    x2 = log_columns(x2)
    feats = feature_columns(x2, key, label, exclude=[*passthrough, "split", "fold"])
    train2 = x2.where(train_filter).select(*[F.col(c).cast("double").alias(c) for c in feats])

    long2 = train2.unpivot([], feats, "feature", "v")
    net = {r["feature"]: r["median"] for r in R.exact_median(long2, ["feature"], "v").collect()}
    net_medians = {c: float(net[c]) if net.get(c) is not None else 0.0 for c in feats}
    filled = train2.select(*[F.coalesce(F.col(c), F.lit(net_medians[c])).alias(c) for c in feats])
    st = _one_row(filled, [e for c in feats for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"),
                                                      F.min(c).alias(f"lo_{c}"))])
    # zero variance: the column is constant on train, so centre on that exact value (its min)
    scale_mean = {c: float(st[f"m_{c}"] if st[f"s_{c}"] else st[f"lo_{c}"]) for c in feats}
    scale_std = {c: (float(st[f"s_{c}"]) if st[f"s_{c}"] else 1.0) for c in feats}

    return FittedPrep(key=key, label=label, categories=cats, onehot_source=onehot_src, te_global=te_global,
                      te_rows=te_rows, medians=medians, ip_mode=ip_mode, rr_mean=float(s["rr_m"]),
                      rr_std=rr_std, ct_mean=float(s["ct_m"]), ct_std=ct_std, revenue_mean=float(s["rev_m"]),
                      net_medians=net_medians, scale_mean=scale_mean, scale_std=scale_std, features=feats,
                      te_path=None if small else te_path)


# --- other fitted helpers -------------------------------------------------------------

def cap_at_quantile(df: DataFrame, col: str, train_filter: Column, q: float = 0.99,
                    out: str | None = None) -> tuple[DataFrame, float]:
    """cap at the training p-quantile; flag rows above the cap."""
    cap = R.exact_quantiles(df.where(train_filter), [], col, [q]).first()["quantile"]
    o = out or f"{col}_capped"
    return df.withColumns({o: F.least(F.col(col), F.lit(cap)), f"{col}_above_cap": F.col(col) > cap}), cap


def drop_z_outliers(df: DataFrame, cols: Sequence[str], z: float = 4.0) -> DataFrame:
    """keep rows with every |value| ≤ z (inputs already standardised)."""
    return df.where(F.greatest(*[F.abs(F.col(c)) for c in cols]) <= z)


def inverse_scale(c: Column, mean: float, std: float) -> Column:
    """x·scale + mean."""
    return c * std + mean


def inverse_monetary(c: Column, mean: float, std: float) -> Column:
    """inverse scaling then expm1."""
    return F.expm1(c * std + mean)
