"""Sources and sinks.

Everything here is plain ``spark.read`` / ``df.write``: Parquet keeps filter
pushdown and column pruning, CSV is always read with an explicit schema so no
inference pass scans the data twice.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Tables:
    """Lazy handles on the driver tables of one scale-factor folder."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


# --- S1: the wide customer file, with an explicit schema -----------------------------

def customer_csv_schema() -> T.StructType:
    """Schema of the wide customer CSV (FIXTURES.md section 1)."""
    d, i, l, s = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()
    fields = [
        ("CustomerID", l), ("Country", s), ("Region", s), ("Recency", i), ("Frequency", l),
        ("TotalTransactions", l), ("UniqueInvoices", l), ("MonetaryTotal", d), ("MonetaryAvg", d),
        ("MonetaryStd", d), ("MonetaryMin", d), ("MonetaryMax", d), ("TotalQuantity", d),
        ("MinQuantity", d), ("MaxQuantity", d), ("AvgQuantityPerTransaction", d),
        ("CustomerTenureDays", i), ("FirstPurchaseDaysAgo", i), ("PreferredDayOfWeek", i),
        ("PreferredHour", i), ("PreferredMonth", i), ("WeekendPurchaseRatio", d),
        ("AvgDaysBetweenPurchases", d), ("UniqueProducts", l), ("UniqueCountries", i),
        ("AvgLinesPerInvoice", d), ("AvgProductsPerTransaction", d), ("NegativeQuantityCount", l),
        ("ZeroPriceCount", l), ("CancelledTransactions", l), ("ReturnRatio", d), ("Age", d),
        ("SupportTicketsCount", d), ("SatisfactionScore", d), ("NewsletterSubscribed", s),
        ("RegistrationDate", s), ("LastLoginIP", s), ("WeekendPreference", s),
        ("ProductDiversity", s), ("Gender", s), ("AccountStatus", s), ("AgeCategory", s),
        ("PreferredTimeOfDay", s), ("SpendingCategory", s), ("BasketSizeCategory", s),
        ("FavoriteSeason", s), ("CustomerType", s), ("ChurnRiskCategory", s), ("Churn", i),
    ]
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def read_customers(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV → typed DataFrame (no schema inference pass)."""
    return (spark.read.schema(schema or customer_csv_schema())
            .option("header", True).option("mode", "PERMISSIVE").csv(path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file with a key column; joined by key, never by position."""
    return spark.read.option("header", True).schema("CustomerID long, Churn int").csv(path)


def attach_labels(features: DataFrame, labels: DataFrame, key: str = "CustomerID") -> DataFrame:
    """Pair X with y by key (inner join; Spark rows carry no position)."""
    return features.join(labels, key, "inner")


# --- S3/S4: sinks -----------------------------------------------------------------------

def write_split(df: DataFrame, path: str, split_col: str = "split") -> None:
    """S3: train/test written once, partitioned by split so readers prune."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result tables (clusters, profiles, metrics, drift, predictions)."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def rows_to_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Any number of records → typed DataFrame."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
