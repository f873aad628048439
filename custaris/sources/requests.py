"""Scoring-request records (JSON) → typed customer rows with defaults.

The reference maps a request body field by field, casting and filling
defaults.  Here the mapping is one ``from_json`` with a fixed schema and one
select of ``coalesce(try_cast(field), default)`` — any number of records,
batch or stream.  A missing or badly typed field takes its default; a body
that can't be read at all is flagged and scored as null (see streaming/scoring).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values shared with the reference -------------------------------------------
# request field → (customer column, type, default)
REQUEST_FIELDS = [
    ("tenure", "CustomerTenureDays", "double", 365.0),
    ("frequency", "Frequency", "double", 1.0),
    ("avg_qty", "AvgQuantityPerTransaction", "double", 5.0),
    ("avg_products", "AvgProductsPerTransaction", "double", 2.0),
    ("unique_products", "UniqueProducts", "double", 1.0),
    ("monetary", "MonetaryTotal", "double", 0.0),
    ("monetary_max", "MonetaryMax", "double", 0.0),
    ("avg_days_between", "AvgDaysBetweenPurchases", "double", 30.0),
    ("unique_countries", "UniqueCountries", "double", 1.0),
    ("cancelled", "CancelledTransactions", "double", 0.0),
    ("return_ratio", "ReturnRatio", "double", 0.0),
    ("support_tickets", "SupportTicketsCount", "double", 0.0),
    ("preferred_day", "PreferredDayOfWeek", "double", 2.0),
    ("preferred_hour", "PreferredHour", "double", 14.0),
    ("weekend_ratio", "WeekendPurchaseRatio", "double", 0.3),
    ("age", "Age", "double", 35.0),
    ("spending_cat", "SpendingCategory", "string", "Medium"),
    ("age_cat", "AgeCategory", "string", "35-44"),
    ("basket_size", "BasketSizeCategory", "string", "Moyen"),
    ("preferred_time", "PreferredTimeOfDay", "string", "Après-midi"),
    ("season", "FavoriteSeason", "string", "Automne"),
    ("region", "Region", "string", "UK"),
    ("weekend_pref", "WeekendPreference", "string", "Semaine"),
    ("prod_diversity", "ProductDiversity", "string", "Modéré"),
    ("gender", "Gender", "string", "M"),
    ("account_status", "AccountStatus", "string", "Active"),
    ("country", "Country", "string", "United Kingdom"),
    ("reg_month", "RegMonth", "int", 6),
    ("reg_day", "RegDay", "int", 15),
    ("reg_weekday", "RegWeekday", "int", 2),
    ("is_private_ip", "IsPrivateIP", "int", 0),
    ("ip_class", "IPClass", "int", 1),
]
REQUEST_SCHEMA = T.StructType([T.StructField("customer_id", T.LongType())] +
                              [T.StructField(f, T.StringType()) for f, _, _, _ in REQUEST_FIELDS])


def request_json(df: DataFrame, key: str = "CustomerID") -> DataFrame:
    """Customer rows → request bodies (JSON text), the inverse of :func:`parse_requests`."""
    fields = [F.col(key).alias("customer_id")]
    for f, col, typ, _ in REQUEST_FIELDS:
        if col in df.columns:
            fields.append(F.col(col).cast("string").alias(f))
    return df.select(F.to_json(F.struct(*fields)).alias("body"))


def parse_requests(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """JSON bodies → typed rows: every field ``coalesce(try_cast(v), default)``;
    unparseable bodies keep a ``_corrupt`` flag instead of failing the job."""
    schema = T.StructType(REQUEST_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    j = F.from_json(F.col(body_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    x = bodies.select(j.alias("r"), F.col(body_col))
    cols: list[Column] = [F.col("r.customer_id").alias("CustomerID")]
    for f, col, typ, default in REQUEST_FIELDS:
        cols.append(F.coalesce(F.col(f"r.{f}").try_cast(typ), F.lit(default).cast(typ)).alias(col))
    # permissive parsing yields an all-null struct for a bad body; the raw text lands in _corrupt_record
    cols.append((F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()).alias("_corrupt"))
    return x.select(*cols)
