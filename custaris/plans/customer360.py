"""Customer-360 builder: star-schema tables → one row per customer.

The reference starts from a ready-made wide customer file; the driver supplies
TPC-H-style tables instead.  This plan derives the same wide layout
(FIXTURES.md section 4) with joins and grouped aggregation:

* lineitem ⟕ orders on the order key (both sides shuffled on the key, dealt so that a task's lines,
  and with them the memory of its sums, stay bounded; large tables by way of a few shares, so that
  the scans keep nothing in memory);
* per-order aggregates grouped on (order key, customer key) reuse that
  partitioning — no second exchange;
* distinct parts per customer come from a second join of the same two
  tables, pruned to (order key, customer key, part key), whose pairs of
  customer and part are dealt over as many tasks as the lines;
* per-customer aggregates are map-side combined before their shuffle;
* weekday / month modes come from fixed-width count arrays inside the same
  aggregation, so no extra shuffle or window is needed;
* nation / region are joined through a size-checked broadcast;
* a customer holding a third of all orders still reaches the final aggregate
  as one partial row per map task (hash aggregate with partial merge).

Attributes the star schema does not carry (age, IP, sentinels, registration
string formats) are stand-in columns derived from the customer key, exactly as
FIXTURES.md describes; operators downstream never rely on those rules.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import standin as SI
from ..operators.joins import bounded_broadcast
from ..sources.tables import Tables

CHURN_RECENCY_DAYS = 270

# Named feature lists (never dtype-driven selection, see SURVEY section 1).
NUMERIC_FEATURES = [
    "Recency", "Frequency", "MonetaryTotal", "MonetaryAvg", "MonetaryStd", "MonetaryMin",
    "MonetaryMax", "TotalQuantity", "MinQuantity", "MaxQuantity", "AvgQuantityPerTransaction",
    "CustomerTenureDays", "FirstPurchaseDaysAgo", "PreferredDayOfWeek", "PreferredHour",
    "PreferredMonth", "WeekendPurchaseRatio", "AvgDaysBetweenPurchases", "UniqueProducts",
    "UniqueCountries", "AvgLinesPerInvoice", "AvgProductsPerTransaction",
    "NegativeQuantityCount", "ZeroPriceCount", "CancelledTransactions", "ReturnRatio", "Age",
    "SupportTicketsCount", "SatisfactionScore",
]
CATEGORICAL_FEATURES = [
    "Country", "Region", "WeekendPreference", "ProductDiversity", "Gender", "AccountStatus",
    "AgeCategory", "PreferredTimeOfDay", "SpendingCategory", "BasketSizeCategory",
    "FavoriteSeason", "CustomerType", "ChurnRiskCategory", "NewsletterSubscribed",
]
TARGET = "Churn"
KEY = "CustomerID"


def _line_revenue() -> F.Column:
    # exact decimal arithmetic: both engines produce identical sums
    return (F.col("l_extendedprice").cast("decimal(18,2)")
            * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")))


LINES_A_TASK = 100_000       # joined lines of one task: its sums take about 1 KB a line
MANY_TASKS = 4000            # beyond so many tasks they grow, up to ..
MOST_LINES_A_TASK = 500_000
SHARES = 200                 # a task that writes to more (spark.shuffle.sort.bypassMergeThreshold) sorts in memory all that it reads


def line_tasks(n_lines: int) -> int:
    """Tasks of the joins by order key: the memory of one follows from its lines, not from the table or the session."""
    return max(1, min(math.ceil(n_lines / LINES_A_TASK), max(MANY_TASKS, math.ceil(n_lines / MOST_LINES_A_TASK))))


def dealt(df: DataFrame, key: str, n: int, *cols: F.Column) -> DataFrame:
    """``cols`` of the rows in ``n`` tasks by ``key``, the first of them that key under another name.

    More than ``SHARES`` tasks are reached in two steps: what a scan task reads follows from the files and the session, so it
    writes to few shares, row by row; a share is a small part of the table.
    """
    if n > SHARES:
        df = df.repartition(SHARES, key)
    out = df.select(*cols)
    return out.repartition(n, out.columns[0])


def build_customer360(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide per-customer table from the driver tables in ``sf_dir``."""
    t = Tables(spark, sf_dir)

    # lines ⟕ orders: orders without any line keep one row (null line columns)
    n = line_tasks(t.lineitem.count())
    lines = dealt(
        t.lineitem, "l_orderkey", n, F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"),
        _line_revenue().alias("rev"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_ret"),
        (F.col("l_extendedprice") == 0).cast("int").alias("is_zero"),
    )
    orders = dealt(t.orders, "o_orderkey", n, F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("ck"),
                   F.to_date("o_orderdate").alias("o_date"), "o_orderstatus")
    order_lines = orders.join(lines, F.col("order") == F.col("ok"), "left")

    per_order = order_lines.groupBy("order", "ck", "o_date", "o_orderstatus").agg(
        F.coalesce(F.sum("rev"), F.lit(0)).cast("decimal(18,4)").alias("o_rev"),
        F.sum("qty").alias("o_qty"),
        F.min("qty").alias("o_min_qty"),
        F.max("qty").alias("o_max_qty"),
        F.count("ok").alias("o_lines"),
        F.count_distinct("part").alias("o_parts"),
        F.coalesce(F.sum("is_ret"), F.lit(0)).alias("o_ret"),
        F.coalesce(F.sum("is_zero"), F.lit(0)).alias("o_zero"),
    )

    dow = F.weekday("o_date")
    month = F.month("o_date")
    rev_d = F.col("o_rev").cast("double")
    per_cust = per_order.groupBy("ck").agg(
        F.count("*").alias("n_orders"),
        F.min("o_date").alias("first_date"),
        F.max("o_date").alias("last_date"),
        F.sum("o_rev").alias("rev_sum"),
        F.stddev_samp(rev_d).alias("rev_std"),
        F.min("o_rev").alias("rev_min"),
        F.max("o_rev").alias("rev_max"),
        F.sum("o_qty").alias("qty_sum"),
        F.min("o_min_qty").alias("qty_min"),
        F.max("o_max_qty").alias("qty_max"),
        F.sum("o_lines").alias("n_lines"),
        F.sum("o_parts").alias("parts_per_order_sum"),
        F.sum("o_ret").alias("n_ret"),
        F.sum("o_zero").alias("n_zero"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_cancelled"),
        F.count_if(dow >= 5).alias("n_weekend"),
        F.array(*[F.count_if(dow == d) for d in range(7)]).alias("dow_counts"),
        F.array(*[F.count_if(month == m) for m in range(1, 13)]).alias("month_counts"),
    )

    # pairs hardly repeat before they meet, so they are dealt like the lines: as many a task whatever the table's size
    cust_parts = (order_lines.where(F.col("part").isNotNull())
                  .select("ck", F.col("part").alias("l_partkey")).repartition(n, "ck", "l_partkey").distinct()
                  .groupBy("ck").agg(F.count("*").alias("n_parts")))

    ev = t.events
    n_users = ev.agg((F.max("user_id") + 1).alias("n")).scalar()
    errors = (ev.where(F.col("event_type") == "error")
              .groupBy(F.col("user_id").alias("uk")).agg(F.count("*").alias("n_err")))

    snap = t.orders.agg(F.max(F.to_date("o_orderdate"))).scalar()

    geo = t.nation.join(bounded_broadcast(t.region, 10_000),
                        F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("Country"), F.col("r_name").alias("Region"))

    cust = (t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
            .join(bounded_broadcast(geo, 10_000), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .withColumn("uk", F.col("c_custkey") % n_users))

    base = (cust.join(per_cust, F.col("c_custkey") == F.col("ck"), "left").drop("ck")
            .join(cust_parts, F.col("c_custkey") == F.col("ck"), "left").drop("ck")
            .join(errors, "uk", "left"))

    key = F.col("c_custkey")
    n = F.coalesce(F.col("n_orders"), F.lit(0)).cast("long")
    nd = n.cast("double")
    recency = F.datediff(snap, F.col("last_date"))
    tenure = F.datediff(F.col("last_date"), F.col("first_date"))
    monetary = F.coalesce(F.col("rev_sum").cast("decimal(18,4)").cast("double"), F.lit(0.0))
    qty = F.coalesce(F.col("qty_sum"), F.lit(0.0))
    tickets = F.coalesce(F.col("n_err"), F.lit(0)).cast("double")

    core = base.select(
        key.alias("CustomerID"),
        F.col("Country"), F.col("Region"),
        recency.alias("Recency"),
        n.alias("Frequency"),
        n.alias("TotalTransactions"),
        n.alias("UniqueInvoices"),  # per_order rows are distinct orders by construction
        monetary.alias("MonetaryTotal"),
        F.try_divide(monetary, nd).alias("MonetaryAvg"),
        F.col("rev_std").alias("MonetaryStd"),
        F.col("rev_min").cast("double").alias("MonetaryMin"),
        F.col("rev_max").cast("double").alias("MonetaryMax"),
        qty.alias("TotalQuantity"),
        F.col("qty_min").alias("MinQuantity"),
        F.col("qty_max").alias("MaxQuantity"),
        F.try_divide(qty, nd).alias("AvgQuantityPerTransaction"),
        tenure.alias("CustomerTenureDays"),
        F.datediff(snap, F.col("first_date")).alias("FirstPurchaseDaysAgo"),
        F.when(n > 0, (F.array_position("dow_counts", F.array_max("dow_counts")) - 1).cast("int"))
         .alias("PreferredDayOfWeek"),
        (key % 24).cast("int").alias("PreferredHour"),
        F.when(n > 0, F.array_position("month_counts", F.array_max("month_counts")).cast("int"))
         .alias("PreferredMonth"),
        F.try_divide(F.col("n_weekend").cast("double"), nd).alias("WeekendPurchaseRatio"),
        F.when(n > 1, tenure.cast("double") / (n - 1).cast("double")).alias("AvgDaysBetweenPurchases"),
        F.coalesce(F.col("n_parts"), F.lit(0)).cast("long").alias("UniqueProducts"),
        F.lit(1).alias("UniqueCountries"),
        F.try_divide(F.col("n_lines").cast("double"), nd).alias("AvgLinesPerInvoice"),
        F.try_divide(F.col("parts_per_order_sum").cast("double"), nd).alias("AvgProductsPerTransaction"),
        F.coalesce(F.col("n_ret"), F.lit(0)).cast("long").alias("NegativeQuantityCount"),
        F.coalesce(F.col("n_zero"), F.lit(0)).cast("long").alias("ZeroPriceCount"),
        F.coalesce(F.col("n_cancelled"), F.lit(0)).cast("long").alias("CancelledTransactions"),
        F.coalesce(F.try_divide(F.col("n_ret").cast("double"), F.col("n_lines").cast("double")),
                   F.lit(0.0)).alias("ReturnRatio"),
        F.when(key % 10 < 3, F.lit(None).cast("double"))
         .otherwise((F.lit(18) + key % 60).cast("double")).alias("Age"),
        F.when(key % 50 == 0, F.lit(-1.0)).when(key % 50 == 1, F.lit(999.0))
         .otherwise(tickets).alias("SupportTicketsCount"),
        (F.lit(1) + (key * 7) % 5).cast("double").alias("SatisfactionScore"),
        F.col("first_date").alias("_first_date"),
        F.col("c_mktsegment").alias("_segment"),
    )
    cats = [F.expr(sql).alias(name) for name, sql in SI.categorical_columns("spark")]
    return core.select("*", *cats).drop("_first_date", "_segment")
