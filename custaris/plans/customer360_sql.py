"""DuckDB text of the customer-360 builder, used only by the correctness oracle.

Mirrors :func:`custaris.plans.customer360.build_customer360` step for step;
the categorical columns are the very same SQL texts (``standin``).
"""

from __future__ import annotations

from . import standin as SI


def _cats() -> str:
    return ",\n       ".join(f"{sql} AS {name}" for name, sql in SI.categorical_columns("duckdb"))


def customer360_cte() -> str:
    """``c360 AS (...)`` CTE body (plus helpers) for DuckDB."""
    dow = "(isodow(o_date) - 1)"
    month = "month(o_date)"
    dow_arr = ", ".join(f"count_if({dow} = {d})" for d in range(7))
    mon_arr = ", ".join(f"count_if({month} = {m})" for m in range(1, 13))
    return f"""
_lines AS (
  SELECT l_orderkey, l_partkey, l_quantity,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS rev,
         CAST(l_returnflag = 'R' AS INTEGER) AS is_ret,
         CAST(l_extendedprice = 0 AS INTEGER) AS is_zero
  FROM lineitem),
_orders AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_date, o_orderstatus FROM orders),
_order_lines AS (
  SELECT * FROM _orders LEFT JOIN _lines ON o_orderkey = l_orderkey),
_per_order AS (
  SELECT o_orderkey, o_custkey, o_date, o_orderstatus,
         CAST(coalesce(sum(rev), 0) AS DECIMAL(18,4)) AS o_rev,
         sum(l_quantity) AS o_qty, min(l_quantity) AS o_min_qty, max(l_quantity) AS o_max_qty,
         count(l_orderkey) AS o_lines, count(DISTINCT l_partkey) AS o_parts,
         coalesce(sum(is_ret), 0) AS o_ret, coalesce(sum(is_zero), 0) AS o_zero
  FROM _order_lines GROUP BY o_orderkey, o_custkey, o_date, o_orderstatus),
_per_cust AS (
  SELECT o_custkey AS ck, count(*) AS n_orders, min(o_date) AS first_date, max(o_date) AS last_date,
         sum(o_rev) AS rev_sum, stddev_samp(CAST(o_rev AS DOUBLE)) AS rev_std,
         min(o_rev) AS rev_min, max(o_rev) AS rev_max,
         sum(o_qty) AS qty_sum, min(o_min_qty) AS qty_min, max(o_max_qty) AS qty_max,
         sum(o_lines) AS n_lines, sum(o_parts) AS parts_per_order_sum,
         sum(o_ret) AS n_ret, sum(o_zero) AS n_zero,
         count_if(o_orderstatus = 'P') AS n_cancelled,
         count_if({dow} >= 5) AS n_weekend,
         [{dow_arr}] AS dow_counts,
         [{mon_arr}] AS month_counts
  FROM _per_order GROUP BY o_custkey),
_cust_parts AS (
  SELECT o_custkey AS ck, count(DISTINCT l_partkey) AS n_parts
  FROM _order_lines WHERE l_partkey IS NOT NULL GROUP BY o_custkey),
_errors AS (
  SELECT user_id AS uk, count(*) AS n_err FROM events WHERE event_type = 'error' GROUP BY user_id),
_snap AS (SELECT max(CAST(o_orderdate AS DATE)) AS snap FROM orders),
_nu AS (SELECT max(user_id) + 1 AS nu FROM events),
_base AS (
  SELECT c.c_custkey, c.c_mktsegment, n.n_name AS Country, r.r_name AS Region, pc.*, cp.n_parts, e.n_err, s.snap,
         coalesce(pc.n_orders, 0) AS n
  FROM customer c
  LEFT JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey
  CROSS JOIN _snap s CROSS JOIN _nu u
  LEFT JOIN _per_cust pc ON c.c_custkey = pc.ck
  LEFT JOIN _cust_parts cp ON c.c_custkey = cp.ck
  LEFT JOIN _errors e ON e.uk = c.c_custkey % u.nu),
_core AS (
  SELECT c_custkey AS CustomerID, Country, Region,
         CAST(date_diff('day', last_date, snap) AS INTEGER) AS Recency,
         CAST(n AS BIGINT) AS Frequency, CAST(n AS BIGINT) AS TotalTransactions, CAST(n AS BIGINT) AS UniqueInvoices,
         coalesce(CAST(CAST(rev_sum AS DECIMAL(18,4)) AS DOUBLE), 0.0) AS MonetaryTotal,
         CASE WHEN n > 0 THEN coalesce(CAST(CAST(rev_sum AS DECIMAL(18,4)) AS DOUBLE), 0.0) / CAST(n AS DOUBLE) END AS MonetaryAvg,
         rev_std AS MonetaryStd,
         CAST(rev_min AS DOUBLE) AS MonetaryMin, CAST(rev_max AS DOUBLE) AS MonetaryMax,
         coalesce(qty_sum, 0.0) AS TotalQuantity, qty_min AS MinQuantity, qty_max AS MaxQuantity,
         CASE WHEN n > 0 THEN coalesce(qty_sum, 0.0) / CAST(n AS DOUBLE) END AS AvgQuantityPerTransaction,
         CAST(date_diff('day', first_date, last_date) AS INTEGER) AS CustomerTenureDays,
         CAST(date_diff('day', first_date, snap) AS INTEGER) AS FirstPurchaseDaysAgo,
         CASE WHEN n > 0 THEN CAST(list_position(dow_counts, list_max(dow_counts)) - 1 AS INTEGER) END AS PreferredDayOfWeek,
         CAST(c_custkey % 24 AS INTEGER) AS PreferredHour,
         CASE WHEN n > 0 THEN CAST(list_position(month_counts, list_max(month_counts)) AS INTEGER) END AS PreferredMonth,
         CASE WHEN n > 0 THEN CAST(n_weekend AS DOUBLE) / CAST(n AS DOUBLE) END AS WeekendPurchaseRatio,
         CASE WHEN n > 1 THEN CAST(date_diff('day', first_date, last_date) AS DOUBLE) / CAST(n - 1 AS DOUBLE) END AS AvgDaysBetweenPurchases,
         CAST(coalesce(n_parts, 0) AS BIGINT) AS UniqueProducts,
         1 AS UniqueCountries,
         CASE WHEN n > 0 THEN CAST(n_lines AS DOUBLE) / CAST(n AS DOUBLE) END AS AvgLinesPerInvoice,
         CASE WHEN n > 0 THEN CAST(parts_per_order_sum AS DOUBLE) / CAST(n AS DOUBLE) END AS AvgProductsPerTransaction,
         CAST(coalesce(n_ret, 0) AS BIGINT) AS NegativeQuantityCount,
         CAST(coalesce(n_zero, 0) AS BIGINT) AS ZeroPriceCount,
         CAST(coalesce(n_cancelled, 0) AS BIGINT) AS CancelledTransactions,
         coalesce(CASE WHEN n_lines > 0 THEN CAST(n_ret AS DOUBLE) / CAST(n_lines AS DOUBLE) END, 0.0) AS ReturnRatio,
         CASE WHEN c_custkey % 10 < 3 THEN NULL ELSE CAST(18 + c_custkey % 60 AS DOUBLE) END AS Age,
         CASE WHEN c_custkey % 50 = 0 THEN -1.0 WHEN c_custkey % 50 = 1 THEN 999.0
              ELSE CAST(coalesce(n_err, 0) AS DOUBLE) END AS SupportTicketsCount,
         CAST(1 + (c_custkey * 7) % 5 AS DOUBLE) AS SatisfactionScore,
         first_date AS _first_date, c_mktsegment AS _segment
  FROM _base),
c360 AS (
  SELECT * EXCLUDE (_first_date, _segment),
       {_cats()}
  FROM _core)"""


def with_c360(body: str, extra_ctes: str = "") -> str:
    """Prefix a query body with the customer-360 CTE (plus optional CTEs)."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {customer360_cte()}{extra}\n{body}"
