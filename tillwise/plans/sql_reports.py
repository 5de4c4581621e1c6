"""The four reports as Spark SQL, for use from a SQL client on any line table or view.

Each text takes the table through ``{lines}`` and its parameters by name, and plans to the same
shape as the DataFrame operators: one scan, and rows combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwise.config import AnalysisConfig

FUNNEL = """
SELECT stack(6,
         1, 'raw', n0, 2, 'remove_cancel_invoice', n1, 3, 'remove_short_stock_code', n2,
         4, 'remove_non_positive_quantity', n3, 5, 'remove_non_positive_unit_price', n4,
         6, 'remove_quantity_outliers', n5) AS (step_order, step_name, rows_remaining)
FROM (
  SELECT count(*) AS n0,
         count_if(sold) AS n1,
         count_if(sold AND product) AS n2,
         count_if(sold AND product AND Quantity > 0) AS n3,
         count_if(sold AND product AND Quantity > 0 AND UnitPrice > 0) AS n4,
         count_if(sold AND product AND Quantity > 0 AND UnitPrice > 0 AND Quantity NOT IN ({outliers})) AS n5
  FROM (
    SELECT NOT startswith(InvoiceNo, :cancel_prefix) AS sold,
           length(StockCode) >= :min_code_length AS product,
           Quantity, UnitPrice
    FROM {lines}
  )
)
"""

_CLEAN = """
  NOT startswith(InvoiceNo, :cancel_prefix) AND length(StockCode) >= :min_code_length
  AND Quantity > 0 AND UnitPrice > 0 AND Quantity NOT IN ({outliers})
"""

MONTHLY_KPI = """
WITH orders AS (
  SELECT to_date(InvoiceDate) AS day, InvoiceNo, CustomerID, sum(Quantity * UnitPrice) AS revenue
  FROM {lines}
  WHERE InvoiceDate >= CAST(:first_day AS TIMESTAMP_NTZ)
    AND InvoiceDate < CAST(date_add(CAST(:last_day AS DATE), 1) AS TIMESTAMP_NTZ)
    AND {clean}
  GROUP BY ALL
),
days AS (
  SELECT day, sum(revenue) AS revenue, count(DISTINCT InvoiceNo) AS orders,
         count(DISTINCT CustomerID) + max(CAST(CustomerID IS NULL AS INT)) AS customers
  FROM orders
  GROUP BY day
),
months AS (
  SELECT date_format(c.day, 'yyyy-MM') AS order_month, count(*) AS n,
         sum(d.revenue) AS revenue, sum(d.customers) AS customers, sum(d.orders) AS orders
  FROM (SELECT explode(sequence(CAST(:first_day AS DATE), CAST(:last_day AS DATE))) AS day) c
  LEFT JOIN days d ON c.day = d.day
  GROUP BY order_month
)
SELECT order_month,
       CAST(round(CAST(coalesce(CAST(revenue AS DOUBLE), 0) / n AS DECIMAL(38, 6)), 2) AS DOUBLE) AS avg_daily_revenue,
       CAST(round(CAST(coalesce(customers, 0) / n AS DECIMAL(38, 6)), 2) AS DOUBLE) AS avg_daily_customers,
       CAST(round(CAST(coalesce(orders, 0) / n AS DECIMAL(38, 6)), 2) AS DOUBLE) AS avg_daily_orders
FROM months
ORDER BY order_month
"""

COHORT_RETENTION = """
WITH active AS (
  SELECT DISTINCT CustomerID, trunc(InvoiceDate, 'MM') AS month
  FROM {lines}
  WHERE CustomerID IS NOT NULL AND {clean}
),
offsets AS (
  SELECT first_month, (year(month) - year(first_month)) * 12 + month(month) - month(first_month) AS month_diff
  FROM (SELECT month, min(month) OVER (PARTITION BY CustomerID) AS first_month FROM active)
),
cells AS (
  SELECT first_month, month_diff, count(*) AS retained_users
  FROM offsets
  WHERE month_diff BETWEEN 0 AND :max_month_diff
  GROUP BY first_month, month_diff
),
sized AS (
  SELECT *, max(IF(month_diff = 0, retained_users, NULL)) OVER (PARTITION BY first_month) AS new_users
  FROM cells
)
SELECT date_format(first_month, 'yyyy-MM') AS cohort_month, month_diff, new_users, retained_users,
       CAST(round(CAST(100 * try_divide(retained_users, new_users) AS DECIMAL(38, 6)), 2) AS DOUBLE) AS retention_rate
FROM sized
ORDER BY cohort_month, month_diff
"""

GUEST_METRICS = """
WITH orders AS (
  SELECT trunc(InvoiceDate, 'MM') AS month, InvoiceNo, every(CustomerID IS NULL) AS guest,
         sum(Quantity * UnitPrice) AS revenue
  FROM {lines}
  WHERE {clean}
  GROUP BY ALL
),
months AS (
  SELECT month, count_if(guest) AS guest_orders, count(*) AS total_orders,
         CAST(coalesce(sum(revenue) FILTER (WHERE guest), 0) AS DOUBLE) AS guest_revenue,
         CAST(sum(revenue) AS DOUBLE) AS total_revenue
  FROM orders
  GROUP BY month
)
SELECT date_format(month, 'yyyy-MM') AS order_month, guest_orders, total_orders,
       CAST(round(CAST(100 * try_divide(guest_orders, total_orders) AS DECIMAL(38, 6)), 2) AS DOUBLE)
         AS guest_order_share_pct,
       CAST(round(CAST(100 * try_divide(guest_revenue, total_revenue) AS DECIMAL(38, 6)), 2) AS DOUBLE)
         AS guest_revenue_share_pct,
       CAST(round(CAST(try_divide(guest_revenue, guest_orders) AS DECIMAL(38, 6)), 2) AS DOUBLE)
         AS guest_avg_revenue_per_order
FROM months
ORDER BY order_month
"""


def run_sql(text: str, lines: DataFrame, config: AnalysisConfig) -> DataFrame:
    """One of the texts above over a line table."""
    rules, window = config.rules, config.window
    outliers = ", ".join(str(int(q)) for q in rules.outlier_quantities)
    filled = text.replace("{clean}", _CLEAN).replace("{outliers}", outliers)
    named = {
        "cancel_prefix": rules.cancel_prefix,
        "min_code_length": rules.min_code_length,
        "first_day": window.start.isoformat(),
        "last_day": window.end.isoformat(),
        "max_month_diff": config.max_month_diff,
    }
    return lines.sparkSession.sql(filled, args=named, lines=lines)
