"""SQL of the queries on stored tables."""

from oracle.base import avg, money, pct
from oracle.reports import API, COLUMNS, ROW_ID

KEY = "CAST(transaction_id AS BIGINT)"
MONTH = "strftime(date, '%Y-%m')"
AFTER_ID = COLUMNS.split(",", 2)[2]
STATES = {"opened before": "year < 1998", "broken off": "year < 1998", "published": "true", "by number": "year < 1998"}

HOURS = """, spans AS (
  SELECT prio, discount_period, CAST(start_d AS TIMESTAMP) AS b, CAST(end_d AS TIMESTAMP) + INTERVAL 1 DAY AS s FROM periods
  WHERE y >= (SELECT MIN(year) FROM e) AND y <= (SELECT MAX(year) FROM e) + 1
), hours AS (
  SELECT prio + 10 AS prio, discount_period || ' early' AS discount_period, b AS start_t, b + INTERVAL 12 HOURS AS end_t FROM spans
  UNION ALL SELECT prio + 20, discount_period || ' rush', d + INTERVAL 10 HOURS, d + INTERVAL 15 HOURS
    FROM (SELECT *, unnest(generate_series(b, s - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM spans)
  UNION ALL SELECT prio + 30, discount_period, b, s FROM spans
), tagged AS (
  SELECT date, arg_min(discount_period, prio) AS discount_period
  FROM (SELECT DISTINCT date FROM sales) JOIN hours ON date >= start_t AND date < end_t GROUP BY 1
)"""

TABLE_SQL = {
    "versioned_publish": " UNION ALL ".join(
        f"SELECT country, COUNT(*) AS n, {money()} AS total, '{state}' AS state FROM e WHERE {where} GROUP BY 1"
        for state, where in STATES.items()
    ),
    "upsert_months": f"""SELECT * REPLACE (
        CASE WHEN {KEY} % 10 = 0 AND {MONTH} = '1997-07' THEN date + INTERVAL 2 MONTHS ELSE date END AS date,
        CASE WHEN {KEY} % 10 = 0 AND {MONTH} IN ('1996-02', '1997-07') THEN units_sold + 100 ELSE units_sold END AS units_sold)
      FROM (SELECT {COLUMNS} FROM sales)
      UNION ALL SELECT date, '9' || transaction_id, {AFTER_ID} FROM sales WHERE {MONTH} = '1999-03'""",
    "page_indexed": f"SELECT {COLUMNS} FROM sales ORDER BY date DESC, {ROW_ID} LIMIT 25 OFFSET 1000",
    "chunk_deliveries": f"SELECT {COLUMNS} FROM sales",
    "interval_tagged": f"""{HOURS} SELECT date, {ROW_ID}, t.discount_period, t.discount_period IS NOT NULL AS discount_applied
      FROM sales LEFT JOIN tagged t USING (date)""",
    "interval_totals": f"""{HOURS} SELECT hours.discount_period, COUNT(*) AS n, {money('total_amount_per_product_sgd')} AS total
      FROM sales JOIN hours ON date >= start_t AND date < end_t GROUP BY 1""",
    "lookup_hot_city": f""", c AS (SELECT city, MIN(country_id) AS listed_id FROM sales
        WHERE country NOT IN ('NATION_6', 'NATION_18') GROUP BY 1)
      SELECT {ROW_ID}, s.city, listed_id FROM (SELECT * REPLACE (CASE WHEN {KEY} % 3 = 0 THEN 'NATION_1-0'
        WHEN {KEY} % 53 <> 1 THEN city END AS city) FROM sales) s LEFT JOIN c ON s.city = c.city""",
    "distinct_from_cells": f"""SELECT 'hour' AS grain, hour AS value, {money()} AS total_revenue, TRUE AS close FROM e GROUP BY 2
      UNION ALL SELECT 'year', year, {money()}, TRUE FROM sold GROUP BY 2""",
    "bundle_from_cells": " UNION ALL ".join(
        f"SELECT '{name}' AS report, {key} AS key, {n} AS n, {money()} AS revenue, {average} AS average, TRUE AS close FROM {source} GROUP BY 2"
        for name, key, n, average, source in [
            ("sales_summary_by_country", "country", "COUNT(*)", avg(), "sold"),
            ("hourly_sales_analysis", "CAST(hour AS VARCHAR)", "COUNT(*)", avg(), "sold"),
            ("discount_periods_analysis", "discount_period", "COUNT(*)", avg(), "sold WHERE discount_applied"),
            ("regular_vs_discount_comparison", "CASE WHEN discount_applied THEN 'Discounted' ELSE 'Regular Price' END", "COUNT(*)",
             f"ROUND({pct('COUNT(*)', '(SELECT COUNT(*) FROM sold)')}, 2)", "sold"),
            ("age_group_analysis", "country || '/' || band3", "COUNT(*)", avg("age"), "sold WHERE age IS NOT NULL"),
            ("product_performance_analysis", "product_name", "COUNT(*) FILTER (discount_applied)", avg("CASE WHEN discount_applied THEN amt END"), "sold"),
        ]
    ),
    "customer_from_copy": API["customer_totals"],
    "receipt_from_copy": API["receipt_items"],
}
