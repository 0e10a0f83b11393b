"""SQL of the named reports."""

from oracle.base import avg, div, money, pct, pick, uniq, whole

COLUMNS = """date, transaction_id, transaction_desc, customer_id, age, gender, receipt_number,
  product_id, product_name, units_sold, unit_price_sgd, total_amount_per_product_sgd,
  receipt_total_sgd, country_id, country, city, income"""
ROW_ID = "transaction_id, product_id, total_amount_per_product_sgd"
MIN_YEAR = 1998

# Segment names and limits that results must show.
INCOME = """CASE WHEN income < 30000 THEN 'Low Income (< 30k)'
  WHEN income >= 30000 AND income <= 60000 THEN 'Middle Income (30k-60k)'
  WHEN income >= 60001 AND income <= 100000 THEN 'Upper Middle (60k-100k)'
  WHEN income > 100000 THEN 'High Income (>100k)' ELSE 'Unknown' END"""
CAREER = """CASE WHEN age < 25 THEN 'Young Adults (<25)' WHEN age <= 40 THEN 'Mid Career (25-40)'
  WHEN age <= 55 THEN 'Senior Career (41-55)' WHEN age > 55 THEN 'Pre-Retirement (55+)'
  ELSE 'Unknown Age' END"""
BAND6 = """CASE WHEN age IS NULL OR age < 18 THEN 'Unknown' WHEN age <= 25 THEN '18-25'
  WHEN age <= 35 THEN '26-35' WHEN age <= 45 THEN '36-45' WHEN age <= 55 THEN '46-55'
  WHEN age <= 65 THEN '56-65' ELSE '65+' END"""
BAND3N = """CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 25 THEN '1. Under 25'
  WHEN age < 41 THEN '2. 25 to 40' ELSE '3. 41 and above' END"""
PERIOD = """CASE WHEN hour >= 6 AND hour < 12 THEN 'Morning (06:00-11:59)'
  WHEN hour >= 12 AND hour < 18 THEN 'Afternoon (12:00-17:59)'
  WHEN hour >= 18 AND hour < 22 THEN 'Evening (18:00-21:59)' ELSE 'Late Night (22:00-05:59)' END"""


def growth(cur: str, prev: str) -> str:
    return f"""CASE WHEN {prev} IS NULL THEN NULL WHEN {prev} = 0 AND {cur} = 0 THEN 0.0
      WHEN {prev} = 0 THEN 100.0
      ELSE CAST({cur} - {prev} AS DOUBLE) / CAST({prev} AS DOUBLE) * 100.0 END"""


def segments(expr: str) -> str:
    return f"""SELECT income_segment, customer_count, transaction_count, total_revenue,
      avg_transaction_value, {div('total_revenue', 'customer_count')} AS avg_spent_per_customer
    FROM (SELECT {expr} AS income_segment, {uniq('customer_id')} AS customer_count,
        COUNT(*) AS transaction_count, {money()} AS total_revenue, {avg()} AS avg_transaction_value
      FROM e GROUP BY 1)"""


FOUR = f"""COUNT(*) AS total_transactions, {money()} AS total_revenue,
  {avg()} AS avg_transaction_value, {uniq('customer_id')} AS unique_customers"""

HOURLY = f"SELECT hour, {FOUR}, {uniq('receipt_number')} AS unique_receipts FROM sold GROUP BY hour"
DAILY = f"""SELECT day AS sales_date, dow_text AS day_of_week_text, month_text, year,
  COUNT(*) AS total_transactions, {money()} AS daily_revenue, {avg()} AS avg_transaction_value,
  {uniq('customer_id')} AS unique_customers, {uniq('receipt_number')} AS unique_receipts
  FROM e GROUP BY 1, 2, 3, 4"""
SALE_DAYS = f"""SELECT day AS sale_date, day_name, CAST(dayofweek(day) AS BIGINT) AS day_number,
  COUNT(*) AS transactions, {money()} AS revenue, {avg()} AS avg_value,
  {uniq('customer_id')} AS customers, {uniq('receipt_number')} AS receipts
  FROM sold GROUP BY 1, 2, 3"""
COUNTRY = f"SELECT country, {FOUR} FROM e GROUP BY country"
AGE_COUNTRY = f"""SELECT country, band3 AS age_group, {FOUR}, {avg('age')} AS avg_age_in_group
  FROM e WHERE age IS NOT NULL GROUP BY 1, 2"""
AGE_DIST = f"""SELECT country, COUNT(*) FILTER (age < 25) AS under_25_customers,
  COUNT(*) FILTER (age >= 25 AND age <= 40) AS age_25_40_customers,
  COUNT(*) FILTER (age > 40) AS age_41_plus_customers,
  ROUND(CAST(SUM(age) FILTER (age < 25) AS DOUBLE) / NULLIF(COUNT(*) FILTER (age < 25), 0), 1)
    AS avg_age_under_25,
  ROUND(CAST(SUM(age) FILTER (age >= 25 AND age <= 40) AS DOUBLE)
    / NULLIF(COUNT(*) FILTER (age >= 25 AND age <= 40), 0), 1) AS avg_age_25_40,
  ROUND(CAST(SUM(age) FILTER (age > 40) AS DOUBLE) / NULLIF(COUNT(*) FILTER (age > 40), 0), 1)
    AS avg_age_41_plus,
  ROUND({avg('age')}, 1) AS overall_avg_age
  FROM e WHERE age IS NOT NULL GROUP BY country"""
AGE_SHARE = f"""SELECT g.country, g.age_group, g.age_group_revenue, t.country_total_revenue,
  ROUND({pct('g.age_group_revenue', 't.country_total_revenue')}, 2) AS revenue_percentage
  FROM (SELECT country, band3 AS age_group, {money()} AS age_group_revenue
        FROM e WHERE age IS NOT NULL GROUP BY 1, 2) g
  JOIN (SELECT country, {money()} AS country_total_revenue
        FROM e WHERE age IS NOT NULL GROUP BY 1) t ON g.country = t.country"""
PERIODS = f"""SELECT {PERIOD} AS time_period, CAST(SUM(total_transactions) AS BIGINT) AS total_transactions,
  {money('total_revenue')} AS total_revenue,
  ROUND(AVG(avg_transaction_value), 2) AS mean_hourly_avg_value,
  CAST(SUM(unique_customers) AS BIGINT) AS sum_hourly_customers FROM h GROUP BY 1"""
BY_WEEKDAY = f"""SELECT day_name, COUNT(*) AS days, {avg('transactions')} AS avg_transactions,
  {avg('revenue')} AS avg_revenue, {avg('customers')} AS avg_customers,
  {div('SUM(revenue)', 'SUM(transactions)')} AS avg_value FROM d GROUP BY day_name"""


def weekday_value(name: str, measure: str) -> str:
    return f"COALESCE(MAX({measure}) FILTER (day_name = '{name}'), 0.0)"


def week(measure: str) -> str:
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
    return "(" + " + ".join(weekday_value(d, measure) for d in days) + ") / 5.0"


def weekend(measure: str) -> str:
    return f"({weekday_value('Saturday', measure)} + {weekday_value('Sunday', measure)}) / 2.0"


def both_ends(measures: dict[str, str]) -> dict[str, tuple[str, str]]:
    return {f"{side}_{n}": (c, side) for n, c in measures.items() for side in ("max", "min")}


MEASURES = {
    "transactions": "total_transactions",
    "revenue": "total_revenue",
    "avg_value": "avg_transaction_value",
    "customers": "unique_customers",
}
NO_COUNT = {k: v for k, v in MEASURES.items() if k != "transactions"}
DISCOUNTED = "FROM sold WHERE discount_applied"
PRICE_TYPE = "CASE WHEN discount_applied THEN 'Discounted' ELSE 'Regular Price' END"
PRODUCT = f"""{money()} AS total_revenue, {whole('units_sold')} AS total_units_sold,
  COUNT(*) AS transactions, {avg('unit_price_sgd')} AS avg_price"""


def top(key: str, table: str, k: int, name: str, where: str = "", order: str = "") -> str:
    return f"""SELECT {key}, {money()} AS {name} FROM {table} {where}
      GROUP BY {key}{', ' + order if order else ''} ORDER BY {name} DESC, {order or key} LIMIT {k}"""


def days(k: int, order: str) -> str:
    return f"""SELECT sales_date, day_of_week_text, month_text, year, daily_revenue, total_transactions
      FROM ({DAILY}) ORDER BY daily_revenue {order}, sales_date LIMIT {k}"""


def sale_days(k: int, order: str) -> str:
    return f"""SELECT sale_date, day_name, revenue, transactions FROM ({SALE_DAYS})
      ORDER BY revenue {order}, sale_date LIMIT {k}"""


def hours(k: int, order: str) -> str:
    return f"""SELECT hour, total_revenue, total_transactions FROM ({HOURLY})
      ORDER BY total_revenue {order}, hour LIMIT {k}"""


def concentration(table: str, measure: str) -> str:
    return f"""SELECT peak AS peak_pct, low AS low_pct, peak / low AS peak_to_low FROM (
      SELECT {pct(f'MAX({measure})', f'SUM({measure})')} AS peak,
        {pct(f'MIN({measure})', f'SUM({measure})')} AS low FROM {table})"""


def years_of_top(key: str, extra: str) -> str:
    return f"""SELECT year, {key}, {money()} AS total_sales{extra} FROM sold
      WHERE {key} IN (SELECT {key} FROM ({top(key, 'sold', 5, 'r')})) GROUP BY 1, 2"""


API = {
    "sales_page": f"""SELECT {COLUMNS} FROM e
      WHERE date >= '1996-01-01' AND date <= '1999-12-31' AND age >= 25 AND age <= 65
      ORDER BY date DESC, {ROW_ID} LIMIT 50 OFFSET 100""",
    "sales_page_total": """SELECT COUNT(*) AS total_records FROM e
      WHERE date >= '1996-01-01' AND date <= '1999-12-31' AND age >= 25 AND age <= 65""",
    "customers": "SELECT DISTINCT customer_id, age, country FROM e",
    "customers_summary": f"""SELECT customer_id, age, country, COUNT(*) AS total_sales,
      {money()} AS total_amount FROM e GROUP BY 1, 2, 3""",
    "sales_summary": f"""SELECT COUNT(*) AS total_records, {money()} AS total_revenue,
      {uniq('customer_id')} AS unique_customers, {uniq('receipt_number')} AS unique_receipts,
      MIN(date) AS date_start, MAX(date) AS date_end FROM e""",
    "summary_top_products": f"""SELECT product_id, product_name, {whole('units_sold')} AS total_units,
      {money()} AS total_revenue, {avg('unit_price_sgd')} AS avg_price FROM e GROUP BY 1, 2
      ORDER BY total_revenue DESC, product_id, product_name LIMIT 10""",
    "top_products": f"""SELECT product_id, product_name, COUNT(*) AS transaction_count,
      {whole('units_sold')} AS total_units_sold, {money()} AS total_revenue,
      {avg('unit_price_sgd')} AS avg_price FROM e GROUP BY 1, 2
      ORDER BY total_revenue DESC, product_id, product_name LIMIT 20""",
    "monthly_trends": f""", m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month,
        {money()} AS revenue, {uniq('customer_id')} AS customers FROM e GROUP BY 1),
      p AS (SELECT *, LAG(revenue) OVER (ORDER BY month) AS prev_revenue,
        LAG(customers) OVER (ORDER BY month) AS prev_customers FROM m)
      SELECT *, {growth('revenue', 'prev_revenue')} AS revenue_change_pct,
        {growth('customers', 'prev_customers')} AS customer_change_pct FROM p""",
    "customer_demographics": f"""SELECT *, {div('total_spent', 'customer_count')} AS avg_spent_per_customer
      FROM (SELECT {BAND6} AS age_group, gender, {uniq('customer_id')} AS customer_count,
        {avg('income')} AS avg_income, {money()} AS total_spent FROM e GROUP BY 1, 2)""",
    "hourly_distribution": f"""SELECT hour AS hour_of_day, COUNT(*) AS transaction_count,
      {money()} AS total_revenue, {uniq('customer_id')} AS unique_customers FROM e GROUP BY 1""",
    "geographic_distribution": f"""SELECT *, RANK() OVER (ORDER BY total_revenue DESC) AS revenue_rank
      FROM (SELECT country, COUNT(*) AS transactions, {uniq('customer_id')} AS customers,
        {money()} AS total_revenue FROM e GROUP BY country) ORDER BY revenue_rank, country LIMIT 15""",
    "value_transactions": f""", t AS (SELECT *, NTILE(10) OVER (ORDER BY amt,
          substr(md5(customer_id), 1, 15)) AS tile FROM e)
      SELECT CASE tile WHEN 1 THEN 'Bottom 10%' ELSE 'Top 10%' END AS value_segment,
        COUNT(*) AS transaction_count, {uniq('customer_id')} AS unique_customers,
        {avg('age')} AS avg_customer_age, {avg()} AS avg_transaction_value, {money()} AS total_revenue,
        (CAST(SUM(amt) AS DOUBLE) / COUNT(*)) / (SELECT {avg()} FROM e) AS relative_to_average
      FROM t WHERE tile IN (1, 10) GROUP BY tile""",
    "income_levels": segments(INCOME),
    "income_levels_by_age": segments(CAREER),
    "sales_by_date": f"""SELECT '1996-07-04' AS date, COUNT(*) AS transaction_count,
      {money()} AS daily_revenue, {uniq('customer_id')} AS unique_customers,
      {uniq('receipt_number')} AS unique_receipts, {avg('receipt_total_sgd')} AS avg_receipt_value
      FROM e WHERE day = DATE '1996-07-04' HAVING COUNT(*) > 0""",
    "customer_totals": f"""SELECT '7' AS customer_id, COUNT(*) AS total_transactions,
      {money()} AS total_spent, {uniq('receipt_number')} AS total_receipts,
      MIN(date) AS first_purchase, MAX(date) AS last_purchase
      FROM e WHERE customer_id = '7' HAVING COUNT(*) > 0""",
    "customer_recent": f"""SELECT product_name, units_sold, amt AS amount, date
      FROM e WHERE customer_id = '7' ORDER BY date DESC, {ROW_ID} LIMIT 10""",
    "receipt_items": """, r AS (SELECT * FROM e WHERE receipt_number = '20'),
      f AS (SELECT * FROM r ORDER BY product_name, transaction_id, product_id, amt LIMIT 1)
      SELECT r.receipt_number, f.customer_id, f.date, f.receipt_total_sgd, r.product_id,
        r.product_name, r.units_sold, r.unit_price_sgd, r.amt AS total_amount_sgd FROM r CROSS JOIN f""",
}

EXPORTS = {
    "complete_dataset": f"SELECT {COLUMNS} FROM e",
    "sales_by_country": f"""SELECT country, {FOUR}, {uniq('product_name')} AS unique_products
      FROM sold GROUP BY country""",
    "hourly_sales": HOURLY,
    "discount_periods": f"""SELECT discount_period, COUNT(*) AS transactions, {money()} AS revenue,
      {avg()} AS avg_transaction, {uniq('customer_id')} AS customers {DISCOUNTED} GROUP BY 1""",
    "regular_vs_discount": f"""SELECT {PRICE_TYPE} AS price_type, COUNT(*) AS transactions,
      {money()} AS revenue, {avg()} AS avg_transaction, {uniq('customer_id')} AS customers,
      ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sold), 2) AS transaction_percentage
      FROM sold GROUP BY 1""",
    "age_by_country": f"""SELECT country, band3 AS age_group, {FOUR}, {avg('age')} AS avg_age_in_group
      FROM sold WHERE age IS NOT NULL GROUP BY 1, 2""",
    "product_performance": f"""SELECT product_name, {FOUR}, {uniq('country')} AS countries_sold_in,
      COUNT(*) FILTER (discount_applied) AS discounted_sales,
      CAST(SUM(amt) FILTER (discount_applied) AS DOUBLE)
        / NULLIF(COUNT(*) FILTER (discount_applied), 0) AS avg_discounted_price
      FROM sold GROUP BY product_name""",
    "table_profile": f"""SELECT COUNT(*) AS total_rows, {uniq('customer_id')} AS unique_customers,
      {uniq('product_id')} AS unique_product_ids, {uniq('product_name')} AS unique_products,
      {uniq('country')} AS unique_countries, MIN(date) AS earliest_date, MAX(date) AS latest_date,
      {money()} AS total_revenue, {avg()} AS avg_revenue FROM e""",
    "transaction_types": """SELECT transaction_desc, COUNT(*) AS count,
      ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM e), 2) AS percentage FROM e GROUP BY 1""",
    "best_country": top("country", "sold", 1, "revenue"),
    "best_product": top("product_name", "sold", 1, "revenue"),
    "best_hour": top("hour", "sold", 1, "revenue"),
    "best_discount_period": top("discount_period", "sold", 1, "revenue", "WHERE discount_applied"),
    "key_metrics": f"""SELECT {avg()} AS avg_transaction, COUNT(DISTINCT day) AS days_of_operation,
      {div('SUM(amt)', 'COUNT(DISTINCT day)')} AS avg_daily_revenue FROM sold""",
    "index_probe_counts": """SELECT
      COUNT(*) FILTER (day = (SELECT MIN(day) FROM e)) AS first_day,
      COUNT(*) FILTER (customer_id = (SELECT MIN(customer_id) FROM e)) AS customer,
      COUNT(*) FILTER (product_id = (SELECT MIN(product_id) FROM e)) AS product,
      COUNT(*) FILTER (age >= 25 AND age <= 40) AS age_25_40,
      COUNT(*) FILTER (income > 50000) AS income_above_50k,
      COUNT(*) FILTER (country = (SELECT MIN(country) FROM e)) AS country,
      COUNT(*) FILTER (city = (SELECT MIN(city) FROM e)) AS city,
      COUNT(*) FILTER (gender = 'F') AS female,
      COUNT(*) FILTER (transaction_desc = (SELECT MIN(transaction_desc) FROM e)) AS transaction_type,
      COUNT(*) FILTER (hour = 12) AS hour_12 FROM e""",
}

SUMMARY = {
    "sale_stats": f"""SELECT COUNT(*) AS total_rows, MIN(date) AS start_date, MAX(date) AS end_date,
      {avg()} AS avg_sales, MIN(amt) AS min_sales, MAX(amt) AS max_sales FROM sold""",
    "best_weekday": f"""SELECT dow_text AS day_of_week_text, {money()} AS total_sales FROM sold
      GROUP BY dow_text, dow ORDER BY total_sales DESC, dow LIMIT 1""",
    "best_month": f"""SELECT month_text, {money()} AS total_sales FROM sold
      GROUP BY month_text, month ORDER BY total_sales DESC, month LIMIT 1""",
    "daily_sales": DAILY,
    "top_days": days(10, "DESC"),
    "bottom_days": days(10, "ASC"),
    "daily_highlights": f", d AS ({DAILY})\n"
    + pick(
        "d",
        ["sales_date", "day_of_week_text"],
        {
            "best_revenue": ("daily_revenue", "max"),
            "lowest_revenue": ("daily_revenue", "min"),
            "most_transactions": ("total_transactions", "max"),
            "fewest_transactions": ("total_transactions", "min"),
            "most_customers": ("unique_customers", "max"),
            "best_avg_value": ("avg_transaction_value", "max"),
        },
    ),
    "daily_stats": f"""SELECT COUNT(*) AS days, {avg('daily_revenue')} AS avg_daily_revenue,
      MIN(daily_revenue) AS min_daily_revenue, MAX(daily_revenue) AS max_daily_revenue,
      {avg('total_transactions')} AS avg_daily_transactions,
      {avg('unique_customers')} AS avg_daily_customers FROM ({DAILY})""",
    "country_sales": COUNTRY,
    "country_highlights": f", c AS ({COUNTRY})\n" + pick("c", ["country"], both_ends(MEASURES)),
    "age_country": AGE_COUNTRY,
    "age_country_highlights": f", c AS ({AGE_COUNTRY})\n"
    + pick("c", ["country", "age_group"], both_ends(NO_COUNT)),
    "age_distribution": AGE_DIST,
    "age_distribution_highlights": f", a AS ({AGE_DIST})\n"
    + pick(
        "a",
        ["country"],
        {
            "oldest_market": ("overall_avg_age", "max"),
            "youngest_market": ("overall_avg_age", "min"),
            "most_young": ("under_25_customers", "max"),
            "most_senior": ("age_41_plus_customers", "max"),
            "highest_under_25": ("avg_age_under_25", "max"),
            "lowest_under_25": ("avg_age_under_25", "min"),
            "highest_25_40": ("avg_age_25_40", "max"),
            "lowest_25_40": ("avg_age_25_40", "min"),
            "highest_41_plus": ("avg_age_41_plus", "max"),
            "lowest_41_plus": ("avg_age_41_plus", "min"),
        },
    ),
    "age_revenue_share": AGE_SHARE,
    "age_share_highlights": f", a AS ({AGE_SHARE})\n"
    + "\nUNION ALL\n".join(
        [pick("a", ["country", "age_group"],
              {f"{side}_overall": ("revenue_percentage", side) for side in ("max", "min")})]
        + [
            pick("a", ["country", "age_group"],
                 {f"{side}_{band}": ("revenue_percentage", side) for side in ("max", "min")},
                 f"age_group = '{band}'")
            for band in ("Under 25", "25-40", "41+")
        ]
    ),
    "hour_highlights": f", h AS ({HOURLY})\n" + pick("h", ["hour"], both_ends(MEASURES)),
    "time_periods": f", h AS ({HOURLY})\n{PERIODS}",
    "period_highlights": f""", h AS ({HOURLY}), p AS ({PERIODS})
      (SELECT 'best' AS place, * FROM p ORDER BY total_revenue DESC, time_period LIMIT 1)
      UNION ALL
      (SELECT 'worst' AS place, * FROM p ORDER BY total_revenue, time_period LIMIT 1)""",
    "peak_hours": hours(3, "DESC"),
    "low_hours": hours(3, "ASC"),
    "revenue_concentration": concentration(f"({HOURLY})", "total_revenue"),
    "largest_sales": f"""SELECT date, total_amount_per_product_sgd, country, dow_text AS day,
      month_text AS month, year FROM e WHERE amt >= 20 ORDER BY amt DESC, {ROW_ID} LIMIT 10""",
    "sales_only_by_country": f"""SELECT country, {money()} AS total_sales, COUNT(*) AS transaction_count,
      {avg()} AS avg_transaction_value, {uniq('customer_id')} AS unique_customers
      FROM sold GROUP BY country""",
    "transaction_breakdown": f"""SELECT transaction_desc, COUNT(*) AS transaction_count,
      {money()} AS total_amount, {avg()} AS avg_amount,
      ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM e), 2) AS percentage FROM e GROUP BY 1""",
    "refund_impact": f""", t AS (
        SELECT (SELECT {money()} FROM e) AS total_revenue, (SELECT COUNT(*) FROM e) AS total_transactions,
          (SELECT {money()} FROM sold) AS sales_revenue, (SELECT COUNT(*) FROM sold) AS sales_transactions)
      SELECT *, CAST(total_revenue - sales_revenue AS DECIMAL(38,2)) AS revenue_impact,
        total_transactions - sales_transactions AS transaction_impact,
        {pct('total_revenue - sales_revenue', 'total_revenue')} AS revenue_impact_pct,
        {pct('total_transactions - sales_transactions', 'total_transactions')} AS transaction_impact_pct
      FROM t""",
    "age_groups_sale": """SELECT band3 AS age_group, COUNT(*) AS customer_count
      FROM sold WHERE age IS NOT NULL GROUP BY 1""",
    "customers_by_country": f"""SELECT country, {uniq('customer_id')} AS unique_customers
      FROM sold GROUP BY country""",
    "yearly_product_sales": f"""SELECT year, product_name, {money()} AS total_sales,
      COUNT(*) AS transaction_count FROM sold GROUP BY 1, 2""",
    "top5_products": top("product_name", "sold", 5, "total_sales"),
    "top5_product_years": years_of_top("product_name", ", COUNT(*) AS transaction_count"),
    "recent_top_products": top("product_name", "sold", 8, "total_sales", f"WHERE year >= {MIN_YEAR}"),
    "yearly_country_sales": f"SELECT year, country, {money()} AS total_sales FROM sold GROUP BY 1, 2",
    "top5_countries": top("country", "sold", 5, "total_sales"),
    "top5_country_years": years_of_top("country", ""),
    "product_country_recent": f"""SELECT country, product_name, {money()} AS total_sales FROM sold
      WHERE year >= {MIN_YEAR} GROUP BY 1, 2""",
    "product_country_matrix": f""", r AS (SELECT * FROM sold WHERE year >= {MIN_YEAR}),
      p AS ({top('product_name', 'r', 8, 't')}), c AS ({top('country', 'r', 6, 't')})
      SELECT p.product_name, c.country, CAST(COALESCE(SUM(r.amt), 0) AS DECIMAL(38,2)) AS total_sales
      FROM p CROSS JOIN c
      LEFT JOIN r ON r.product_name = p.product_name AND r.country = c.country GROUP BY 1, 2""",
    "month_of_year_sales": f"""SELECT month_text, month, {money()} AS total_sales,
      COUNT(*) AS transaction_count FROM sold GROUP BY 1, 2""",
    "weekday_sales": f"""SELECT dow_text AS day_of_week_text, dow AS day_of_week,
      {money()} AS total_sales, COUNT(*) AS transaction_count FROM sold GROUP BY 1, 2""",
    "age_country_matrix": """SELECT country,
      CAST(COALESCE(SUM(amt) FILTER (band3 = 'Under 25'), 0) AS DECIMAL(38,2)) AS under_25,
      CAST(COALESCE(SUM(amt) FILTER (band3 = '25-40'), 0) AS DECIMAL(38,2)) AS age_25_40,
      CAST(COALESCE(SUM(amt) FILTER (band3 = '41+'), 0) AS DECIMAL(38,2)) AS age_41_plus
      FROM sold WHERE age IS NOT NULL GROUP BY country""",
    "top10_products": f"""SELECT product_name, {money()} AS total_revenue, COUNT(*) AS transaction_count,
      {avg()} AS avg_transaction_value, {uniq('customer_id')} AS unique_customers
      FROM sold GROUP BY 1 ORDER BY total_revenue DESC, product_name LIMIT 10""",
    "yearly_customers": f"""SELECT year, {uniq('customer_id')} AS unique_customers,
      {money()} AS total_revenue FROM sold GROUP BY 1""",
}

DAILY_SQL = {
    "daily_breakdown": SALE_DAYS,
    "daily_extremes": f", d AS ({SALE_DAYS})\n"
    + pick(
        "d",
        ["sale_date", "day_name"],
        {
            f"{word}_{m}": (m, side)
            for m in ("revenue", "transactions", "avg_value")
            for word, side in (("best", "max"), ("worst", "min"))
        },
    ),
    "weekday_profile": f", d AS ({SALE_DAYS})\n{BY_WEEKDAY}",
    "weekday_vs_weekend": f""", d AS ({SALE_DAYS}), w AS ({BY_WEEKDAY}),
      x AS (SELECT {week('avg_revenue')} AS weekday_revenue, {weekend('avg_revenue')} AS weekend_revenue,
        {week('avg_transactions')} AS weekday_transactions,
        {weekend('avg_transactions')} AS weekend_transactions FROM w)
      SELECT *, (weekend_revenue / NULLIF(weekday_revenue, 0) - 1.0) * 100.0 AS revenue_change_pct,
        (weekend_transactions / NULLIF(weekday_transactions, 0) - 1.0) * 100.0
          AS transactions_change_pct FROM x""",
    "day_concentration": concentration(f"({SALE_DAYS})", "revenue"),
    "top5_days": sale_days(5, "DESC"),
    "bottom5_days": sale_days(5, "ASC"),
    "calendar_month_sales": f"""SELECT year, month, month_name, COUNT(*) AS transactions,
      {money()} AS revenue, {avg()} AS avg_value, {uniq('customer_id')} AS customers
      FROM sold GROUP BY 1, 2, 3""",
    "weekday_recommendation": f""", d AS ({SALE_DAYS}), w AS ({BY_WEEKDAY})
      SELECT (SELECT day_name FROM w ORDER BY avg_revenue DESC, day_name LIMIT 1) AS best_weekday,
        (SELECT day_name FROM w ORDER BY avg_revenue, day_name LIMIT 1) AS worst_weekday,
        (SELECT {weekend('avg_revenue')} > {week('avg_revenue')} FROM w) AS weekend_stronger""",
}

DISCOUNT = {
    "hour_extremes": f""", h AS ({HOURLY}),
      g AS (SELECT CAST(MAX(total_revenue) - MIN(total_revenue) AS DECIMAL(38,2)) AS revenue_gap FROM h)
      SELECT x.*, g.revenue_gap FROM (
        (SELECT 'best' AS place, * FROM h ORDER BY total_revenue DESC, hour LIMIT 1)
        UNION ALL (SELECT 'worst' AS place, * FROM h ORDER BY total_revenue, hour LIMIT 1)) x CROSS JOIN g""",
    "hourly_discount": f"""SELECT hour, discount_period, COUNT(*) AS transactions, {money()} AS revenue
      {DISCOUNTED} GROUP BY 1, 2""",
    "top_discount_hours": top("hour", "sold", 5, "revenue", "WHERE discount_applied"),
    "discount_period_breakdown": f"""SELECT discount_period, COUNT(*) AS transactions,
      {money()} AS revenue, {avg()} AS avg_transaction, {uniq('customer_id')} AS customers,
      COUNT(DISTINCT day) AS active_days, {div('SUM(amt)', 'COUNT(DISTINCT day)')} AS revenue_per_day
      {DISCOUNTED} GROUP BY 1""",
    "discount_products": f"""SELECT product_name, discount_period, COUNT(*) AS transactions,
      {money()} AS revenue, {avg()} AS avg_price {DISCOUNTED} GROUP BY 1, 2
      ORDER BY revenue DESC, product_name, discount_period LIMIT 15""",
    "discount_countries": f"""SELECT country, COUNT(*) AS discount_transactions,
      {money()} AS discount_revenue, {avg()} AS avg_discount_price,
      {uniq('customer_id')} AS discount_customers {DISCOUNTED} GROUP BY 1""",
    "yearly_discounts": f"""SELECT year, COUNT(*) AS discount_transactions,
      {money()} AS discount_revenue, {uniq('customer_id')} AS discount_customers
      {DISCOUNTED} AND year >= {MIN_YEAR} GROUP BY 1""",
    "discount_impact": f""", d AS (SELECT COUNT(*) AS n, SUM(amt) AS r FROM sold WHERE discount_applied),
      g AS (SELECT COUNT(*) AS n, SUM(amt) AS r FROM sold WHERE NOT discount_applied)
      SELECT d.n AS discount_transactions, g.n AS regular_transactions,
        CAST(d.r AS DECIMAL(38,2)) AS discount_revenue, CAST(g.r AS DECIMAL(38,2)) AS regular_revenue,
        {pct('d.n', 'd.n + g.n')} AS discount_adoption_pct,
        {pct('d.r', 'd.r + g.r')} AS discount_revenue_pct,
        CAST(d.n AS DOUBLE) * (CAST(g.r AS DOUBLE) / g.n) - CAST(d.r AS DOUBLE) AS revenue_sacrifice
      FROM d CROSS JOIN g WHERE d.n > 0 AND g.n > 0""",
    "best_discount_efficiency": f"""SELECT discount_period, {money()} AS revenue,
      COUNT(DISTINCT day) AS active_days, {div('SUM(amt)', 'COUNT(DISTINCT day)')} AS revenue_per_day
      {DISCOUNTED} GROUP BY 1 ORDER BY revenue_per_day DESC, discount_period LIMIT 1""",
}

RETAIL = {
    "overall_summary": f"""SELECT COUNT(*) AS total_transactions, {uniq('customer_id')} AS unique_customers,
      {uniq('receipt_number')} AS unique_receipts, {uniq('product_id')} AS unique_products,
      MIN(date) AS start_date, MAX(date) AS end_date, {money()} AS total_revenue_sgd,
      {avg()} AS avg_amount_per_item, {avg('receipt_total_sgd')} AS avg_receipt_total FROM e""",
    "first_rows": f"""SELECT date, customer_number, receipt_number, product_name, units_sold,
      unit_price_sgd, total_amount_per_product_sgd, receipt_total_sgd, dow_text AS day_of_week_text,
      month_text FROM e ORDER BY date, {ROW_ID} LIMIT 10""",
    "top5_products_all": f"""SELECT product_name, {PRODUCT} FROM e GROUP BY product_id, product_name
      ORDER BY total_revenue DESC, product_id, product_name LIMIT 5""",
    "weekday_receipts": f"""SELECT dow_text AS day_of_week_text, {money()} AS total_revenue,
      {uniq('receipt_number')} AS num_receipts, {avg('receipt_total_sgd')} AS avg_receipt_value
      FROM e GROUP BY dow_text, dow""",
    "month_receipts": f"""SELECT month_text, {money()} AS total_revenue,
      {uniq('receipt_number')} AS num_receipts, {uniq('customer_id')} AS unique_customers
      FROM e GROUP BY month_text, month""",
    "hour_receipts": f"""SELECT hour, {money()} AS total_revenue, COUNT(*) AS transactions,
      {avg('receipt_total_sgd')} AS avg_receipt_value FROM e GROUP BY hour""",
    "age_group_sales": f"""SELECT {BAND3N} AS age_group, {FOUR},
      {uniq('receipt_number')} AS unique_receipts, {avg('receipt_total_sgd')} AS avg_receipt_value,
      MIN(age) AS min_age, MAX(age) AS max_age, {avg('age')} AS avg_age
      FROM e WHERE age IS NOT NULL GROUP BY 1""",
    "age_group_share": f"""SELECT {BAND3N} AS age_group, {money()} AS total_revenue,
      {pct('SUM(amt)', '(SELECT SUM(amt) FROM e WHERE age IS NOT NULL)')} AS revenue_percentage
      FROM e WHERE age IS NOT NULL GROUP BY 1""",
    "top3_products_by_age": f"""SELECT age_group, product_name, total_revenue, total_units_sold,
        transactions, avg_price
      FROM (SELECT {BAND3N} AS age_group, product_id, product_name, {PRODUCT}
        FROM e WHERE age IS NOT NULL GROUP BY 1, 2, 3)
      QUALIFY ROW_NUMBER() OVER (PARTITION BY age_group
        ORDER BY total_revenue DESC, product_id, product_name) <= 3""",
}

INSIGHTS = {
    "age_share_sale": f"""SELECT band3 AS age_group, COUNT(*) AS transactions, {money()} AS revenue,
      ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM sold), 2) AS percentage
      FROM sold WHERE age IS NOT NULL GROUP BY 1""",
    "top5_recent_products": f"""SELECT product_name, {money()} AS revenue, COUNT(*) AS transactions
      FROM sold WHERE year >= {MIN_YEAR} GROUP BY 1 ORDER BY revenue DESC, product_name LIMIT 5""",
    "country_ranking": f"""SELECT *, ROW_NUMBER() OVER (ORDER BY revenue DESC, country) AS position
      FROM (SELECT country, {money()} AS revenue, COUNT(*) AS transactions,
        {uniq('customer_id')} AS customers FROM sold GROUP BY country)""",
    "top3_months": f"""SELECT month_text, {money()} AS revenue, COUNT(*) AS transactions FROM sold
      GROUP BY month_text, month ORDER BY revenue DESC, month LIMIT 3""",
    "value_stats": f"""SELECT {avg()} AS avg_transaction, MIN(amt) AS min_transaction,
      MAX(amt) AS max_transaction,
      PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY CAST(amt AS DOUBLE)) AS median_transaction FROM sold""",
    "yearly_growth": f"""SELECT year, {money()} AS revenue, {uniq('customer_id')} AS customers
      FROM sold WHERE year >= {MIN_YEAR} GROUP BY 1""",
    "kpis": f"""SELECT COUNT(*) AS total_sales, {money()} AS total_revenue,
      {uniq('customer_id')} AS total_customers, {uniq('product_name')} AS total_products,
      {uniq('country')} AS total_countries FROM sold""",
}

_LABELLED = f"{avg()} AS avg_sales, {money()} AS total_sales, COUNT(*) AS count"

MISC = {
    "weekday_stats": f"SELECT dow_text AS day_of_week_text, {_LABELLED} FROM e GROUP BY dow_text, dow",
    "month_stats": f"SELECT month_text, {_LABELLED} FROM e GROUP BY month_text, month",
    "top5_rows": f"""SELECT date, total_amount_per_product_sgd, dow_text AS day_of_week_text, month_text
      FROM e ORDER BY amt DESC, {ROW_ID} LIMIT 5""",
    "sales_by_income": f"""SELECT customer_number, income, {money()} AS total_sales
      FROM e GROUP BY 1, 2""",
    "older_than_30": f"SELECT {COLUMNS} FROM e WHERE age > 30 ORDER BY date, {ROW_ID} LIMIT 5",
    "discount_health": f"""SELECT COUNT(*) AS total_records, {uniq('customer_id')} AS customers,
      {uniq('product_name')} AS products, {uniq('country')} AS countries,
      COUNT(*) FILTER (discount_applied) AS discount_transactions,
      COUNT(*) > 3000000 AS sufficient_data FROM e""",
    "discount_counts": """SELECT discount_period, COUNT(*) AS count FROM e
      WHERE discount_applied GROUP BY 1""",
    "projected_columns": """SELECT date, product_name, units_sold, unit_price_sgd,
      total_amount_per_product_sgd, receipt_total_sgd, country, city, income FROM e""",
}

REPORT_SQL = {**API, **EXPORTS, **SUMMARY, **DAILY_SQL, **DISCOUNT, **RETAIL, **INSIGHTS, **MISC}
