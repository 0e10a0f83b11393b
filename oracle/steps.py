"""SQL of the operator queries."""

from oracle.base import avg, money, uniq, whole
from oracle.reports import BAND3N, BAND6, CAREER, COLUMNS, EXPORTS, API, INCOME, PERIOD, ROW_ID, top

ALL = f"SELECT {COLUMNS} FROM sales"
KEY = "CAST(transaction_id AS BIGINT)"


def figures(where: str, table: str = "e") -> str:
    return f"SELECT country, COUNT(*) AS n, {money()} AS total FROM {table} WHERE {where} GROUP BY 1"


DIRTY = f""", dirty AS (SELECT
  CASE WHEN {KEY} % 13 = 0 THEN '01/02/2024' ELSE CAST(date AS VARCHAR) END AS date,
  transaction_id, transaction_desc, customer_id,
  CASE WHEN {KEY} % 11 = 0 THEN 'n/a' WHEN {KEY} % 7 = 0 THEN CAST(age AS VARCHAR) || '.7'
    ELSE CAST(age AS VARCHAR) END AS age,
  gender, receipt_number, product_id, product_name,
  CASE WHEN {KEY} % 17 = 0 THEN '' ELSE CAST(units_sold AS VARCHAR) END AS units_sold,
  CASE WHEN {KEY} % 19 = 0 THEN '1.005' ELSE CAST(unit_price_sgd AS VARCHAR) END AS unit_price_sgd,
  CASE WHEN {KEY} % 23 = 0 THEN '99999999999.00'
    ELSE CAST(total_amount_per_product_sgd AS VARCHAR) END AS total_amount_per_product_sgd,
  CAST(receipt_total_sgd AS VARCHAR) AS receipt_total_sgd, country_id, country, city,
  CASE WHEN {KEY} % 29 = 0 THEN 'unknown' ELSE CAST(income AS VARCHAR) END AS income FROM sales)"""


def safe(name: str) -> str:
    return f"COALESCE(TRY_CAST({name} AS DECIMAL(10,2)), 0) AS {name}"


def sanitized(reset: bool) -> str:
    amounts = ["unit_price_sgd", "total_amount_per_product_sgd", "receipt_total_sgd"]
    money_columns = ", ".join(
        f"CAST(0 AS DECIMAL(10,2)) AS {c}" if reset else safe(c) for c in amounts
    )
    return f"""{DIRTY}
      SELECT TRY_CAST(date AS TIMESTAMP) AS date, transaction_id, transaction_desc, customer_id,
        COALESCE(TRY_CAST(age AS INTEGER), 0) AS age, gender, receipt_number, product_id,
        product_name, COALESCE(TRY_CAST(units_sold AS INTEGER), 0) AS units_sold, {money_columns},
        country_id, country, city, {safe('income')} FROM dirty"""


STAGED = ", ".join(f"CAST({c.strip()} AS VARCHAR) AS {c.strip()}" for c in COLUMNS.split(","))
WITH_DEFAULTS = COLUMNS.replace("city", "'default_city' AS city").replace(
    "income", "'default_income' AS income"
)

STEP_SQL = {
    "scan_sales": ALL,
    "scan_stored": ALL,
    "sample_rows": f"SELECT {COLUMNS} FROM sales ORDER BY date, {ROW_ID} LIMIT 10",
    "csv_export_scan": ALL,
    "csv_split_rebuild": ALL,
    "csv_to_parquet_parts": ALL,
    "parquet_rebuild_csv": ALL,
    "manifest_rebuild_csv": ALL,
    "manifest_rebuild_parquet": ALL,
    "csv_pack_unpack": ALL,
    "append_rerun": f"""SELECT CASE WHEN {KEY} % 97 <> 0 THEN date END AS date, {COLUMNS.split(',', 1)[1]}
      FROM sales""",
    "csv_line_breaks": """SELECT transaction_id, product_id,
      '"a,' || chr(10) || product_name || chr(10) || '"' || city AS label FROM sales""",
    "json_cities": "SELECT DISTINCT city AS name, country, country_id FROM sales",
    "chunk_ingest": ALL,
    "chunk_ingest_incremental": ALL,
    "view_saved": API["hourly_distribution"],
    "export_bundle_products": EXPORTS["product_performance"],
    "clean_ensure_columns": f"SELECT {WITH_DEFAULTS} FROM sales",
    "clean_sanitize": sanitized(False),
    "clean_reset_amounts": sanitized(True),
    "clean_type_map": f"""{DIRTY}
      SELECT transaction_id, CASE WHEN regexp_full_match(date, '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d')
          THEN TRY_CAST(date AS TIMESTAMP) END AS sale_date,
        TRY_CAST(units_sold AS BIGINT) AS qty, TRY_CAST(unit_price_sgd AS DOUBLE) AS price,
        product_name AS label, country AS other FROM dirty""",
    "type_map_json": f"""{DIRTY}
      SELECT transaction_id, CASE WHEN regexp_full_match(date, '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d')
          THEN TRY_CAST(date AS TIMESTAMP) END AS sale_date,
        TRY_CAST(units_sold AS BIGINT) AS qty, TRY_CAST(unit_price_sgd AS DOUBLE) AS price,
        product_name AS label, country AS other FROM dirty""",
    "stage_strings": f"SELECT {STAGED} FROM sales",
    "staged_to_typed": ALL,
    "upsert_by_key": """SELECT DISTINCT concat('countries_', country_id) AS key, 'character 2' AS value,
      country_id AS alternative_key,
      CASE WHEN country >= 'NATION_1' AND country <= 'NATION_2' THEN country || ' (new)' ELSE country END
        AS alternative_value FROM sales""",
    "cyclic_features": """SELECT dow AS day_of_week, month, COUNT(*) AS n,
      ROUND(sin(2 * pi() * dow / 7), 12) + 0.0 AS day_of_week_sin,
      ROUND(cos(2 * pi() * dow / 7), 12) + 0.0 AS day_of_week_cos,
      ROUND(sin(2 * pi() * month / 12), 12) + 0.0 AS month_sin,
      ROUND(cos(2 * pi() * month / 12), 12) + 0.0 AS month_cos FROM e GROUP BY dow, month""",
    "calendar_columns": f"""SELECT {ROW_ID}, dow_text AS day_of_week_text, month_text, hour,
      dow AS day_of_week, month, year FROM e""",
    "discount_calendar": """SELECT CAST(prio AS INTEGER) AS prio, discount_period, start_d, end_d FROM periods
      WHERE y >= (SELECT MIN(year) FROM e) AND y <= (SELECT MAX(year) FROM e) + 1""",
    "discount_tagged": f"SELECT date, {ROW_ID}, discount_period, discount_applied FROM e",
    "geo_enriched": f"""SELECT {ROW_ID}, city,
      CASE WHEN country NOT IN ('NATION_6', 'NATION_18') THEN country END AS country,
      CASE WHEN country NOT IN ('NATION_6', 'NATION_18') THEN country_id END AS country_id FROM e""",
    "daily_gap_filled": f""", x AS (SELECT day, COUNT(*) AS n, SUM(amt) AS r FROM e GROUP BY day)
      SELECT CAST(t.d AS DATE) AS sale_date, COALESCE(x.n, 0) AS transactions,
        CAST(COALESCE(x.r, 0) AS DECIMAL(38,2)) AS revenue
      FROM (SELECT unnest(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS d FROM x) t
      LEFT JOIN x ON x.day = CAST(t.d AS DATE)""",
    "valid_dates": f"""SELECT *, COALESCE(try_strptime(text, '%Y-%m-%d %H:%M:%S'),
        try_strptime(text, '%Y-%m-%d')) IS NOT NULL AS valid
      FROM (SELECT transaction_id, product_id, CASE
          WHEN {KEY} % 5 = 0 THEN strftime(date, '%Y-%m-%d')
          WHEN {KEY} % 7 = 0 THEN '2024-13-01' WHEN {KEY} % 11 = 0 THEN '01/02/2024'
          WHEN {KEY} % 13 = 0 THEN '' ELSE strftime(date, '%Y-%m-%d %H:%M:%S') END AS text FROM e)""",
    "age_bands": f"""SELECT age, COUNT(*) AS n, {BAND6} AS band6, ANY_VALUE(band3) AS band3,
      {BAND3N} AS band3n, {CAREER} AS career FROM e GROUP BY age""",
    "income_segments": f"""SELECT *, CASE segment WHEN 'Low Income (< 30k)' THEN 1
        WHEN 'Middle Income (30k-60k)' THEN 2 WHEN 'Upper Middle (60k-100k)' THEN 3
        WHEN 'High Income (>100k)' THEN 4 ELSE 5 END::BIGINT AS place
      FROM (SELECT income, COUNT(*) AS n, {INCOME} AS segment FROM e GROUP BY income)""",
    "hour_periods": f"""SELECT hour, dow >= 6 AS weekend, COUNT(*) AS n, {PERIOD} AS period
      FROM e GROUP BY 1, 2""",
    "filter_conjunction": figures(
        "date >= '1996-02-10' AND date <= '2000-03-05' AND age >= 20 AND age <= 60"
    ),
    "filter_text": figures("gender = 'F' AND country = 'NATION_6'"),
    "filter_date_range": figures("day BETWEEN DATE '1997-05-20' AND DATE '1997-06-10'"),
    "filter_day": figures("day = DATE '1995-06-19'"),
    "filter_between": figures("income >= 30000 AND income <= 60000"),
    "filter_from_year": figures("year >= 1999"),
    "filter_known": figures("age IS NOT NULL AND income IS NOT NULL"),
    "filter_in_list": figures("country IN ('NATION_18', 'NATION_6', 'NATION_3')"),
    "filter_discounted": figures("discount_applied"),
    "filter_thresholds": figures("amt >= 20 AND age > 30 AND income > 50000"),
    "filter_hour": figures("hour = 12"),
    "filter_band": figures("age >= 25 AND age <= 40"),
    "overall_of_nothing": f"""SELECT COUNT(*) AS n, {money()} AS total, {whole('units_sold')} AS units,
      {avg()} AS average, {uniq('customer_id')} AS customers FROM e WHERE country = 'ATLANTIS'""",
    "medians": """SELECT COUNT(*) AS n, median(CAST(amt AS DOUBLE)) AS median_amount,
      median(CAST(income AS DOUBLE)) AS median_income, median(CAST(age AS DOUBLE)) AS median_age FROM e""",
    "deciles": f"""SELECT {ROW_ID}, NTILE(10) OVER (ORDER BY amt,
      substr(md5(concat_ws('|', transaction_id, product_id, customer_id, receipt_number)), 1, 15))
      AS decile FROM e""",
    "page_by_key": f"SELECT {COLUMNS} FROM sales ORDER BY date DESC, {ROW_ID} LIMIT 50 OFFSET 100",
    "rank_with_gaps": """SELECT *, RANK() OVER (ORDER BY cities DESC) AS place
      FROM (SELECT product_name, COUNT(DISTINCT city) AS cities FROM e GROUP BY 1)""",
    "top_per_country": f"""SELECT country, product_name, {money()} AS revenue FROM e GROUP BY 1, 2
      QUALIFY ROW_NUMBER() OVER (PARTITION BY country ORDER BY SUM(amt) DESC, product_name) <= 3""",
    "country_at_extremes": f""", c AS (SELECT country, {avg()} AS average FROM e GROUP BY 1)
      (SELECT *, 'max' AS side FROM c ORDER BY average DESC, country LIMIT 1) UNION ALL
      (SELECT *, 'min' AS side FROM c ORDER BY average, country LIMIT 1)""",
    "trimmed_cells": f"""SELECT product_name, country, {money()} AS revenue FROM sold
      WHERE product_name IN (SELECT product_name FROM ({top('product_name', 'sold', 5, 'r')}))
        AND country IN (SELECT country FROM ({top('country', 'sold', 4, 'r')})) GROUP BY 1, 2""",
}
