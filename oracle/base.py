"""Common table expressions: the sales table, its calendar and discount columns."""

SALES = """
sales AS (
  SELECT o.o_orderdate + to_hours(CAST((l.l_orderkey * 7 + l.l_linenumber * 5) % 24 AS INTEGER)) AS date,
    CAST(l.l_orderkey * 10 + l.l_linenumber AS VARCHAR) AS transaction_id,
    CASE l.l_returnflag WHEN 'N' THEN 'Product Sale' WHEN 'R' THEN 'Product Refund'
      ELSE 'Product Exchange' END AS transaction_desc,
    CAST(o.o_custkey AS VARCHAR) AS customer_id,
    CASE WHEN o.o_custkey % 97 = 0 THEN NULL
      ELSE CAST(16 + (o.o_custkey * 37) % 70 AS INTEGER) END AS age,
    CASE WHEN o.o_custkey % 101 = 0 THEN NULL WHEN o.o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
    CAST(l.l_orderkey AS VARCHAR) AS receipt_number,
    CAST(l.l_partkey AS VARCHAR) AS product_id,
    p.p_name AS product_name,
    CAST(l.l_quantity AS INTEGER) AS units_sold,
    CAST(p.p_retailprice AS DECIMAL(10,2)) AS unit_price_sgd,
    CAST(l.l_extendedprice AS DECIMAL(10,2)) AS total_amount_per_product_sgd,
    CAST(o.o_totalprice AS DECIMAL(10,2)) AS receipt_total_sgd,
    concat('C', lpad(CAST(n.n_nationkey + 1 AS VARCHAR), 3, '0')) AS country_id,
    n.n_name AS country,
    concat(n.n_name, '-', CAST(c.c_custkey % 3 AS VARCHAR)) AS city,
    CASE WHEN c.c_custkey % 89 = 0 THEN NULL
      WHEN c.c_custkey % 50 = 0 THEN CAST(60000.50 AS DECIMAL(10,2))
      ELSE CAST(20000 + (c.c_custkey * 977) % 130000 AS DECIMAL(10,2)) END AS income
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

CALENDAR = """
friday AS (
  SELECT y, CAST(make_date(y, 11, 1)
    + CAST((4 - (isodow(make_date(y, 11, 1)) - 1) + 7) % 7 + 21 AS INTEGER) AS DATE) AS d
  FROM (SELECT CAST(range AS INTEGER) AS y FROM range(1990, 2040))
),
periods AS (
  SELECT y, 1 AS prio, 'BLACKFRIDAY' AS discount_period, d AS start_d, d AS end_d FROM friday
  UNION ALL SELECT y, 2, 'CYBERMONDAY', CAST(d + 3 AS DATE), CAST(d + 3 AS DATE) FROM friday
  UNION ALL SELECT y, 3, 'NEWYEAR', make_date(y - 1, 12, 26), make_date(y, 1, 2) FROM friday
  UNION ALL SELECT y, 4, 'CHRISTMAS', make_date(y, 12, 1), make_date(y, 12, 26) FROM friday
),
cal AS (
  SELECT day, arg_min(discount_period, prio) AS discount_period
  FROM (SELECT prio, discount_period,
          CAST(unnest(generate_series(start_d, end_d, INTERVAL 1 DAY)) AS DATE) AS day FROM periods)
  GROUP BY day
)"""

ENRICHED = """
e AS (
  SELECT s.*, s.total_amount_per_product_sgd AS amt, s.customer_id AS customer_number,
    CAST(s.date AS DATE) AS day,
    CAST(extract(hour FROM s.date) AS BIGINT) AS hour,
    CAST(isodow(s.date) AS BIGINT) AS dow,
    upper(strftime(s.date, '%a')) AS dow_text, dayname(s.date) AS day_name,
    CAST(extract(month FROM s.date) AS BIGINT) AS month,
    upper(strftime(s.date, '%b')) AS month_text, monthname(s.date) AS month_name,
    CAST(extract(year FROM s.date) AS BIGINT) AS year,
    cal.discount_period, cal.discount_period IS NOT NULL AS discount_applied,
    CASE WHEN s.age IS NULL THEN 'Unknown' WHEN s.age < 25 THEN 'Under 25'
      WHEN s.age < 41 THEN '25-40' ELSE '41+' END AS band3
  FROM sales s LEFT JOIN cal ON CAST(s.date AS DATE) = cal.day
),
sold AS (SELECT * FROM e WHERE transaction_desc = 'Product Sale')"""


def with_sales(body: str) -> str:
    """Prefix a query with the tables it may read. A body that starts with a
    comma adds tables of its own."""
    body = body.strip()
    sep = "" if body.startswith(",") else "\n"
    return f"WITH {SALES.strip()},{CALENDAR},{ENRICHED}{sep}{body}"


def avg(x: str = "amt") -> str:
    return f"CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0)"


def money(x: str = "amt") -> str:
    return f"CAST(SUM({x}) AS DECIMAL(38,2))"


def whole(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def uniq(x: str) -> str:
    return f"COUNT(DISTINCT {x})"


def div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def pct(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) * 100.0 / NULLIF(CAST({b} AS DOUBLE), 0)"


def pick(table: str, keys: list[str], wanted: dict[str, tuple[str, str]], where: str = "") -> str:
    """One sorted LIMIT 1 per highlight."""
    parts = []
    for name, (measure, side) in wanted.items():
        cond = f"WHERE {measure} IS NOT NULL" + (f" AND {where}" if where else "")
        order = "DESC" if side == "max" else "ASC"
        parts.append(
            f"(SELECT '{name}' AS highlight, {', '.join(keys)}, CAST({measure} AS DOUBLE) AS value "
            f"FROM {table} {cond} ORDER BY {measure} {order}, {', '.join(keys)} LIMIT 1)"
        )
    return "\nUNION ALL\n".join(parts)
