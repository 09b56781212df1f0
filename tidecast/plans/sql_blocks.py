"""DuckDB SQL fragments shared by the oracle queries.

These only feed the correctness oracle; the Spark side never parses them.
"""

from __future__ import annotations

from ..operators.aggregate import PIVOTS

# Distinct pivot keys of the driver tables (p_type, c_mktsegment,
# o_orderpriority, l_returnflag, o_orderstatus), used to spell the oracle's
# wide columns.  The Spark side discovers them from the data.
TEST_PIVOT_VALUES = {
    "category": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "customer_segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "delivery_status_x": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "sentiment": ["A", "N", "R"],
    "payment_method": ["F", "O", "P"],
}

FACTS_CTE = """
per_order AS (
  SELECT l_orderkey, sum(l_quantity) AS quantity, min(l_shipdate) AS first_ship,
         avg(l_discount) AS rating, min(p_type) AS category, min(l_returnflag) AS sentiment
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey),
facts AS (
  SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_totalprice AS order_total,
         quantity, o_custkey AS customer_id_x,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(first_ship AS DATE)) AS DOUBLE)
           AS delivery_time_minutes,
         rating, category, c_mktsegment AS customer_segment,
         o_orderpriority AS delivery_status_x, sentiment, o_orderstatus AS payment_method
  FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey
       LEFT JOIN customer ON o_custkey = c_custkey)"""


def period_sql(freq: str, ts: str = "order_date") -> str:
    if freq == "daily":
        return f"CAST({ts} AS DATE)"
    if freq == "weekly":
        return f"CAST(date_trunc('week', {ts}) AS DATE)"
    return f"strftime({ts}, '%Y-%m')"


def date_sql(freq: str, period: str = "period") -> str:
    if freq == "monthly":
        return f"CAST(strptime({period} || '-01', '%Y-%m-%d') AS DATE)"
    return f"CAST({period} AS DATE)"


def f(expr: str) -> str:
    """Double output at the registry's single precision."""
    return f"CAST({expr} AS FLOAT)"


BASE_AGG_SQL = [
    ("order_count", "count(order_id)", False),
    ("total_sales", "coalesce(sum(order_total), 0)", True),
    ("avg_order_value", "coalesce(avg(order_total), 0)", True),
    ("std_order_value", "coalesce(stddev_samp(order_total), 0)", True),
    ("total_quantity", "coalesce(sum(quantity), 0)", True),
    ("avg_quantity", "coalesce(avg(quantity), 0)", True),
    ("unique_customers", "count(DISTINCT customer_id_x)", False),
    ("avg_delivery_time", "coalesce(avg(delivery_time_minutes), 0)", True),
    ("std_delivery_time", "coalesce(stddev_samp(delivery_time_minutes), 0)", True),
    ("avg_rating", "coalesce(avg(rating), 0)", True),
]


def pivot_sql_columns(specs=PIVOTS, cast: bool = False) -> list[tuple[str, str]]:
    """(column name, aggregate SQL) for every pivot cell of the test data."""
    out = []
    for spec in specs:
        for v in TEST_PIVOT_VALUES[spec.column]:
            lit = v.replace("'", "''")
            if spec.measure == "sum":
                e = f"coalesce(sum(CASE WHEN {spec.column} = '{lit}' THEN order_total END), 0)"
            else:
                e = f"CAST(count(CASE WHEN {spec.column} = '{lit}' THEN order_id END) AS DOUBLE)"
            out.append((spec.name(v), f(e) if cast else e))
    return out


def period_table_sql(freq: str, pivots: bool, month_as_date: bool, cast: bool = True) -> str:
    """SELECT for the period table (A1, optionally J1) over the ``facts`` CTE."""
    aggs = [f"{(f(e) if (cast and dbl) else e)} AS {name}" for name, e, dbl in BASE_AGG_SQL]
    piv = pivot_sql_columns(cast=cast) if pivots else []
    aggs += [f'{e} AS "{n}"' for n, e in piv]
    inner = (f"SELECT {period_sql(freq)} AS period, {', '.join(aggs)} FROM facts "
             f"WHERE order_date IS NOT NULL GROUP BY 1")
    cols = [n for n, _, _ in BASE_AGG_SQL]
    dd = "CAST(d AS VARCHAR)" if cast else "d"
    per = "period" if freq == "monthly" or not cast else "CAST(period AS VARCHAR) AS period"
    month = dd if month_as_date else "CAST(month(d) AS BIGINT)"
    sel = (per + ", " + ", ".join(cols) + f", {dd} AS date, CAST(isodow(d) - 1 AS BIGINT) AS day_of_week, "
           f"{month} AS month, CAST(weekofyear(d) AS BIGINT) AS week_of_year")
    if piv:
        sel += ", " + ", ".join(f'"{n}"' for n, _ in piv)
    if pivots and freq == "monthly":
        sel += ", period AS year_month"
    return f"SELECT {sel} FROM (SELECT *, {date_sql(freq)} AS d FROM ({inner}) a) b"


def cast_wrap(sql: str, double_cols=(), date_cols=()) -> str:
    """Doubles -> FLOAT and dates -> VARCHAR on the named columns of a query."""
    rep = [f'CAST("{c}" AS FLOAT) AS "{c}"' for c in double_cols]
    rep += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in date_cols]
    return f"SELECT * REPLACE ({', '.join(rep)}) FROM ({sql}) q" if rep else sql


def with_facts(body: str, extra_ctes: str = "") -> str:
    ctes = FACTS_CTE + (",\n" + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"
