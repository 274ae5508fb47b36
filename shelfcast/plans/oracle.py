"""SQL for the queries of the catalogue, written independently of the operators.

Each statement reads the Parquet tables as views. Dates, counts and calendar parts are
cast to the types the DataFrame queries return.
"""

from __future__ import annotations

_LINES = """
lines AS (
  SELECT l_orderkey AS "Order ID", o_custkey AS "Customer ID", l_partkey AS "Product ID",
    CAST(o_orderdate AS DATE) AS "Order Date", CAST(l_shipdate AS DATE) AS "Ship Date",
    o_orderpriority AS "Ship Mode", c_mktsegment AS "Segment",
    n_name AS "City", n_name AS "State", r_name AS "Region",
    p_type AS "Category", p_brand AS "Sub-Category", p_name AS "Product Name",
    CAST(TRUNC(l_quantity) AS INTEGER) AS "Quantity",
    CAST(l_discount AS DECIMAL(9,4)) AS "Discount",
    CAST(ROUND(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4)) AS "Sales",
    CAST(ROUND(l_extendedprice * (0.08 - l_discount), 4) AS DECIMAL(18,4)) AS "Profit"
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
)"""

_CHOSEN = """
chosen AS (
  SELECT * FROM lines
  WHERE "Order Date" BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'
    AND "Category" IN ('ECONOMY', 'STANDARD', 'PROMO')
    AND "Region" IN ('ASIA', 'EUROPE')
    AND "Segment" IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
)"""

_ONE_PRODUCT = """
one AS (SELECT * FROM lines WHERE "Product ID" = 42)"""

_SUMS = """
    CAST(SUM("Sales") AS DOUBLE) AS "Sales",
    CAST(SUM("Quantity") AS BIGINT) AS "Quantity",
    CAST(SUM("Profit") AS DOUBLE) AS "Profit",
    CAST(COUNT(DISTINCT "Order ID") AS BIGINT) AS "Orders",
    CAST(COUNT(DISTINCT "Customer ID") AS BIGINT) AS "Customers" """


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n" + select


def _label(period: str) -> str:
    return {
        "day": '"Order Date"',
        "week": "CAST(date_trunc('week', \"Order Date\") + INTERVAL 6 DAY AS DATE)",
        "month": "CAST(date_trunc('month', \"Order Date\") AS DATE)",
    }[period]


def _step(period: str) -> str:
    return {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[period]


def _filled(period: str, columns: dict[str, str], source: str = "lines", key: str | None = None) -> str:
    """CTEs ``found`` (aggregates), ``spine`` (all labels) and ``filled`` (zeros in gaps)."""
    keys = f'"{key}", ' if key else ""
    aggregates = ",\n    ".join(f'{sql} AS "{name}"' for name, sql in columns.items())
    on = 's."Date" = f."Date"' + (f' AND s."{key}" = f."{key}"' if key else "")
    values = ", ".join(f'COALESCE(f."{c}", 0) AS "{c}"' for c in columns)
    group = "GROUP BY ALL"
    return f"""
found AS (
  SELECT {keys}{_label(period)} AS "Date",
    {aggregates}
  FROM {source} {group}
),
spine AS (
  SELECT {keys}CAST(UNNEST(generate_series(first_day, last_day, {_step(period)})) AS DATE) AS "Date"
  FROM (SELECT {keys}CAST(MIN("Date") AS TIMESTAMP) AS first_day,
      CAST(MAX("Date") AS TIMESTAMP) AS last_day FROM found {group})
),
filled AS (
  SELECT {f's."{key}", ' if key else ''}s."Date", {values}
  FROM spine s LEFT JOIN found f ON {on}
)"""


_COLUMNS = {
    "Sales": 'CAST(SUM("Sales") AS DOUBLE)',
    "Quantity": 'CAST(SUM("Quantity") AS BIGINT)',
    "Profit": 'CAST(SUM("Profit") AS DOUBLE)',
    "Orders": 'CAST(COUNT(DISTINCT "Order ID") AS BIGINT)',
    "Customers": 'CAST(COUNT(DISTINCT "Customer ID") AS BIGINT)',
}
_DAILY = {**_COLUMNS, "Avg_Discount": 'CAST(SUM("Discount") AS DOUBLE) / COUNT(*)'}
_SALES = {"Sales": _COLUMNS["Sales"]}
_SALES_PROFIT = {"Sales": _COLUMNS["Sales"], "Profit": _COLUMNS["Profit"]}

_ALL_FILLED = "SELECT * FROM filled"


def _group_summary(key: str) -> str:
    return _with(
        _LINES,
        select=f"""
SELECT "{key}", "Sales", "Profit", "Quantity", "Orders",
  "Profit" / "Sales" * 100 AS "Profit_Margin",
  ROUND("Sales" / SUM("Sales") OVER () * 100, 6) AS "Sales_Share"
FROM (SELECT "{key}", {_SUMS} FROM lines GROUP BY "{key}")""",
    )


def _group_margin(key: str, source: str = "lines") -> str:
    return _with(
        _LINES,
        _CHOSEN,
        select=f"""
SELECT "{key}", "Sales", "Profit", "Orders", "Profit" / "Sales" * 100 AS "Profit_Margin"
FROM (SELECT "{key}", {_SUMS} FROM {source} GROUP BY "{key}")""",
    )


def _top_products(keys: list[str], source: str = "lines") -> str:
    names = ", ".join(f'"{k}"' for k in keys)
    return _with(
        _LINES,
        _CHOSEN,
        select=f"""
SELECT {names}, "Sales", "Profit", "Quantity" AS "Units_Sold",
  "Profit" / "Sales" * 100 AS "Margin_%"
FROM (SELECT {names}, {_SUMS} FROM {source} GROUP BY {names} ORDER BY "Sales" DESC, {names} LIMIT 10)""",
    )


def _headline(source: str) -> str:
    return _with(
        _LINES,
        _CHOSEN,
        select=f"""
SELECT "Sales" AS "Total_Sales", "Profit" AS "Total_Profit", "Orders" AS "Total_Orders",
  CASE WHEN "Sales" > 0 THEN "Profit" / "Sales" * 100 ELSE 0 END AS "Blended_Margin",
  CASE WHEN "Orders" > 0 THEN "Sales" / "Orders" ELSE 0 END AS "Avg_Order_Value"
FROM (SELECT {_SUMS} FROM {source})""",
    )


def _weekdays(condition: str) -> str:
    return _with(
        _LINES,
        select=f"""
SELECT CAST(d.i AS INTEGER) AS "Day_Order", d.name AS "Day_Name",
  CAST(SUM("Sales") AS DOUBLE) AS "Sales_Sum",
  CAST(SUM("Sales") AS DOUBLE) / COUNT("Sales") AS "Sales_Mean"
FROM (VALUES (0, 'Mon'), (1, 'Tue'), (2, 'Wed'), (3, 'Thu'), (4, 'Fri'), (5, 'Sat'), (6, 'Sun')) d(i, name)
LEFT JOIN (SELECT * FROM lines WHERE {condition}) l ON strftime(l."Order Date", '%a') = d.name
GROUP BY d.i, d.name""",
    )


_ORDERS = """
order_values AS (
  SELECT "Order ID", CAST(SUM("Sales") AS DOUBLE) AS "Order_Sales",
    CAST(SUM("Quantity") AS BIGINT) AS "Order_Quantity", MIN("Segment") AS "Segment"
  FROM lines GROUP BY "Order ID"
)"""

_LINE_COLUMNS = [
    "Order ID", "Order Date", "Ship Date", "Ship Mode",
    "Customer ID", "Segment", "City", "State", "Region",
    "Product ID", "Category", "Sub-Category", "Product Name",
    "Sales", "Quantity", "Discount", "Profit",
]

_NULL_COUNTS = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "Column", CAST(COUNT(*) FILTER (WHERE "{c}" IS NULL) AS BIGINT) AS "Nulls" FROM lines"""
    for c in _LINE_COLUMNS
)
_NULL_SUM = " + ".join(f'COUNT(*) FILTER (WHERE "{c}" IS NULL)' for c in _LINE_COLUMNS)

# ---- features --------------------------------------------------------------------------

_CALENDAR = """
  CAST(isodow("Date") - 1 AS INTEGER) AS day_of_week, CAST(day("Date") AS INTEGER) AS day_of_month,
  CAST(month("Date") AS INTEGER) AS month, CAST(quarter("Date") AS INTEGER) AS quarter,
  CAST(year("Date") AS INTEGER) AS year,
  CAST(CASE WHEN isodow("Date") >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
  CAST(dayofyear("Date") AS INTEGER) AS day_of_year, CAST(weekofyear("Date") AS INTEGER) AS week_of_year"""

_CYCLES = """
  ROUND(sin(2 * pi() * month("Date") / 12), 9) AS sin_month,
  ROUND(cos(2 * pi() * month("Date") / 12), 9) AS cos_month,
  ROUND(sin(2 * pi() * (isodow("Date") - 1) / 7), 9) AS sin_dow,
  ROUND(cos(2 * pi() * (isodow("Date") - 1) / 7), 9) AS cos_dow,
  ROUND(sin(2 * pi() * day("Date") / 31), 9) AS sin_day,
  ROUND(cos(2 * pi() * day("Date") / 31), 9) AS cos_day"""

_LAG_DAYS = (1, 2, 3, 7, 14, 21, 28, 30)
_WINDOW_DAYS = (7, 14, 30)


def _featured(key: str | None = None) -> str:
    """CTE ``featured``: raw lags and rolling statistics over ``filled``."""
    part = f'PARTITION BY "{key}" ' if key else ""
    lags = ", ".join(f'LAG("Sales", {k}) OVER w AS lag_{k}' for k in _LAG_DAYS)
    rolling = ", ".join(
        f"""CASE WHEN ROW_NUMBER() OVER w > {d} THEN {f}("Sales") OVER
    ({part}ORDER BY "Date" ROWS BETWEEN {d} PRECEDING AND 1 PRECEDING) END AS rolling_{name}_{d}"""
        for d in _WINDOW_DAYS
        for name, f in [("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX")]
    )
    names = f'"{key}", ' if key else ""
    return f"""
featured AS (
  SELECT {names}"Date", "Sales", ROW_NUMBER() OVER w AS rn, {lags}, {rolling}
  FROM filled WINDOW w AS ({part}ORDER BY "Date")
)"""


def _rolling_value(name: str, days: int) -> str:
    column = f"rolling_{name}_{days}"
    rounded = {"mean": f"ROUND(({column})::DECIMAL(28,10), 2)::DOUBLE", "std": f"ROUND({column}, 2)"}
    return f"{rounded.get(name, column)} AS {column}"


_ROLLING_ROUNDED = ", ".join(_rolling_value(n, d) for d in _WINDOW_DAYS for n in ("mean", "std", "min", "max"))
_LAG_NAMES = ", ".join(f"lag_{k}" for k in _LAG_DAYS)
_FEATURES = [_LINES, _filled("day", _SALES), _featured()]

_TEST = """
test_rows AS (
  SELECT "Date", "Sales" AS actual, rolling_mean_7, lag_7, rolling_mean_30 FROM featured WHERE rn > 30
  ORDER BY "Date" DESC LIMIT 90
)"""

_METRICS = """
  round_even(AVG(ABS(e)), 2) AS "MAE",
  round_even(SQRT(AVG(e * e)), 2) AS "RMSE",
  round_even(1 - SUM(e * e) / (VAR_POP(actual) * COUNT(*)), 4) AS "R2" """


def _metric_select(name: str, column: str, full: bool) -> str:
    error = f"SELECT *, actual - GREATEST({column}, 0) AS e FROM test_rows"
    if full:
        tail = """, round_even(SUM(ABS(e)) / (SUM(actual) + 1e-8) * 100, 2) AS "WAPE_%",
  round_even(COALESCE(AVG(CASE WHEN actual > 0 THEN ABS(e / actual) END) * 100, 0), 2) AS "MAPE_%" """
    else:
        tail = """, round_even(SUM(ABS(e)) / SUM(actual) * 100, 2) AS "WAPE_%" """
    return f"""SELECT '{name}' AS "Model", {_METRICS}{tail} FROM ({error})"""


_BASELINE = "Baseline (7-Day MA)"
_BASELINE_METRICS = _metric_select(_BASELINE, "rolling_mean_7", True)
_THREE = "\nUNION ALL\n".join(
    _metric_select(name, column, True)
    for name, column in [(_BASELINE, "rolling_mean_7"), ("Last Week", "lag_7"), ("30-Day MA", "rolling_mean_30")]
)

# Ridge in plain SQL: features as one list, scaled on the training rows; their cross products
# with the penalty on the diagonal and the target beside them; one sweep for each feature.
_ROLLING_NAMES = ", ".join(f"rolling_{n}_{d}" for d in _WINDOW_DAYS for n in ("mean", "std", "min", "max"))
_RIDGE = f"""
inputs AS (
  SELECT "Date", "Sales", ROW_NUMBER() OVER (ORDER BY "Date" DESC) AS back,
    [isodow("Date") - 1, day("Date"), month("Date"), quarter("Date"), year("Date"),
     CASE WHEN isodow("Date") >= 6 THEN 1 ELSE 0 END, dayofyear("Date"), weekofyear("Date"),
     sin(2 * pi() * month("Date") / 12), cos(2 * pi() * month("Date") / 12),
     sin(2 * pi() * (isodow("Date") - 1) / 7), cos(2 * pi() * (isodow("Date") - 1) / 7),
     sin(2 * pi() * day("Date") / 31), cos(2 * pi() * day("Date") / 31),
     {_LAG_NAMES}, {_ROLLING_NAMES}, rolling_mean_7 / (rolling_mean_30 + 1e-5), lag_1 - lag_7]::DOUBLE[] AS x
  FROM featured WHERE rn > 30),
cells AS (SELECT "Date", "Sales", back, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM inputs),
scales AS (SELECT j, AVG(v) AS m, STDDEV_POP(v) AS s FROM cells WHERE back > 90 GROUP BY j),
level AS (SELECT AVG("Sales") AS y0 FROM inputs WHERE back > 90),
scaled AS MATERIALIZED (
  SELECT "Date", "Sales", back, j, CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END AS z FROM cells JOIN scales USING (j)),
products AS (
  SELECT a.j AS i, b.j AS k, SUM(a.z * b.z) + CASE WHEN a.j = b.j THEN 10 ELSE 0 END AS g
  FROM scaled a JOIN scaled b USING ("Date") WHERE a.back > 90 GROUP BY 1, 2
  UNION ALL
  SELECT j, 1000, SUM(z * ("Sales" - y0)) FROM scaled, level WHERE back > 90 GROUP BY 1),
rows_of AS (SELECT i, list(g ORDER BY k) AS r FROM products GROUP BY i),
sweep(p, m) AS (
  SELECT 1, (SELECT list(r ORDER BY i) FROM rows_of)
  UNION ALL
  SELECT p + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = p
      THEN list_transform(m[p], lambda v: v / m[p][p])
      ELSE list_transform(list_zip(m[i], m[p]), lambda t: t[1] - m[i][p] * t[2] / m[p][p]) END)
  FROM sweep WHERE p <= len(m)),
weights AS (
  SELECT unnest(range(1, len(m) + 1)) AS j, unnest(list_transform(m, lambda r: r[len(r)])) AS w
  FROM (SELECT m FROM sweep ORDER BY p DESC LIMIT 1)),
ridge_rows AS (
  SELECT "Date", "Sales" AS actual, ANY_VALUE(y0) + SUM(z * w) AS ridge
  FROM scaled JOIN weights USING (j), level WHERE back <= 90 GROUP BY "Date", "Sales")"""
_RIDGE_METRICS = _metric_select("Ridge Regression", "ridge", True).replace("FROM test_rows", "FROM ridge_rows")


# The same for models of several series: a model for each value of ``mk``, over the rows of the
# series that have it. ``fitted`` says which rows are learned from.
def _calendar_list(day: str) -> str:
    angles = [(f"month({day})", 12), (f"(isodow({day}) - 1)", 7), (f"day({day})", 31)]
    waves = ", ".join(f"{wave}(2 * pi() * {part} / {period})" for part, period in angles for wave in ("sin", "cos"))
    return f"""isodow({day}) - 1, day({day}), month({day}), quarter({day}), year({day}),
     CASE WHEN isodow({day}) >= 6 THEN 1 ELSE 0 END, dayofyear({day}), weekofyear({day}), {waves}"""


def _ridge_models(name: str, series: str, model: str, fitted: str, key: str | None = None) -> str:
    """CTEs ``{name}_in`` (rows), ``{name}_model`` (mk, b, c) and ``{name}_seen`` (test rows with predictions)."""
    order = f'PARTITION BY "{key}" ORDER BY "Date" DESC' if key else 'ORDER BY "Date" DESC'
    return f"""
{name}_in AS MATERIALIZED (
  SELECT {series} AS series, {model} AS mk, "Date", "Sales", ROW_NUMBER() OVER ({order}) AS back,
    [{_calendar_list('"Date"')}, {_LAG_NAMES}, {_ROLLING_NAMES},
     rolling_mean_7 / (rolling_mean_30 + 1e-5), lag_1 - lag_7]::DOUBLE[] AS x
  FROM featured WHERE rn > 30),
{name}_cells AS (
  SELECT mk, series, "Date", "Sales", unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM {name}_in WHERE {fitted}),
{name}_scales AS (SELECT mk, j, AVG(v) AS m, STDDEV_POP(v) AS s FROM {name}_cells GROUP BY mk, j),
{name}_level AS (SELECT mk, AVG("Sales") AS y0 FROM {name}_in WHERE {fitted} GROUP BY mk),
{name}_scaled AS MATERIALIZED (
  SELECT mk, series, "Date", "Sales", j, CASE WHEN s > 0 THEN (v - m) / s ELSE 0 END AS z
  FROM {name}_cells JOIN {name}_scales USING (mk, j)),
{name}_products AS (
  SELECT a.mk, a.j AS i, b.j AS k, SUM(a.z * b.z) + CASE WHEN a.j = b.j THEN 10 ELSE 0 END AS g
  FROM {name}_scaled a JOIN {name}_scaled b USING (series, "Date") GROUP BY 1, 2, 3
  UNION ALL
  SELECT mk, j, 1000, SUM(z * ("Sales" - y0)) FROM {name}_scaled JOIN {name}_level USING (mk) GROUP BY 1, 2),
{name}_rows AS (SELECT mk, i, list(g ORDER BY k) AS r FROM {name}_products GROUP BY mk, i),
{name}_sweep(mk, p, m) AS (
  SELECT mk, 1, list(r ORDER BY i) FROM {name}_rows GROUP BY mk
  UNION ALL
  SELECT mk, p + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = p
      THEN list_transform(m[p], lambda v: v / m[p][p])
      ELSE list_transform(list_zip(m[i], m[p]), lambda t: t[1] - m[i][p] * t[2] / m[p][p]) END)
  FROM {name}_sweep WHERE p <= len(m)),
{name}_weights AS (
  SELECT mk, unnest(range(1, len(m) + 1)) AS j, unnest(list_transform(m, lambda r: r[len(r)])) AS w
  FROM {name}_sweep WHERE p = len(m) + 1),
{name}_model AS MATERIALIZED (
  SELECT mk, list(CASE WHEN s > 0 THEN w / s ELSE 0 END ORDER BY j) AS b,
    ANY_VALUE(y0) - SUM(CASE WHEN s > 0 THEN w * m / s ELSE 0 END) AS c
  FROM {name}_weights JOIN {name}_scales USING (mk, j) JOIN {name}_level USING (mk) GROUP BY mk),
{name}_seen AS (
  SELECT series, "Sales" AS actual, GREATEST(list_dot_product(x, b) + c, 0) AS predicted
  FROM {name}_in JOIN {name}_model USING (mk) WHERE back <= 90)"""


_FEATURE_LIST = ", ".join(
    [
        f"'{n}'"
        for n in "day_of_week day_of_month month quarter year is_weekend day_of_year week_of_year "
        "sin_month cos_month sin_dow cos_dow sin_day cos_day".split()
        + [f"lag_{k}" for k in _LAG_DAYS]
        + [f"rolling_{n}_{d}" for d in _WINDOW_DAYS for n in ("mean", "std", "min", "max")]
        + ["momentum_7_30", "sales_diff_1_7"]
    ]
)


def _weights_of(name: str, key: str | None = None) -> str:
    names = f'mk AS "{key}", ' if key else ""
    return f"""
SELECT {names}unnest(list_append([{_FEATURE_LIST}], 'Intercept')) AS "Feature",
  ROUND(unnest(list_append(b, c)), 3) AS "Weight" FROM {name}_model"""


def _ridge_walk(name: str, series: str, model: str) -> str:
    """CTE ``ridge_walk``: the thirty newest values of each series, moved on by the model's next day."""
    windows = ", ".join(
        f"list_{f}(hist[{31 - d}:30])" for d in _WINDOW_DAYS for f in ("avg", "stddev_pop", "min", "max")
    )
    lags = ", ".join(f"hist[{31 - k}]" for k in _LAG_DAYS)
    return f"""
ridge_newest AS (
  SELECT {series} AS series, {model} AS mk, "Date", "Sales",
    ROW_NUMBER() OVER (PARTITION BY {series} ORDER BY "Date" DESC) AS age FROM filled),
ridge_walk AS (
  SELECT series, mk, 0 AS step, MAX("Date") AS last_day, LIST("Sales" ORDER BY "Date") AS hist
  FROM ridge_newest WHERE age <= 30 GROUP BY series, mk
  UNION ALL
  SELECT series, mk, step + 1, last_day, list_append(hist[2:30], GREATEST(list_dot_product(x, b) + c, 0))
  FROM (
    SELECT *, [{_calendar_list("d")}, {lags}, {windows},
      list_avg(hist[24:30]) / (list_avg(hist[1:30]) + 1e-5), hist[30] - hist[24]]::DOUBLE[] AS x
    FROM (SELECT *, last_day + CAST(step + 1 AS INTEGER) AS d FROM ridge_walk WHERE step < 90)) JOIN {name}_model USING (mk))"""


def _ridge_bands(title: str, key: str | None = None) -> str:
    names = f'series AS "{key}", ' if key else ""
    return f"""
SELECT '{title}' AS "Model", {names}CAST(step AS INTEGER) AS "Step",
  CAST(last_day + CAST(step AS INTEGER) AS DATE) AS "Date",
  round_even(hist[30], 2) AS "Forecast_Sales",
  round_even(GREATEST(hist[30] - 1.28 * s * SQRT(1 + 0.015 * step), 0), 2) AS "Lower_80",
  round_even(hist[30] + 1.28 * s * SQRT(1 + 0.015 * step), 2) AS "Upper_80",
  round_even(GREATEST(hist[30] - 1.96 * s * SQRT(1 + 0.015 * step), 0), 2) AS "Lower_95",
  round_even(hist[30] + 1.96 * s * SQRT(1 + 0.015 * step), 2) AS "Upper_95"
FROM ridge_walk JOIN (SELECT series, STDDEV_POP(actual - predicted) AS s FROM tried_seen GROUP BY series) USING (series)
WHERE step > 0"""


def _ridge_forecast(title: str, key: str | None = None, own: bool = False) -> str:
    """Tried on the training rows, whose residuals give the spread; deployed on all rows."""
    featured = [_LINES, _filled("day", _SALES, key=key), _featured(key)]
    series = f'"{key}"' if key else "''"
    model = series if own else "''"
    return _with(
        *featured,
        _ridge_models("tried", series, model, "back > 90", key),
        _ridge_models("whole", series, model, "TRUE", key),
        _ridge_walk("whole", series, model),
        select=_ridge_bands(title, key),
        recursive=True,
    )


_SIGMA = """
sigma AS (SELECT STDDEV_POP(actual - GREATEST(rolling_mean_7, 0)) AS s FROM test_rows)"""


def _decomposition(key: str | None = None) -> str:
    names = f'"{key}", ' if key else ""
    part = f'PARTITION BY "{key}" ' if key else ""
    group = f'GROUP BY "{key}"' if key else ""
    using = f' AND a."{key}" = p."{key}"' if key else ""
    level_on = f'p."{key}" = l."{key}"' if key else "TRUE"
    a_names = f'a."{key}", ' if key else ""
    return _with(
        _LINES,
        _filled("month", _SALES, key=key),
        f"""
numbered AS (
  SELECT {names}"Date", "Sales" AS y, ROW_NUMBER() OVER w AS rn, COUNT(*) OVER ({part}) AS n,
    (SUM("Sales") OVER ({part}ORDER BY "Date" ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
      + 0.5 * (LAG("Sales", 6) OVER w + LEAD("Sales", 6) OVER w)) / 12 AS centred
  FROM filled WINDOW w AS ({part}ORDER BY "Date")
),
trended AS (
  SELECT {names}"Date", y, (rn - 1) % 12 AS phase,
    CASE WHEN rn > 6 AND rn <= n - 6 THEN centred END AS trend FROM numbered
),
phases AS (SELECT {names}phase, AVG(y - trend) AS raw FROM trended GROUP BY ALL),
levels AS (SELECT {names}AVG(raw) AS level FROM phases {group})""",
        select=f"""
SELECT {a_names}a."Date", a.y AS "Observed", ROUND(a.trend, 2) AS "Trend",
  ROUND(p.raw - l.level, 2) AS "Seasonal",
  ROUND(a.y - a.trend - (p.raw - l.level), 2) AS "Residual"
FROM trended a JOIN phases p ON a.phase = p.phase{using} JOIN levels l ON {level_on}""",
    )


# ---- the recursive baseline ------------------------------------------------------------


def _walk(key: str | None = None) -> str:
    """CTE ``walk``: seven newest values per series, moved on one day per step."""
    names = f'"{key}", ' if key else ""
    part = f'PARTITION BY "{key}" ' if key else ""
    group = f'GROUP BY "{key}"' if key else ""
    return f"""
newest AS (
  SELECT {names}"Date", "Sales", ROW_NUMBER() OVER ({part}ORDER BY "Date" DESC) AS age FROM filled
),
walk AS (
  SELECT {names}0 AS step, MAX("Date") AS last_day, LIST("Sales" ORDER BY "Date") AS hist
  FROM newest WHERE age <= 7 {group}
  UNION ALL
  SELECT {names}step + 1, last_day, list_append(hist[2:7], GREATEST(list_sum(hist) / 7, 0))
  FROM walk WHERE step < 90
)"""


_AHEAD = f"""
SELECT '{_BASELINE}' AS "Model", CAST(step AS INTEGER) AS "Step",
  CAST(last_day + CAST(step AS INTEGER) AS DATE) AS "Date", ROUND(hist[7], 2) AS "Predicted"
FROM walk WHERE step > 0"""

_BANDS = f"""
bands AS (
  SELECT '{_BASELINE}' AS "Model", CAST(step AS INTEGER) AS "Step",
    CAST(last_day + CAST(step AS INTEGER) AS DATE) AS "Date",
    round_even(hist[7], 2) AS "Forecast_Sales",
    round_even(GREATEST(hist[7] - 1.28 * s * SQRT(1 + 0.015 * step), 0), 2) AS "Lower_80",
    round_even(hist[7] + 1.28 * s * SQRT(1 + 0.015 * step), 2) AS "Upper_80",
    round_even(GREATEST(hist[7] - 1.96 * s * SQRT(1 + 0.015 * step), 0), 2) AS "Lower_95",
    round_even(hist[7] + 1.96 * s * SQRT(1 + 0.015 * step), 2) AS "Upper_95"
  FROM walk, sigma WHERE step > 0
)"""

_FORECAST = [*_FEATURES, _TEST, _SIGMA, _walk(), _BANDS]
_BAND_NAMES = '"Date", "Forecast_Sales", "Lower_80", "Upper_80", "Lower_95", "Upper_95"'

_RECENT_FROM = '(SELECT MAX("Date") - 90 FROM found)'

ORACLE: dict[str, str] = {
    "daily_series": _with(_LINES, _filled("day", _DAILY), select=_ALL_FILLED),
    "daily_series_no_fill": _with(_LINES, _filled("day", _DAILY), select="SELECT * FROM found"),
    "daily_series_by_region": _with(_LINES, _filled("day", _DAILY, key="Region"), select=_ALL_FILLED),
    "daily_series_filtered": _with(_LINES, _CHOSEN, _filled("day", _DAILY, "chosen"), select=_ALL_FILLED),
    "weekly_series_one_product": _with(_LINES, _ONE_PRODUCT, _filled("week", _COLUMNS, "one"), select=_ALL_FILLED),
    "monthly_series_one_product": _with(_LINES, _ONE_PRODUCT, _filled("month", _COLUMNS, "one"), select=_ALL_FILLED),
    "category_summary_null_orders": _with(
        _LINES,
        select="""
SELECT "Category", "Sales", "Profit", "Quantity", "Orders", "Profit" / "Sales" * 100 AS "Profit_Margin",
  ROUND("Sales" / SUM("Sales") OVER () * 100, 6) AS "Sales_Share"
FROM (SELECT "Category", CAST(SUM("Sales") AS DOUBLE) AS "Sales", CAST(SUM("Profit") AS DOUBLE) AS "Profit",
    CAST(SUM("Quantity") AS BIGINT) AS "Quantity",
    CAST(COUNT(DISTINCT CASE WHEN "Ship Mode" <> '1-URGENT' THEN "Order ID" END) AS BIGINT) AS "Orders"
  FROM lines GROUP BY "Category")""",
    ),
    "line_value_box": _with(
        _LINES,
        select="""
SELECT "Ship Mode", ROUND(quantile_cont("Sales"::DOUBLE, 0.25), 6) AS "Q1",
  ROUND(quantile_cont("Sales"::DOUBLE, 0.5), 6) AS "Median", ROUND(quantile_cont("Sales"::DOUBLE, 0.75), 6) AS "Q3"
FROM lines GROUP BY "Ship Mode" """,
    ),
    "weekly_series": _with(_LINES, _filled("week", _COLUMNS), select=_ALL_FILLED),
    "weekly_series_by_segment": _with(_LINES, _filled("week", _COLUMNS, key="Segment"), select=_ALL_FILLED),
    "monthly_series": _with(_LINES, _filled("month", _COLUMNS), select=_ALL_FILLED),
    "monthly_series_by_category": _with(_LINES, _filled("month", _COLUMNS, key="Category"), select=_ALL_FILLED),
    "monthly_sales_profit": _with(
        _LINES,
        _CHOSEN,
        _filled("month", _SALES_PROFIT, "chosen"),
        select="""SELECT "Date", strftime("Date", '%b %Y') AS "Month_Label", "Sales", "Profit" FROM filled""",
    ),
    "monthly_by_year": _with(
        _LINES,
        _filled("month", _SALES_PROFIT),
        select="""SELECT "Date", "Sales", "Profit", CAST(year("Date") AS INTEGER) AS "Year",
  CAST(month("Date") AS INTEGER) AS "Month" FROM filled""",
    ),
    "monthly_of_one_year": _with(
        _LINES,
        _filled("month", _SALES),
        select="""SELECT CAST(year("Date") AS INTEGER) AS "Year", CAST(month("Date") AS INTEGER) AS "Month",
  "Sales" FROM filled WHERE year("Date") = 1997""",
    ),
    "year_list": _with(
        _LINES,
        _filled("month", _SALES),
        select='SELECT DISTINCT CAST(year("Date") AS INTEGER) AS "Year" FROM filled',
    ),
    "season_pivot": _with(
        _LINES,
        _filled("month", _SALES),
        select='SELECT CAST(year("Date") AS INTEGER) AS "Year", '
        + ", ".join(
            f'SUM("Sales") FILTER (WHERE month("Date") = {i}) AS "{name}"'
            for i, name in enumerate(
                ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"], start=1
            )
        )
        + " FROM filled GROUP BY 1",
    ),
    "daily_sales_ma": _with(
        _LINES,
        _filled("day", _SALES_PROFIT),
        select="""SELECT "Date", "Sales", "Profit", """
        + ", ".join(
            f"""ROUND((CASE WHEN ROW_NUMBER() OVER (ORDER BY "Date") >= {d} THEN AVG("Sales") OVER
  (ORDER BY "Date" ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW) END)::DECIMAL(28,10), 2)::DOUBLE AS "MA_{d}" """
            for d in (7, 30)
        )
        + " FROM filled",
    ),
    "recent_actuals": _with(
        _LINES,
        _filled("day", _SALES),
        select=f"""
SELECT CAST(d AS DATE) AS "Date", COALESCE(f."Sales", 0) AS "Sales"
FROM (SELECT UNNEST(generate_series(CAST({_RECENT_FROM} AS TIMESTAMP),
  (SELECT CAST(MAX("Date") AS TIMESTAMP) FROM found), INTERVAL 1 DAY)) AS d)
LEFT JOIN found f ON f."Date" = CAST(d AS DATE)""",
    ),
    "last_120_days": _with(
        _LINES, _filled("day", _SALES), select='SELECT * FROM filled ORDER BY "Date" DESC LIMIT 120'
    ),
    "category_summary": _group_summary("Category"),
    "region_summary": _group_summary("Region"),
    "category_summary_filtered": _group_margin("Category", "chosen"),
    "region_margin": _group_margin("Region"),
    "subcategory_summary": _with(
        _LINES,
        select="""SELECT "Category", "Sub-Category", CAST(SUM("Sales") AS DOUBLE) AS "Sales",
  CAST(SUM("Profit") AS DOUBLE) AS "Profit" FROM lines GROUP BY ALL""",
    ),
    "category_tree": _with(
        _LINES,
        """
leaves AS (SELECT "Category", "Sub-Category", CAST(SUM("Sales") AS DOUBLE) AS s,
  CAST(SUM("Profit") AS DOUBLE) AS p FROM lines GROUP BY ALL)""",
        select="""
SELECT 'Sub-Category' AS "Level", "Category", "Sub-Category", ROUND(s, 4) AS "Sales",
  ROUND(p, 4) AS "Profit_Weighted" FROM leaves
UNION ALL
SELECT 'Category', "Category", NULL, ROUND(SUM(s), 4), ROUND(SUM(p * s) / SUM(s), 4) FROM leaves GROUP BY "Category" """,
    ),
    "top_products_by_name": _top_products(["Product Name", "Category"]),
    "top_products_by_id": _top_products(["Product ID", "Product Name", "Category"]),
    "top_products_filtered": _top_products(["Product Name", "Category"], "chosen"),
    "order_totals": _with(_LINES, _ORDERS, select="SELECT * FROM order_values"),
    "segment_order_value": _with(
        _LINES,
        _ORDERS,
        select="""
SELECT "Segment", CAST(SUM(CAST("Order_Sales" AS DECIMAL(28,4))) AS DOUBLE) AS "Total_Sales",
  CAST(COUNT(*) AS BIGINT) AS "Order_Count",
  CAST(SUM(CAST("Order_Sales" AS DECIMAL(28,4))) AS DOUBLE) / COUNT(*) AS "AOV",
  quantile_cont("Order_Sales", 0.5) AS "Median_OV"
FROM order_values GROUP BY "Segment" """,
    ),
    "segment_order_box": _with(
        _LINES,
        _ORDERS,
        """
quartiles AS (SELECT "Segment", quantile_cont("Order_Sales", 0.25) AS q1,
  quantile_cont("Order_Sales", 0.5) AS q2, quantile_cont("Order_Sales", 0.75) AS q3
  FROM order_values GROUP BY "Segment"),
judged AS (SELECT o.*, q1, q2, q3,
  "Order_Sales" BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM order_values o JOIN quartiles USING ("Segment"))""",
        select="""
SELECT "Segment", ROUND(q1, 6) AS "Q1", ROUND(q2, 6) AS "Median", ROUND(q3, 6) AS "Q3",
  MIN("Order_Sales") FILTER (WHERE inside) AS "Whisker_Low",
  MAX("Order_Sales") FILTER (WHERE inside) AS "Whisker_High",
  CAST(COUNT(*) FILTER (WHERE NOT inside) AS BIGINT) AS "Outliers"
FROM judged GROUP BY "Segment", q1, q2, q3""",
    ),
    "dow_sales": _weekdays("TRUE"),
    "dow_sales_one_weekend": _weekdays("\"Order Date\" BETWEEN DATE '1997-05-24' AND DATE '1997-05-25'"),
    "kpi_headline": _headline("lines"),
    "kpi_headline_filtered": _headline("chosen"),
    "best_category": _with(
        _LINES,
        select="""SELECT "Category", CAST(SUM("Sales") AS DOUBLE) AS "Sales" FROM lines
GROUP BY "Category" ORDER BY 2 DESC, 1 LIMIT 1""",
    ),
    "filter_options": _with(
        _LINES,
        select="""SELECT DISTINCT 'Category' AS "Filter", "Category" AS "Value" FROM lines
UNION ALL SELECT DISTINCT 'Region', "Region" FROM lines
UNION ALL SELECT DISTINCT 'Segment', "Segment" FROM lines""",
    ),
    "quality_report": _with(
        _LINES,
        select=f"""
SELECT CAST(COUNT(*) AS BIGINT) AS total_rows, CAST(28 AS INTEGER) AS total_columns,
  strftime(MIN("Order Date"), '%Y-%m-%d') AS start_date, strftime(MAX("Order Date"), '%Y-%m-%d') AS end_date,
  CAST(MAX("Order Date") - MIN("Order Date") + 1 AS INTEGER) AS total_days_span,
  CAST({_NULL_SUM} + 9 * COUNT(*) FILTER (WHERE "Order Date" IS NULL) AS BIGINT) AS missing_values,
  CAST(COUNT(*) - COUNT(DISTINCT ("Order ID", "Product ID")) AS BIGINT) AS duplicate_rows,
  CAST(SUM("Sales") AS DOUBLE) AS total_sales, CAST(SUM("Profit") AS DOUBLE) AS total_profit,
  CAST(SUM("Profit") AS DOUBLE) / CAST(SUM("Sales") AS DOUBLE) * 100 AS overall_profit_margin,
  CAST(COUNT(DISTINCT "Order ID") AS BIGINT) AS unique_orders,
  CAST(COUNT(DISTINCT "Customer ID") AS BIGINT) AS unique_customers,
  CAST(COUNT(DISTINCT "Product ID") AS BIGINT) AS unique_products,
  string_agg(DISTINCT "Category", ',' ORDER BY "Category") AS categories,
  string_agg(DISTINCT "Region", ',' ORDER BY "Region") AS regions
FROM lines""",
    ),
    "null_counts": _with(_LINES, select=_NULL_COUNTS),
    "columns_with_nulls": _with(
        *_FEATURES,
        select="SELECT * FROM ("
        + "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS "Column", CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS "Nulls" FROM featured"""
            for c in [f"lag_{k}" for k in _LAG_DAYS]
            + [f"rolling_{n}_{d}" for d in _WINDOW_DAYS for n in ("mean", "std", "min", "max")]
        )
        + """
UNION ALL SELECT 'momentum_7_30', CAST(COUNT(*) FILTER (WHERE rolling_mean_7 / (rolling_mean_30 + 1e-5) IS NULL) AS BIGINT) FROM featured
UNION ALL SELECT 'sales_diff_1_7', CAST(COUNT(*) FILTER (WHERE lag_1 - lag_7 IS NULL) AS BIGINT) FROM featured
) WHERE "Nulls" > 0""",
    ),
    "duplicate_lines": _with(
        _LINES,
        select="""SELECT CAST(COUNT(*) - COUNT(DISTINCT ("Order ID", "Product ID")) AS BIGINT) AS "Duplicate_Rows"
FROM lines""",
    ),
    "date_bounds": _with(
        _LINES, select='SELECT MIN("Order Date") AS "Start_Date", MAX("Order Date") AS "End_Date" FROM lines'
    ),
    "line_cleaning": _with(
        _LINES,
        """
dirty AS (
  SELECT "Order ID", "Product ID", "Order Date", "Ship Date", "Ship Mode",
    CASE WHEN "Ship Mode" = '2-HIGH' THEN 0.0 ELSE CAST("Sales" AS DOUBLE) END AS s,
    CASE "Ship Mode" WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 ELSE "Quantity" END AS q,
    CASE WHEN "Ship Mode" = '4-NOT SPECIFIED' THEN 0.0 ELSE CAST("Discount" AS DOUBLE) END AS d,
    CASE WHEN "Ship Mode" = '5-LOW' THEN 0.0 ELSE CAST("Profit" AS DOUBLE) END AS p
  FROM lines
)""",
        select="""
SELECT CAST("Order ID" AS VARCHAR) AS "Order ID", CAST("Product ID" AS VARCHAR) AS "Product ID",
  "Order Date", "Ship Date", "Ship Mode", s AS "Sales", CAST(q AS INTEGER) AS "Quantity",
  d AS "Discount", p AS "Profit",
  CASE WHEN q > 0 THEN s / q ELSE s END AS "Unit_Price",
  CASE WHEN s > 0 THEN p / s * 100 ELSE 0.0 END AS "Profit_Margin"
FROM dirty""",
    ),
    "line_calendar": _with(
        _LINES,
        select="""
SELECT "Order ID", "Product ID", "Order Date",
  CAST(year("Order Date") AS INTEGER) AS "Year", CAST(quarter("Order Date") AS INTEGER) AS "Quarter",
  CAST(month("Order Date") AS INTEGER) AS "Month", strftime("Order Date", '%b') AS "Month_Name",
  CAST(weekofyear("Order Date") AS INTEGER) AS "Week", CAST(day("Order Date") AS INTEGER) AS "Day",
  CAST(isodow("Order Date") - 1 AS INTEGER) AS "Day_of_Week", strftime("Order Date", '%a') AS "Day_Name",
  CAST(CASE WHEN isodow("Order Date") >= 6 THEN 1 ELSE 0 END AS INTEGER) AS "Is_Weekend"
FROM lines""",
    ),
    "preview_lines": _with(
        _LINES,
        select="""
SELECT "Order Date", "Order ID", "Product ID", CAST("Sales" AS DOUBLE) AS "Sales", "Quantity"
FROM (SELECT * FROM lines ORDER BY "Order Date", "Order ID", "Product ID", "Sales", "Quantity" LIMIT 5)""",
    ),
    "table_shape": _with(
        _LINES, select='SELECT CAST(COUNT(*) AS BIGINT) AS "Rows", CAST(17 AS INTEGER) AS "Columns" FROM lines'
    ),
    "sales_file_summary": _with(
        _LINES,
        select=f"""
SELECT "Category", ROUND("Sales", 4) AS "Sales", ROUND("Profit", 4) AS "Profit", "Orders",
  ROUND("Profit" / "Sales" * 100, 4) AS "Profit_Margin"
FROM (SELECT "Category", {_SUMS} FROM lines GROUP BY "Category")""",
    ),
    "lag_features": _with(*_FEATURES, select=f'SELECT "Date", "Sales", {_LAG_NAMES} FROM featured'),
    "rolling_features": _with(*_FEATURES, select=f'SELECT "Date", {_ROLLING_ROUNDED} FROM featured'),
    "cyclical_features": _with(_LINES, _filled("day", _SALES), select=f'SELECT "Date", {_CYCLES} FROM filled'),
    "feature_matrix": _with(
        *_FEATURES,
        select=f"""
SELECT "Date", "Sales", {_CALENDAR}, {_CYCLES}, {_LAG_NAMES}, {_ROLLING_ROUNDED},
  ROUND(rolling_mean_7 / (rolling_mean_30 + 1e-5), 6) AS momentum_7_30,
  ROUND(lag_1 - lag_7, 4) AS sales_diff_1_7
FROM featured WHERE rn > 30""",
    ),
    "feature_matrix_by_region": _with(
        _LINES,
        _filled("day", _SALES, key="Region"),
        _featured("Region"),
        select="""
SELECT "Region", "Date", "Sales", lag_7, lag_30, """
        + _rolling_value("mean", 7)
        + ", "
        + _rolling_value("std", 30)
        + " FROM featured WHERE rn > 30",
    ),
    "chrono_split": _with(
        *_FEATURES,
        select="""
SELECT "Date", "Sales", CASE WHEN ROW_NUMBER() OVER (ORDER BY "Date" DESC) <= 90 THEN 'test' ELSE 'train' END AS split
FROM featured WHERE rn > 30""",
    ),
    "split_dates": _with(
        *_FEATURES,
        """
sides AS (
  SELECT "Date", CASE WHEN ROW_NUMBER() OVER (ORDER BY "Date" DESC) <= 90 THEN 'test' ELSE 'train' END AS split
  FROM featured WHERE rn > 30
)""",
        select="""
SELECT split, MIN("Date") AS "First_Date", MAX("Date") AS "Last_Date", CAST(COUNT(*) AS BIGINT) AS "Rows"
FROM sides GROUP BY split""",
    ),
    "baseline_metrics": _with(*_FEATURES, _TEST, select=_BASELINE_METRICS),
    "baseline_metrics_4": _with(*_FEATURES, _TEST, select=_metric_select(_BASELINE, "rolling_mean_7", False)),
    "model_metrics": _with(
        *_FEATURES,
        _TEST,
        f"\nthree AS ({_THREE})",
        select="""
SELECT *, "MAE" = MIN("MAE") OVER () AS "Best_MAE", "RMSE" = MIN("RMSE") OVER () AS "Best_RMSE",
  "WAPE_%" = MIN("WAPE_%") OVER () AS "Best_WAPE_%", "R2" = MAX("R2") OVER () AS "Best_R2"
FROM three""",
    ),
    "ridge_metrics": _with(*_FEATURES, _RIDGE, select=_RIDGE_METRICS, recursive=True),
    "ridge_against_baseline": _with(
        *_FEATURES, _TEST, _RIDGE, select=f"{_BASELINE_METRICS}\nUNION ALL\n{_RIDGE_METRICS}", recursive=True
    ),
    "champion_of_two": _with(*_FEATURES, _RIDGE, select=_RIDGE_METRICS, recursive=True),
    "residual_sigma": _with(
        *_FEATURES, _TEST, _SIGMA, select=f"""SELECT '{_BASELINE}' AS "Model", ROUND(s, 2) AS "Sigma" FROM sigma"""
    ),
    "decomposition": _decomposition(),
    "decomposition_by_region": _decomposition("Region"),
    "future_calendar": _with(
        _LINES,
        """
ahead AS (
  SELECT CAST(last_day + CAST(i AS INTEGER) AS DATE) AS "Date"
  FROM (SELECT MAX("Order Date") AS last_day, UNNEST(generate_series(1, 90)) AS i FROM lines)
)""",
        select=f'SELECT "Date", {_CALENDAR}, {_CYCLES} FROM ahead',
    ),
    "next_day_features_by_region": _with(
        _LINES,
        _filled("day", _SALES, key="Region"),
        """
aged AS (
  SELECT "Region", "Date", "Sales", ROW_NUMBER() OVER (PARTITION BY "Region" ORDER BY "Date" DESC) AS age FROM filled
)""",
        select='SELECT "Region", CAST(MAX("Date") + 1 AS DATE) AS "Date", '
        + ", ".join(f'MAX("Sales") FILTER (WHERE age = {k}) AS lag_{k}' for k in _LAG_DAYS)
        + ", "
        + ", ".join(
            {
                "mean": f'ROUND((AVG("Sales") FILTER (WHERE age <= {d}))::DECIMAL(28,10), 2)::DOUBLE',
                "std": f'ROUND(STDDEV_POP("Sales") FILTER (WHERE age <= {d}), 2)',
                "min": f'MIN("Sales") FILTER (WHERE age <= {d})',
                "max": f'MAX("Sales") FILTER (WHERE age <= {d})',
            }[n]
            + f" AS rolling_{n}_{d}"
            for d in _WINDOW_DAYS
            for n in ("mean", "std", "min", "max")
        )
        + ' FROM aged GROUP BY "Region"',
    ),
    "recursive_forecast_baseline": _with(
        _LINES, _filled("day", _SALES), _walk(), select=_AHEAD, recursive=True
    ),
    "recursive_forecast_baseline_by_region": _with(
        _LINES,
        _filled("day", _SALES, key="Region"),
        _walk("Region"),
        select=_AHEAD.replace(' AS "Model",', ' AS "Model", "Region",'),
        recursive=True,
    ),
    "forecast_bands": _with(*_FORECAST, select="SELECT * FROM bands", recursive=True),
    "forecast_first_30_days": _with(
        *_FORECAST, select=f'SELECT {_BAND_NAMES} FROM bands WHERE "Step" <= 30', recursive=True
    ),
    "forecast_kpis": _with(
        *_FORECAST,
        select="""
SELECT ROUND(SUM("Forecast_Sales"), 2) AS "Projected_Sales", ROUND(AVG("Forecast_Sales"), 2) AS "Daily_Average",
  ROUND(SUM("Upper_95"), 2) AS "Upper_Risk", ROUND(SUM("Lower_95"), 2) AS "Lower_Floor"
FROM bands WHERE "Step" <= 60""",
        recursive=True,
    ),
    "forecast_span": _with(
        *_FORECAST,
        select="""
SELECT ROUND(SUM("Forecast_Sales"), 2) AS "Total_Sales", MIN("Date") AS "First_Date", MAX("Date") AS "Last_Date"
FROM bands""",
        recursive=True,
    ),
    "history_plus_forecast": _with(
        *_FORECAST,
        select=f"""
SELECT 'Actual' AS "Kind", "Date", "Sales" AS "Value", CAST(NULL AS DOUBLE) AS "Lower_95",
  CAST(NULL AS DOUBLE) AS "Upper_95" FROM filled WHERE "Date" >= {_RECENT_FROM}
UNION ALL
SELECT 'Forecast', "Date", "Forecast_Sales", "Lower_95", "Upper_95" FROM bands""",
        recursive=True,
    ),
    "forecast_file": _with(*_FORECAST, select=f"SELECT {_BAND_NAMES} FROM bands", recursive=True),
    "metrics_file": _with(*_FEATURES, _TEST, select=_BASELINE_METRICS),
}

# A loaded model predicts as the one that was saved.
ORACLE["saved_model_metrics"] = ORACLE["ridge_against_baseline"]
ORACLE["forecast_export"] = ORACLE["forecast_first_30_days"]
ORACLE["saved_model_facts"] = _with(
    _LINES,
    select=f"""
SELECT 'Ridge Regression' AS "Model", '{",".join(map(str, _LAG_DAYS))}' AS "Lags",
  '{",".join(map(str, _WINDOW_DAYS))}' AS "Windows", CAST(90 AS INTEGER) AS "Test_Size",
  strftime(MAX("Order Date"), '%Y-%m-%d') AS "Last_Date" FROM lines""",
)
ORACLE["sales_file_quoted"] = ORACLE["sales_file_summary"]
ORACLE["ridge_forecast"] = _ridge_forecast("Ridge Regression")
ORACLE["ridge_forecast_by_region"] = _ridge_forecast("Ridge Regression", "Region")
ORACLE["ridge_own_forecast_by_region"] = _ridge_forecast("Ridge by Series", "Region", own=True)
ORACLE["ridge_refit"] = _with(
    *_FEATURES, _ridge_models("whole", "''", "''", "TRUE"), select=_weights_of("whole"), recursive=True
)
ORACLE["ridge_coefficients_by_region"] = _with(
    _LINES,
    _filled("day", _SALES, key="Region"),
    _featured("Region"),
    _ridge_models("tried", '"Region"', '"Region"', "back > 90", "Region"),
    select=_weights_of("tried", "Region"),
    recursive=True,
)


# ---- the unit-root test ----------------------------------------------------------------

# Enough for 1,000 periods.
_ADF_LAGS = 22
# Response surfaces of the p-value and of the critical values.
_ADF_SMALL, _ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
_ADF_CRITICAL = {
    "Critical_1": (-3.43035, -6.5393, -16.786, -79.433),
    "Critical_5": (-2.86154, -2.8903, -4.234, -40.04),
    "Critical_10": (-2.56677, -1.5384, -2.809, 0.0),
}


def _adf_gram(name: str, rows: str) -> str:
    """CTE ``{name}``: a matrix for each series from cells (series, t, i, v)."""
    return f"""
{name}_cells AS MATERIALIZED ({rows}),
{name}_sums AS (
  SELECT a.series, a.i, b.i AS j, SUM(a.v * b.v) AS g FROM {name}_cells a JOIN {name}_cells b USING (series, t) GROUP BY 1, 2, 3),
{name}_rows AS (SELECT series, i, list(g ORDER BY j) AS r FROM {name}_sums GROUP BY series, i),
{name} AS (SELECT series, list(r ORDER BY i) AS m FROM {name}_rows GROUP BY series)"""


def _adf_sweep(name: str, matrix: str) -> str:
    """Constant and lags swept out one by one; row 1 is the step, row 2 the level, which stays."""
    return f"""
{name}(series, p, m) AS (
  SELECT series, 3, m FROM {matrix}
  UNION ALL
  SELECT series, p + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = p THEN m[p]
      ELSE list_transform(list_zip(m[i], m[p]), lambda t: t[1] - m[i][p] * t[2] / m[p][p]) END)
  FROM {name} WHERE p <= len(m))"""


def _adf(key: str | None = None) -> str:
    series = f'"{key}"' if key else "''"
    lagged = ", ".join(f"LAG(dy, {k}) OVER w" for k in range(1, _ADF_LAGS + 1))
    poly = lambda ws: " + ".join(f"({w}) * pow(tau, {i})" for i, w in enumerate(ws))
    critical = ", ".join(
        "ROUND(" + " + ".join(f"({w}) / pow(obs, {i})" for i, w in enumerate(ws)) + f', 6) AS "{name}"'
        for name, ws in _ADF_CRITICAL.items()
    )
    names = f'series AS "{key}", ' if key else ""
    return _with(
        _LINES,
        _filled("month", _SALES, key=key),
        f"""
adf_steps AS (
  SELECT {series} AS series, "Date", "Sales"::DOUBLE AS y, ROW_NUMBER() OVER w - 2 AS t, COUNT(*) OVER (PARTITION BY {series}) AS n,
    "Sales"::DOUBLE - LAG("Sales"::DOUBLE) OVER w AS dy,
    LAG("Sales"::DOUBLE) OVER w - AVG("Sales"::DOUBLE) OVER (PARTITION BY {series}) AS level
  FROM filled WINDOW w AS (PARTITION BY {series} ORDER BY "Date")),
adf_rows AS MATERIALIZED (
  SELECT series, t, LEAST(CEIL(12 * pow(n / 100.0, 0.25)), n // 2 - 2)::INTEGER AS most, [dy, level, 1, {lagged}] AS x
  FROM adf_steps WINDOW w AS (PARTITION BY series ORDER BY "Date")),
adf_known AS (SELECT * FROM adf_rows WHERE t >= 0)""",
        _adf_gram(
            "adf_common",
            """
  SELECT series, t, unnest(range(1, most + 4)) AS i, unnest(x[1:most + 3]) AS v FROM adf_known WHERE t >= most""",
        ),
        _adf_sweep("adf_tried", "adf_common"),
        """
adf_counts AS (SELECT series, COUNT(*) AS n FROM adf_known WHERE t >= most GROUP BY series),
adf_scores AS (
  SELECT series, p - 4 AS k, n * ln((m[1][1] - m[1][2] * m[1][2] / m[2][2]) / n) + 2 * (p - 2) AS score
  FROM adf_tried JOIN adf_counts USING (series) WHERE p >= 4),
adf_used AS (SELECT series, arg_min(k, score) AS used FROM adf_scores GROUP BY series)""",
        _adf_gram(
            "adf_own",
            """
  SELECT series, t, unnest(range(1, used + 4)) AS i, unnest(x[1:used + 3]) AS v FROM adf_known JOIN adf_used USING (series) WHERE t >= used""",
        ),
        _adf_sweep("adf_final", "adf_own"),
        f"""
adf_level AS (
  SELECT series, used, (SELECT COUNT(*) FROM adf_known k WHERE k.series = f.series AND k.t >= used) AS obs,
    m[1][1] AS r, m[1][2] AS c, m[2][2] AS q
  FROM adf_final f JOIN adf_used USING (series) WHERE p = len(m) + 1),
adf_tau AS (SELECT series, used, obs::DOUBLE AS obs, (c / q) / sqrt((r - c * c / q) / (obs - used - 2) / q) AS tau FROM adf_level),
adf_z AS (SELECT *, CASE WHEN tau <= -1.61 THEN {poly(_ADF_SMALL)} ELSE {poly(_ADF_LARGE)} END AS z FROM adf_tau),
adf_p AS (
  SELECT series, used, obs, tau, 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi())
    * (SELECT SUM(exp((2 * i + 1) * ln(abs(z)) - lgamma(2 * i + 2) + i * ln(2) + lgamma(i + 1))) FROM range(200) AS terms(i)) AS p
  FROM adf_z)""",
        select=f"""
SELECT {names}ROUND(tau, 6) AS "Statistic", ROUND(p, 6) AS "P_Value", {critical},
  used::INTEGER AS "Lags", obs::INTEGER AS "Observations", p < 0.05 AS "Stationary" FROM adf_p""",
        recursive=True,
    )


ORACLE["adf_test"] = _adf()
ORACLE["adf_test_by_region"] = _adf("Region")


# ---- properties of tree models ---------------------------------------------------------

_TRAIN = """
train_rows AS (SELECT "Sales" AS y FROM featured WHERE rn > 30 ORDER BY "Date" DESC OFFSET 90)"""

ORACLE["forest_range"] = _with(
    *_FEATURES,
    _TEST,
    _TRAIN,
    select="""
SELECT 'Random Forest' AS "Model", (SELECT COUNT(*) FROM test_rows) AS "Test_Days", MIN(y)::DOUBLE AS "Lowest",
  MAX(y)::DOUBLE AS "Highest", 0::BIGINT AS "Outside" FROM train_rows""",
)
ORACLE["boost_gain"] = _with(
    *_FEATURES,
    _TRAIN,
    select="""
SELECT 'Gradient Boosting' AS "Model", COUNT(*) AS "Train_Days", ROUND(STDDEV_POP(y::DOUBLE), 2) AS "Spread", TRUE AS "Gained" FROM train_rows""",
)
ORACLE["importance_totals"] = f"""
SELECT COUNT(*) AS "Features", COUNT(DISTINCT n) AS "Known", 0::BIGINT AS "Negative", 1.0::DOUBLE AS "Total"
FROM (SELECT unnest([{_FEATURE_LIST}]) AS n)"""
