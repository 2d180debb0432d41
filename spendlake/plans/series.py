"""Queries WIN1 to WIN14.

Forecast queries use the employer as the unit, since no single user of the
given tables has thirty receipts, and also the user for the fallback branch.
"""

from pyspark.sql import functions as F

from spendlake.operators import series as ops
from spendlake.operators.joins import user_history
from spendlake.plans.bindings import RECEIPTS_AS_OF as NOW
from spendlake.plans.bindings import r
from spendlake.plans.registry import query
from spendlake.sources.canonical import RECEIPTS_AS_OF as AS_OF


def by_employer(t):
    """Receipts with the employer of the user."""
    people = t.users.select("user_id", "employer_id")
    return t.receipts.join(people, "user_id")


EMP = "er AS (SELECT r.*, u.employer_id FROM receipts r JOIN users u ON r.user_id = u.user_id)"


@query("win1_daily_series", "receipts", f"""SELECT user_id, category, strftime(date, '%Y-%m-%d') AS day,
 {r('sum(total_amount)')} AS total, count(*) AS receipts FROM receipts GROUP BY ALL""")
def daily_series(t):
    return ops.daily_series(t.receipts, ["user_id", "category"])


def forecast_sql(key, source, extra=""):
    """Forecast for August (no month factor), thirty days."""
    return f"""WITH {source}, top AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC, receipt_id DESC) AS rn FROM src),
 s AS (SELECT {key}, count(*) AS n, sum(total_amount)::double / count(*) AS m, stddev_samp(total_amount::double) AS sd,
 avg(total_amount::double) FILTER (rn <= 7) AS l7, avg(total_amount::double) FILTER (rn BETWEEN 8 AND 14) AS p7 FROM top WHERE rn <= 30 GROUP BY {key}),
 g AS (SELECT *, CASE WHEN p7 > 0 THEN (l7 - p7) / p7 * 100 ELSE 0 END AS gr FROM s)
 SELECT {key}, {r('CASE WHEN n >= 30 THEN m * 30 ELSE ' + (extra or '20000') + ' * 30.0 END')} AS total_amount,
 {r('CASE WHEN n >= 30 THEN greatest(0.3, least(0.9, 1 - sd / m)) ELSE 0.6 END')} AS confidence,
 {r('CASE WHEN n >= 30 THEN gr ELSE 2.5 END')} AS monthly_growth,
 CASE WHEN n < 30 THEN 'stable' WHEN gr > 5 THEN 'increasing' WHEN gr < -5 THEN 'decreasing' ELSE 'stable' END AS direction,
 {r('1.0')} AS seasonal_factor, CASE WHEN n >= 30 THEN 'statistical' ELSE 'mock' END AS method FROM g"""


@query("win2_employer_forecast", "receipts users", forecast_sql("employer_id", f"{EMP}, src AS (SELECT * FROM er)"))
def employer_forecast(t):
    return ops.forecast(by_employer(t), AS_OF, 30, ["employer_id"])


@query("win3_category_trend", "receipts users", forecast_sql(
    "employer_id, category", f"{EMP}, src AS (SELECT * FROM er WHERE category IS NOT NULL)",
    "(CASE category WHEN 'Combustible' THEN 25000 WHEN 'Supermercado' THEN 15000 WHEN 'Comida' THEN 18000 ELSE 35000 END)"))
def category_trend(t):
    rows = by_employer(t).filter(F.col("category").isNotNull())
    return ops.forecast(rows, AS_OF, 30, ["employer_id", "category"])


@query("win4_fallback_forecast", "receipts users", forecast_sql("user_id", "src AS (SELECT * FROM receipts)") + f"""
 UNION ALL SELECT user_id, {r('600000.0')}, {r('0.6')}, {r('2.5')}, 'stable', {r('1.0')}, 'mock' FROM users WHERE user_id NOT IN (SELECT user_id FROM receipts)""")
def fallback_forecast(t):
    return ops.forecast(t.receipts, AS_OF, 30, users=t.users)


@query("win5_forecast_fanout", "receipts users", f"""WITH {EMP}, a AS (
 SELECT employer_id, NULL AS category, date, receipt_id, total_amount FROM er
 UNION ALL SELECT employer_id, category, date, receipt_id, total_amount FROM er WHERE category IS NOT NULL),
 top AS (SELECT *, row_number() OVER (PARTITION BY employer_id, category ORDER BY date DESC, receipt_id DESC) AS rn FROM a),
 s AS (SELECT employer_id, category, count(*) AS n, sum(total_amount)::double / count(*) AS m, stddev_samp(total_amount::double) AS sd
 FROM top WHERE rn <= 30 GROUP BY ALL),
 rate(category, v) AS (VALUES ('Supermercado', 15000), ('Combustible', 25000), ('Comida', 18000), ('Retail', 35000), ('Transporte', 8000)),
 cells AS (SELECT employer_id, NULL AS category, days, n, m, sd, 20000 AS v FROM s, (VALUES (7), (30), (90)) h(days) WHERE category IS NULL
 UNION ALL SELECT e.employer_id, rate.category, 30, s.n, s.m, s.sd, rate.v FROM (SELECT DISTINCT employer_id FROM er) e CROSS JOIN rate
 LEFT JOIN s ON s.employer_id = e.employer_id AND s.category = rate.category)
 SELECT employer_id, category, days, {r('CASE WHEN n >= 30 THEN m ELSE v END * days')} AS total_amount,
 {r('CASE WHEN n >= 30 THEN greatest(0.3, least(0.9, 1 - sd / m)) ELSE 0.6 END')} AS confidence,
 CASE WHEN n >= 30 THEN 'statistical' ELSE 'mock' END AS method FROM cells""")
def forecast_fanout(t):
    return ops.forecast_fanout(by_employer(t), AS_OF, 30, "employer_id")


DAILY_SQL = f"""{EMP}, daily AS (SELECT employer_id, cast(date AS date) AS day, sum(total_amount)::double AS y FROM er GROUP BY ALL),
 x AS (SELECT *, row_number() OVER (PARTITION BY employer_id ORDER BY day) - 1 AS x FROM daily)"""


@query("win6_linear_trend", "receipts users", f"""WITH {DAILY_SQL}, f AS (SELECT employer_id, count(*) AS days, regr_slope(y, x) AS b, avg(y) AS m
 FROM x GROUP BY 1) SELECT employer_id, days, {r('b')} AS slope, CASE WHEN b > m * 0.01 THEN 'increasing' WHEN b < -m * 0.01 THEN 'decreasing'
 ELSE 'stable' END AS direction, {r('b * 30 / m * 100')} AS monthly_growth FROM f""")
def linear_trend(t):
    return ops.linear_trend(ops.daily_series(by_employer(t), ["employer_id"]), "employer_id")


@query("win7_fit_confidence", "receipts", f"""WITH daily AS (SELECT user_id, cast(date AS date) AS day, sum(total_amount)::double AS y FROM receipts GROUP BY ALL),
 x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS x FROM daily),
 f AS (SELECT user_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x GROUP BY 1 HAVING count(*) >= 2)
 SELECT x.user_id, {r('greatest(0.3, least(0.95, 1 - avg(abs((y - (a + b * x)) / y))))')} AS confidence
 FROM x JOIN f ON x.user_id = f.user_id GROUP BY 1""")
def fit_confidence(t):
    return ops.fit_confidence(ops.daily_series(t.receipts, ["user_id"]))


@query("win8_weekday_pattern", "receipts", f"""SELECT user_id, dayname(date) AS weekday, {r('sum(total_amount)::double / count(*)')} AS average,
 count(*) AS receipts FROM receipts GROUP BY ALL""")
def weekday_pattern(t):
    return ops.weekday_pattern(t.receipts)


@query("win8_half_month_pattern", "receipts", f"""SELECT user_id,
 {r('sum(total_amount) FILTER (day(date) <= 15)::double / nullif(count(*) FILTER (day(date) <= 15), 0)')} AS first_half,
 {r('sum(total_amount) FILTER (day(date) > 15)::double / nullif(count(*) FILTER (day(date) > 15), 0)')} AS second_half,
 count(*) AS data_points FROM receipts GROUP BY 1""")
def half_month_pattern(t):
    return ops.half_month_pattern(t.receipts)


@query("win9_holiday_tags", "receipts", f"""WITH days AS (SELECT receipt_id, cast(date AS date) AS d, month(date) AS m FROM receipts),
 h AS (SELECT name, pos, make_date(y, mm, dd) AS hd, lo, hi FROM range(1990, 2010) t(y),
 (VALUES ('fiestas_patrias', 1, 9, 18, -2, 2), ('navidad', 2, 12, 25, -7, 2), ('año_nuevo', 3, 1, 1, -3, 2)) v(name, pos, mm, dd, lo, hi))
 SELECT receipt_id, string_agg(name, '|' ORDER BY pos) AS holidays,
 {r('any_value(CASE m WHEN 3 THEN 1.15 WHEN 9 THEN 1.20 WHEN 12 THEN 1.25 WHEN 1 THEN 0.85 WHEN 2 THEN 0.90 ELSE 1 END)')} AS seasonal_factor
 FROM days JOIN h ON d BETWEEN hd + lo AND hd + hi GROUP BY 1""")
def holiday_tags(t):
    rows = t.receipts.select(
        "receipt_id", ops.holiday_tags(F.col("date")).alias("holidays"), ops.seasonal_factor(F.col("date")).alias("seasonal_factor")
    )
    return rows.filter(F.size("holidays") > 0)


@query("win10_unusual_spending", "receipts users", f"""WITH {EMP}, s AS (SELECT employer_id,
 avg(total_amount::double) FILTER (created_at >= {NOW} - interval 7 day) AS a, avg(total_amount::double) FILTER (created_at < {NOW} - interval 7 day) AS b
 FROM er WHERE created_at BETWEEN {NOW} - interval 30 day AND {NOW} GROUP BY 1)
 SELECT employer_id, {r('a')} AS recent_average, {r('b')} AS historical_average, {r('(a - b) / b * 100')} AS increase_percentage
 FROM s WHERE a > b * 1.5""")
def unusual_spending(t):
    return ops.unusual_spending(by_employer(t), AS_OF, key="employer_id")


HISTORY_SQL = """history AS (SELECT r.user_id, r.receipt_id, r.date, r.total_amount, coalesce(c.category, 'Otros') AS category
 FROM receipts r LEFT JOIN categories c ON r.receipt_id = c.receipt_id)"""


@query("win11_week_ends_trend", "receipts categories", f"""WITH {HISTORY_SQL}, w AS (SELECT user_id, week(date) AS week, sum(total_amount)::double AS s
 FROM history GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week) AS up,
 row_number() OVER (PARTITION BY user_id ORDER BY week DESC) AS down FROM w),
 e AS (SELECT user_id, count(*) AS weeks, avg(s) FILTER (up <= 2) AS early, avg(s) FILTER (down <= 2) AS recent FROM k GROUP BY 1)
 SELECT user_id, weeks, {r('early')} AS early_average, {r('recent')} AS recent_average, {r('(recent - early) / early * 100')} AS trend_percentage
 FROM e WHERE weeks >= 4 AND recent > early * 1.2""")
def week_ends_trend(t):
    return ops.week_ends_trend(user_history(t.receipts, t.categories))


@query("win12_split_half_trend", "receipts categories", f"""WITH {HISTORY_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS alln,
 count(*) OVER (PARTITION BY user_id, category) AS n, row_number() OVER (PARTITION BY user_id, category ORDER BY date, receipt_id) AS rn FROM history),
 s AS (SELECT user_id, category, count(*) AS data_points, avg(total_amount::double) FILTER (rn <= n // 2) AS e,
 avg(total_amount::double) FILTER (rn > n // 2) AS l FROM k WHERE alln >= 10 AND n >= 5 GROUP BY ALL),
 p AS (SELECT *, (l - e) / e * 100 AS t FROM s WHERE e > 0)
 SELECT user_id, category, data_points, {r('t')} AS trend_percentage, CASE WHEN t > 0 THEN 'aumentado' ELSE 'disminuido' END AS direction,
 CASE WHEN abs(t) > 50 THEN 'high' ELSE 'medium' END AS impact FROM p WHERE abs(t) > 25""")
def split_half_trend(t):
    return ops.split_half_trend(user_history(t.receipts, t.categories))


@query("win13_inflation_excess", "receipts users", f"""WITH {EMP}, k AS (SELECT *, row_number() OVER (PARTITION BY employer_id ORDER BY date DESC, receipt_id DESC) AS rn FROM er),
 s AS (SELECT employer_id, sum(total_amount) FILTER (rn <= 30) AS a, sum(total_amount) FILTER (rn BETWEEN 31 AND 60) AS b FROM k WHERE rn <= 60
 GROUP BY 1 HAVING count(*) >= 60), p AS (SELECT *, (a::double - b::double) / b::double * 100 AS inc FROM s)
 SELECT employer_id, {r('a')} AS recent, {r('b')} AS previous, {r('inc')} AS monthly_increase, {r('3.5::double / 12')} AS monthly_inflation
 FROM p WHERE inc > 3.5 / 12 * 2""")
def inflation_excess(t):
    return ops.inflation_excess(by_employer(t), "employer_id")


@query("win14_running_quality", "processing_metrics", f"""SELECT event_id, engine, count(*) OVER w AS samples, {r('avg(confidence) OVER w')} AS avg_confidence,
 {r('avg(processing_time) OVER w')} AS avg_processing_time, cast(sum(CASE WHEN error THEN 0 ELSE 1 END) OVER w AS bigint) AS successes,
 cast(sum(CASE WHEN error THEN 1 ELSE 0 END) OVER w AS bigint) AS failures FROM processing_metrics
 WINDOW w AS (PARTITION BY engine ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_quality(t):
    return ops.running_quality(t.processing_metrics)
