"""Queries: forecasting (F1-F4) over daily series derived from events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.columns import round_half_away
from tablesmith.operators import forecast as FC
from tablesmith.queries import register
from tablesmith.queries import sql_models as Q
from tablesmith.queries.common import T

HORIZON, SEASON = 7, 7


def event_series(spark, sf):
    return FC.series_prepare(T(spark, sf, "events"), "event_type", "ts", "value", min_len=20)


_EVENT_SERIES_SQL = """(SELECT id, day, y FROM (
    SELECT event_type AS id, CAST(ts AS DATE) AS day, greatest(sum(value), 0.0) AS y FROM events GROUP BY 1, 2) d
  WHERE id IN (SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 20))"""


@register("series_prepare", f"SELECT id, day, round(y, 6) AS y FROM {_EVENT_SERIES_SQL} s")
def q_series_prepare(spark, sf):
    return event_series(spark, sf).withColumn("y", round_half_away("y", 6))


def _order_series(spark, sf, agg, value):
    return FC.series_prepare(T(spark, sf, "orders"), "o_orderpriority", "o_orderdate", value, min_len=1, agg=agg)


_GRID_SQL = """(SELECT id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM
   (SELECT id, min(day) AS lo, max(day) AS hi FROM {src} s GROUP BY id) span)"""
_ORDER_COUNTS_SQL = ("(SELECT o_orderpriority AS id, CAST(o_orderdate AS DATE) AS day, CAST(count(o_totalprice) AS "
                     "DOUBLE) AS y FROM orders GROUP BY 1, 2)")
_ORDER_SUMS_SQL = ("(SELECT o_orderpriority AS id, CAST(o_orderdate AS DATE) AS day, greatest(sum(o_totalprice), 0.0) "
                   "AS y FROM orders GROUP BY 1, 2)")


@register("regular_series", f"""
SELECT g.id, g.day, coalesce(s.y, 0.0) AS y, CAST(s.y IS NOT NULL AS INTEGER) AS observed
FROM {_GRID_SQL.format(src=_ORDER_COUNTS_SQL)} g LEFT JOIN {_ORDER_COUNTS_SQL} s USING (id, day)""")
def q_regular_series(spark, sf):
    return FC.regular_series(_order_series(spark, sf, "count", "o_totalprice"), fill="zero")


@register("regular_series_linear", f"""
WITH f AS (SELECT g.id, g.day, s.y FROM {_GRID_SQL.format(src=_ORDER_SUMS_SQL)} g
           LEFT JOIN {_ORDER_SUMS_SQL} s USING (id, day)),
w AS (SELECT *,
  last_value(y IGNORE NULLS) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS py,
  last_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS)
    OVER (PARTITION BY id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pd,
  first_value(y IGNORE NULLS) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ny,
  first_value(CASE WHEN y IS NOT NULL THEN day END IGNORE NULLS)
    OVER (PARTITION BY id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd FROM f)
SELECT id, day, round(coalesce(y, py + (ny - py) * (date_diff('day', pd, day) / date_diff('day', pd, nd))), 4) AS y,
       CAST(y IS NOT NULL AS INTEGER) AS observed FROM w""")
def q_regular_linear(spark, sf):
    out = FC.regular_series(_order_series(spark, sf, "sum", "o_totalprice"), fill="linear")
    return out.withColumn("y", round_half_away("y", 4))


def _candidates_sql(src, horizon, season):
    return f"""
WITH s AS (SELECT * FROM {src} q),
b AS (SELECT id, min(day) AS d0 FROM s GROUP BY id),
t AS (SELECT s.id, s.day, s.y, CAST(date_diff('day', b.d0, s.day) AS DOUBLE) AS t FROM s JOIN b USING (id)),
m AS (SELECT id, max(day) AS last_day, avg(y) AS mean_y, arg_max(y, day) AS last_y, arg_min(y, day) AS first_y,
             max(t) AS last_t, regr_slope(y, t) AS slope, regr_intercept(y, t) AS icpt FROM t GROUP BY id),
h AS (SELECT m.*, hh AS h, CAST(last_day + hh * INTERVAL 1 DAY AS DATE) AS day
      FROM m, (SELECT unnest(range(1, {horizon + 1})) AS hh) r)
SELECT id, 'naive' AS model, day, last_y AS forecast FROM h
UNION ALL SELECT id, 'mean', day, mean_y FROM h
UNION ALL SELECT id, 'drift', day, last_y + h * CASE WHEN last_t > 0 THEN (last_y - first_y) / last_t ELSE 0.0 END FROM h
UNION ALL SELECT id, 'linear_trend', day, icpt + slope * (last_t + h) FROM h
UNION ALL SELECT h.id, 'seasonal_naive', h.day, s.y FROM h LEFT JOIN s
  ON s.id = h.id AND s.day = CAST(h.day - CAST(ceil(h.h / {season}) * {season} AS INTEGER) * INTERVAL 1 DAY AS DATE)"""


@register("forecast_multi", f"""SELECT id, model, day, round(forecast, 6) AS forecast FROM
({_candidates_sql(_EVENT_SERIES_SQL, HORIZON, SEASON)}) c""")
def q_forecast_multi(spark, sf):
    s = FC.regular_series(event_series(spark, sf), fill="zero").select("id", "day", "y")
    out = FC.forecast_candidates(s, HORIZON, SEASON)
    return out.withColumn("forecast", round_half_away("forecast", 6))


_AFTER = f"""(SELECT id, CAST(l + h * INTERVAL 1 DAY AS DATE) AS day FROM
  (SELECT id, max(day) AS l FROM {_EVENT_SERIES_SQL} s GROUP BY id) m, (SELECT unnest(range(1, {HORIZON + 1})) AS h) r)"""


_FILLED_SQL = f"""(SELECT g.id, g.day, coalesce(s.y, 0.0) AS y FROM {_GRID_SQL.format(src=_EVENT_SERIES_SQL)} g
  LEFT JOIN {_EVENT_SERIES_SQL} s USING (id, day))"""
_HOLT_SQL = "SELECT id, '{0}' AS model, day, round(forecast, 4) AS forecast FROM ({1})"


@register("forecast_holt", _HOLT_SQL.format("holt", Q.holt_sql(_EVENT_SERIES_SQL, HORIZON, FC.ALPHAS, FC.BETAS)))
def q_forecast_holt(spark, sf):
    """Holt's linear smoothing per series; the oracle steps through the days in a recursive query."""
    return FC.forecast_holt(event_series(spark, sf), HORIZON).withColumn("forecast", round_half_away("forecast", 4))


@register("forecast_smoothing", " UNION ALL ".join([
    _HOLT_SQL.format("holt", Q.holt_sql(_FILLED_SQL, HORIZON, FC.ALPHAS, FC.BETAS)),
    _HOLT_SQL.format("holt_winters", Q.holt_sql(_FILLED_SQL, HORIZON, FC.ALPHAS, FC.BETAS, FC.GAMMAS, SEASON))]))
def q_forecast_smoothing(spark, sf):
    """Holt and Holt-Winters with a weekly season."""
    s = FC.regular_series(event_series(spark, sf), fill="zero").select("id", "day", "y")
    return FC.forecast_smoothing(s, HORIZON, SEASON).withColumn("forecast", round_half_away("forecast", 4))


DESIGN = FC.Design(breaks=2, weekly=2, holidays=("month start",))


def month_starts(series):
    """A holiday table: the first day of every month between the series' first day and the horizon's end."""
    span = series.agg(F.min("day").alias("lo"), F.date_add(F.max("day"), HORIZON).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.where(F.dayofmonth("day") == 1).select(F.lit("month start").alias("name"), "day")


@register("forecast_regression", f"""SELECT id, model, day, round(forecast, 4) AS forecast FROM ({Q.regression_forecast_sql(
    _FILLED_SQL, HORIZON, 2, DESIGN.break_share, 2, DESIGN.break_penalty, DESIGN.season_penalty, "day(day) = 1")})""")
def q_forecast_regression(spark, sf):
    """Trend with two breaks, weekly season and month starts; the oracle solves the same normal equations."""
    s = FC.regular_series(event_series(spark, sf), fill="zero").select("id", "day", "y")
    return FC.forecast_regression(s, HORIZON, DESIGN, month_starts(s)).withColumn("forecast", round_half_away("forecast", 4))


@register("forecast_select_all", f"""SELECT id, 8 AS n_models, 1 AS n_best, 1 AS ranks_complete FROM
(SELECT DISTINCT id FROM {_EVENT_SERIES_SQL} s) i""")
def q_forecast_select_all(spark, sf):
    """Every candidate, smoothing and regression included, ranked per series: eight ranks and one best."""
    s = FC.regular_series(event_series(spark, sf), fill="zero").select("id", "day", "y")
    out = FC.forecast_select(s, HORIZON, SEASON, design=DESIGN, holidays=month_starts(s))
    n = F.count(F.lit(1))
    return out.groupBy("id").agg(n.cast("int").alias("n_models"), F.sum("best").cast("int").alias("n_best"),
                                 (F.sum("rank") == n * (n + 1) / 2).cast("int").alias("ranks_complete"))


_HOLD_SRC = f"""(SELECT s.* FROM {_EVENT_SERIES_SQL} s JOIN (SELECT id, max(day) AS l FROM {_EVENT_SERIES_SQL} x
  GROUP BY id) m USING (id) WHERE s.day <= CAST(m.l - INTERVAL {HORIZON} DAY AS DATE))"""


@register("forecast_select", f"""
WITH fc AS ({_candidates_sql(_HOLD_SRC, HORIZON, SEASON)}),
te AS (SELECT s.id, s.day, s.y AS actual FROM {_EVENT_SERIES_SQL} s JOIN (SELECT id, max(day) AS l
       FROM {_EVENT_SERIES_SQL} x GROUP BY id) m USING (id) WHERE s.day > CAST(m.l - INTERVAL {HORIZON} DAY AS DATE)),
sc AS (SELECT fc.id, fc.model, avg(CASE WHEN abs(actual) + abs(forecast) = 0 THEN 0.0
         ELSE 2 * abs(actual - forecast) / (abs(actual) + abs(forecast)) END) AS smape
       FROM fc JOIN te ON fc.id = te.id AND fc.day = te.day GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY smape, model) AS INTEGER) AS rank FROM sc)
SELECT id, model, round(smape, 6) AS smape, rank, CAST(rank = 1 AS INTEGER) AS best FROM r""")
def q_forecast_select(spark, sf):
    out = FC.forecast_select(event_series(spark, sf), HORIZON, SEASON, with_holt=False)
    return out.withColumn("smape", round_half_away("smape", 6))



