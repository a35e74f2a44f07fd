"""Forecasting many series at once.

A series is (id, day, y).  Every candidate model is computed for all series
in one grouped job: per-series summaries are one row per series, and
horizon rows are ``sequence``-exploded from them, so the work grows with
ids x horizon.  Windows are partitioned by series id; after the daily
grouping a series holds at most one row per calendar day, so one series
never exceeds its calendar length.  Smoothing (Holt's trend, and Holt-Winters with an
additive season) runs per series in ``applyInPandas`` (one group = one series' daily
values), all parameter settings at once in numpy.  The regression forecaster needs of a series
only sums of products of its design columns: one grouped aggregate, then a k x k solution a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.columns import clip_lower, known
from tablesmith.session import cut_lineage

CANDIDATES = ("naive", "mean", "seasonal_naive", "drift", "linear_trend")


def series_prepare(df: DataFrame, id_col: str, date_col: str, value_col: str, min_len: int = 100,
                   agg: str = "sum", clip: bool = True) -> DataFrame:
    """parse dates, one value per (id, day) from the values that are there, negatives -> 0, series with at
    least ``min_len`` days.  Output (id, day, y); T3 sorts it where an order is wanted."""
    day = F.to_date(F.col(date_col))
    fn = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max}[agg]
    daily = df.groupBy(F.col(id_col).alias("id"), day.alias("day")).agg(fn(known(df, value_col)).cast("double").alias("y"))
    if clip:
        daily = daily.withColumn("y", clip_lower("y", 0.0))
    # a series holds at most one row per calendar day, so a count per series is a bounded window
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return daily.withColumn("_n", n).where(F.col("_n") >= min_len).drop("_n")


def regular_series(series: DataFrame, fill: str | None = "zero") -> DataFrame:
    """one row per id and day between its first and last day.

    fill: None (missing stays null), "zero", "ffill" (last known) or "linear"
    (straight line between the known neighbours).  Output (id, day, y, observed).
    """
    series = cut_lineage(series.select("id", "day", "y"))   # small (ids x days); read twice below
    span = series.groupBy("id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = span.select("id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    full = grid.join(series.select("id", "day", "y"), ["id", "day"], "left") \
        .withColumn("observed", F.col("y").isNotNull().cast("int"))
    if fill is None:
        return full
    if fill == "zero":
        return full.withColumn("y", F.coalesce("y", F.lit(0.0)))
    before = Window.partitionBy("id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("id").orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    known_day = F.when(F.col("y").isNotNull(), F.col("day"))
    full = full.withColumns({
        "_py": F.last("y", ignorenulls=True).over(before), "_pd": F.last(known_day, ignorenulls=True).over(before),
        "_ny": F.first("y", ignorenulls=True).over(after), "_nd": F.first(known_day, ignorenulls=True).over(after)})
    if fill == "ffill":
        out = F.coalesce("y", "_py")
    else:
        gap = F.datediff("_nd", "_pd")
        frac = F.datediff("day", "_pd") / gap
        out = F.coalesce("y", F.col("_py") + (F.col("_ny") - F.col("_py")) * frac)
    return full.withColumn("y", out).drop("_py", "_pd", "_ny", "_nd")


def _summaries(series: DataFrame) -> DataFrame:
    base = series.groupBy("id").agg(F.min("day").alias("d0"))
    s = series.join(base, "id").withColumn("t", F.datediff("day", "d0").cast("double"))
    return s.groupBy("id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("y").alias("n"),
        F.avg("y").alias("mean_y"), F.max_by("y", "day").alias("last_y"), F.min_by("y", "day").alias("first_y"),
        F.max("t").alias("last_t"), F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("icpt"))


def forecast_candidates(series: DataFrame, horizon: int = 30, season: int = 7,
                        models: Sequence[str] = CANDIDATES) -> DataFrame:
    """forecasts (id, model, day, forecast) for ``horizon`` days after each
    series' last day.  ``series`` should be regular (F2) for seasonal_naive."""
    series = cut_lineage(series.select("id", "day", "y"))   # feeds every candidate: written once
    s = _summaries(series)
    h = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")) \
        .withColumn("day", F.date_add("last_day", F.col("h")))
    out = []
    if "naive" in models:
        out.append(h.select("id", F.lit("naive").alias("model"), "day", F.col("last_y").alias("forecast")))
    if "mean" in models:
        out.append(h.select("id", F.lit("mean").alias("model"), "day", F.col("mean_y").alias("forecast")))
    if "drift" in models:
        slope = F.when(F.col("last_t") > 0, (F.col("last_y") - F.col("first_y")) / F.col("last_t")).otherwise(0.0)
        out.append(h.select("id", F.lit("drift").alias("model"), "day",
                            (F.col("last_y") + F.col("h") * slope).alias("forecast")))
    if "linear_trend" in models:
        out.append(h.select("id", F.lit("linear_trend").alias("model"), "day",
                            (F.col("icpt") + F.col("slope") * (F.col("last_t") + F.col("h"))).alias("forecast")))
    if "seasonal_naive" in models:
        k = F.ceil(F.col("h") / F.lit(season))
        ref = h.select("id", "day", F.date_sub("day", (k * season).cast("int")).alias("ref_day"))
        past = series.select("id", F.col("day").alias("ref_day"), F.col("y").alias("forecast"))
        out.append(ref.join(past, ["id", "ref_day"], "left")
                   .select("id", F.lit("seasonal_naive").alias("model"), "day", "forecast"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# fixed values: smoothing constants that are tried
ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.1, 0.3), (0.05, 0.2, 0.5)


def smooth(y: np.ndarray, horizon: int, season: int | None = None) -> np.ndarray:
    """Exponential smoothing forecasts of one series, the constants chosen by in-sample one-step squared error.

    Without ``season``: Holt's linear trend.  With it: Holt-Winters, additive season, started from the first
    two seasons (a series shorter than that has none).  One loop over the days; all settings step together.
    """
    if len(y) < 2:
        return np.full(horizon, y[-1] if len(y) else np.nan)
    m = season if season and len(y) >= 2 * season else 1
    a, b, g = (x.ravel() for x in np.meshgrid(ALPHAS, BETAS, GAMMAS if m > 1 else (0.0,), indexing="ij"))
    if m > 1:
        level = np.full(len(a), y[:m].mean())
        trend = np.full(len(a), (y[m:2 * m].mean() - y[:m].mean()) / m)
        cycle = np.tile(y[:m] - y[:m].mean(), (len(a), 1))
        start = m
    else:
        level, trend, cycle = np.full(len(a), y[0]), np.full(len(a), y[1] - y[0]), np.zeros((len(a), 1))
        start = 1
    error = np.zeros(len(a))
    for t in range(start, len(y)):
        k = t % m
        ahead = level + trend
        error += (y[t] - ahead - cycle[:, k]) ** 2
        new = a * (y[t] - cycle[:, k]) + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * trend
        cycle[:, k] = g * (y[t] - new) + (1 - g) * cycle[:, k]
        level = new
    i = int(error.argmin())
    h = np.arange(1, horizon + 1)
    return level[i] + h * trend[i] + cycle[i, (len(y) + h - 1) % m]


def forecast_smoothing(series: DataFrame, horizon: int = 30, season: int = 7,
                       models: Sequence[str] = ("holt", "holt_winters")) -> DataFrame:
    """F3, smoothing candidates: one ``applyInPandas`` group per series (bounded by its days).

    A missing day counts as no day; ``series`` should be regular (F2).
    """
    id_type = series.schema["id"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["y"]).sort_values("day")
        if not len(pdf):
            return pd.DataFrame({"id": [], "model": [], "day": [], "forecast": []})
        last = pd.Timestamp(pdf["day"].iloc[-1])
        days = [(last + pd.Timedelta(days=i)).date() for i in range(1, horizon + 1)]
        return pd.concat([pd.DataFrame({"id": pdf["id"].iloc[0], "model": m, "day": days, "forecast": smooth(
            pdf["y"].to_numpy(dtype=float), horizon, season if m == "holt_winters" else None)}) for m in models])

    return series.select("id", "day", "y").groupBy("id").applyInPandas(
        fit, f"id {id_type}, model string, day date, forecast double")


# ---------------------------------------------------------------- regression on trend breaks, seasons and holidays

@dataclass(frozen=True)
class Design:
    """Columns of the regression: a straight trend, ``breaks`` changes of slope spread over the first
    ``break_share`` of the series, Fourier pairs of a week and a year, and one indicator per holiday name.

    Penalties (ridge, on columns of the order of 1, times the number of days) keep what the days do not decide near 0; a
    change of slope costs more than a season.
    """
    breaks: int = 5
    break_share: float = 0.8
    weekly: int = 3
    yearly: int = 0
    holidays: tuple[str, ...] = ()
    break_penalty: float = 0.01
    season_penalty: float = 1e-4

    def columns(self, day: Column, t: Column, holidays: Column) -> list[tuple[Column, float]]:
        """(column, penalty) pairs.  ``t`` is 0 on the first day and 1 on the last; ``holidays`` lists the day's names."""
        number = F.datediff(day, F.lit("1970-01-01").cast("date"))
        out = [(F.lit(1.0), 0.0), (t, 0.0)]
        for j in range(1, self.breaks + 1):
            out.append((F.greatest(F.lit(0.0), t - F.lit(self.break_share * j / (self.breaks + 1))), self.break_penalty))
        for n in range(1, self.weekly + 1):
            angle = F.lit(2 * math.pi * n / 7) * F.pmod(number, F.lit(7))
            out += [(F.sin(angle), self.season_penalty), (F.cos(angle), self.season_penalty)]
        for n in range(1, self.yearly + 1):
            angle = F.lit(2 * math.pi * n / 365.25) * number
            out += [(F.sin(angle), self.season_penalty), (F.cos(angle), self.season_penalty)]
        out += [(F.array_contains(holidays, name).cast("double"), self.season_penalty) for name in self.holidays]
        return out


def _with_holidays(days: DataFrame, holidays: DataFrame | None) -> DataFrame:
    """``days`` with the list of holiday names of each day (``holidays``: name, day; a bounded calendar)."""
    if holidays is None:
        return days.withColumn("_names", F.array().cast("array<string>"))
    names = holidays.groupBy(F.to_date("day").alias("day")).agg(F.collect_set("name").alias("_names"))
    return days.join(names, "day", "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))


def regression_coefficients(series: DataFrame, design: Design = Design(), holidays: DataFrame | None = None) -> DataFrame:
    """F3, regression: (id, first_day, last_day, coefficients) per series.

    The normal equations of every series are sums of products from one grouped aggregate; each is solved on its
    k x k numbers.  Days without a value are left out.
    """
    known = series.select("id", "day", F.col("y").cast("double").alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    span = known.groupBy("id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    rows = _with_holidays(known.join(span, "id"), holidays)
    t = F.datediff("day", "first_day") / F.greatest(F.lit(1), F.datediff("last_day", "first_day"))
    parts = design.columns(F.col("day"), t, F.col("_names"))
    k = len(parts)
    rows = rows.select("id", "first_day", "last_day", "y", *[c.cast("double").alias(f"x{i}") for i, (c, _) in enumerate(parts)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.groupBy("id", "first_day", "last_day").agg(
        F.count("y").alias("n"), F.array(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).alias("xx"),
        F.array(*[F.sum(F.col(f"x{i}") * F.col("y")) for i in range(k)]).alias("xy"))
    penalty = np.diag([p for _, p in parts])
    upper = tuple(np.array(pairs).T)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            m = np.zeros((len(n), k, k))
            sums = np.array(batch.column("xx").to_pylist()).reshape(len(n), -1)
            m[:, upper[0], upper[1]] = sums
            m[:, upper[1], upper[0]] = sums
            m += n[:, None, None] * (penalty + 1e-12 * np.eye(k))
            b = np.array(batch.column("xy").to_pylist()).reshape(len(n), k, 1)
            found = np.linalg.solve(m, b)[:, :, 0] if len(n) else np.zeros((0, k))
            keep = [batch.column(c) for c in ("id", "first_day", "last_day")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(list(found), pa.list_(pa.float64()))],
                                             names=["id", "first_day", "last_day", "coefficients"])

    id_type = series.schema["id"].dataType.simpleString()
    return sums.mapInArrow(solve, f"id {id_type}, first_day date, last_day date, coefficients array<double>")


def forecast_regression(series: DataFrame, horizon: int = 30, design: Design = Design(), holidays: DataFrame | None = None) -> DataFrame:
    """(id, model, day, forecast) of a trend with breaks, Fourier seasons and holidays, fitted per series."""
    fitted = regression_coefficients(series, design, holidays)
    h = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("day", F.date_add("last_day", F.col("h")))
    h = _with_holidays(h, holidays)
    t = F.datediff("day", "first_day") / F.greatest(F.lit(1), F.datediff("last_day", "first_day"))
    total = F.lit(0.0)
    for i, (c, _) in enumerate(design.columns(F.col("day"), t, F.col("_names"))):
        total = total + F.col("coefficients")[i] * c
    return h.select("id", F.lit("regression").alias("model"), "day", total.alias("forecast"))


def forecast_holt(series: DataFrame, horizon: int = 30) -> DataFrame:
    """Holt's linear trend alone."""
    return forecast_smoothing(series, horizon, models=("holt",))


def forecast_multi(series: DataFrame, horizon: int = 30, season: int = 7, with_holt: bool = True,
                   design: Design | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """all candidates for every series; with ``design`` the regression, too."""
    out = forecast_candidates(series, horizon, season)
    if with_holt:
        out = out.unionByName(forecast_smoothing(series, horizon, season))
    return out.unionByName(forecast_regression(series, horizon, design, holidays)) if design else out


def forecast_select(series: DataFrame, horizon: int = 30, season: int = 7, with_holt: bool = True,
                    design: Design | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """hold out each series' last ``horizon`` days, score every candidate by
    sMAPE on them, rank per series (ties by model name).  Output (id, model,
    smape, rank, best)."""
    series = cut_lineage(series.select("id", "day", "y"))   # train and hold-out both read it
    last = series.groupBy("id").agg(F.max("day").alias("_last"))
    tagged = series.join(last, "id").withColumn("_hold", F.col("day") > F.date_sub("_last", horizon))
    train = tagged.where(~F.col("_hold")).select("id", "day", "y")
    test = tagged.where(F.col("_hold")).select("id", "day", F.col("y").alias("actual"))
    fc = forecast_multi(train, horizon, season, with_holt, design, holidays)
    y, p = F.col("actual"), F.col("forecast")
    den = F.abs(y) + F.abs(p)
    term = F.when(den == 0, F.lit(0.0)).otherwise(2 * F.abs(y - p) / den)
    scored = fc.join(test, ["id", "day"]).groupBy("id", "model").agg(F.avg(term).alias("smape"))
    w = Window.partitionBy("id").orderBy(F.col("smape").asc_nulls_last(), "model")  # models per series: bounded
    return scored.withColumn("rank", F.row_number().over(w)).withColumn("best", (F.col("rank") == 1).cast("int"))
