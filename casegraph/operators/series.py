"""Weekly series: dense weeks, temporal split, Holt's linear smoothing by grid search, forecasts with intervals, errors.

A series is fitted inside one row, by folding over its array of weekly counts (its length is the number of weeks, not of
cases); the grid is a cross of 77 parameter pairs that is exploded a series at a time.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.functions.scores import crc_id, half_up, monday

# The grid and the horizons (days: weeks).
ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
BETAS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
HORIZONS = {7: 1.0, 14: 2.0, 30: 4.2857}


def weekly(rows: DataFrame, series: str, day: str) -> DataFrame:
    """(series, week, case_count): counts by Monday; weeks between a series' first and last have 0."""
    counts = rows.where(F.col(day).isNotNull()).groupBy(series, monday(F.col(day)).alias("week")).agg(F.count(F.lit(1)).alias("case_count"))
    span = counts.groupBy(series).agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    every = span.select(series, F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    return every.join(counts, [series, "week"], "left").select(series, "week", F.coalesce("case_count", F.lit(0)).alias("case_count"))


def well_formed(rows: DataFrame, series: list[str], week: str = "time_bucket", count: str = "case_count") -> DataFrame:
    """Rows with a series, a date and a finite count that isn't negative; a count of 0 is a count."""
    n = F.try_to_number(F.col(count), F.lit("S999999999999D999")) if dict(rows.dtypes)[count] == "string" else F.col(count)
    n = n.cast("double")
    known = F.lit(True)
    for c in series:
        known = known & F.col(c).isNotNull() & (F.length(F.col(c).cast("string")) > 0)
    return rows.withColumns({week: F.try_to_timestamp(F.col(week).cast("string")).cast("date"), count: n}).where(known & F.col(week).isNotNull() & (n >= 0) & (n < float("inf")) & ~F.isnan(n))


def merged_weeks(rows: DataFrame, series: list[str], week: str = "time_bucket", count: str = "case_count") -> DataFrame:
    """One row a series and Monday: counts of the same week are summed."""
    return rows.groupBy(*series, monday(F.col(week)).alias("week")).agg(F.sum(count).alias("case_count"))


def features(cases: DataFrame, unit: str, day: str, kind: str, gravity: str, lat: str, lon: str, bin_degrees: float = 0.05) -> DataFrame:
    """(unit, week, kind): the number of cases, their mean gravity, and the bins of their mean place."""
    by = cases.where(F.col(day).isNotNull()).groupBy(F.col(unit).alias("unit"), monday(F.col(day)).alias("week"), F.col(kind).alias("kind"))
    found = by.agg(F.count(F.lit(1)).alias("case_count"), half_up(F.avg(gravity), 2).alias("avg_gravity"), F.avg(lat).alias("la"), F.avg(lon).alias("lo"))
    return found.select("unit", "week", "kind", "case_count", "avg_gravity", F.floor(F.col("la") / bin_degrees).alias("lat_bin"), F.floor(F.col("lo") / bin_degrees).alias("lon_bin"))


def macro_average(per_series: DataFrame) -> DataFrame:
    """The mean of each measure over series, each counting the same; a measure that a series lacks isn't counted for it."""
    return per_series.agg(F.count(F.lit(1)).alias("series"), *(half_up(F.avg(m), 3).alias(m) for m in ("mae", "rmse", "mape")))


def forecast_ids(forecasts: DataFrame, series: list[str], model_version: str, snapshot: str) -> DataFrame:
    """Forecasts with an id that follows from what was forecast, by which model, from which snapshot: running again replaces."""
    return forecasts.withColumn("forecast_id", crc_id("FCT_", *(F.col(c).cast("string") for c in [*series, "horizon_days"]), F.lit(model_version), F.lit(snapshot)))


def model_version(rows: DataFrame, series: list[str], snapshot: str | None, training_version: int = 1) -> str:
    """A name that follows from the training version, the rows, the series and the snapshot."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(*series).alias("g")).first()
    seed = "|".join(sorted([f"fc-v{training_version}", f"n-{n['n']}", f"g-{n['g']}", f"snapshot-{snapshot or 'unknown'}"]))
    return f"FC_v{training_version}_{zlib.crc32(seed.encode()):08x}"


def temporal_split(dense: DataFrame, series: str, share: float = 0.2) -> DataFrame:
    """Rows with ``part``: the last max(1, round(share * n)) weeks of a series are for validation."""
    order = Window.partitionBy(series).orderBy("week")
    numbered = dense.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(series)))
    held = F.greatest(F.lit(1), F.floor(F.col("n") * share + 0.5))
    return numbered.select(series, "week", "case_count", F.when(F.col("i") > F.col("n") - held, "validation").otherwise("train").alias("part"))


_FOLD = "aggregate(slice(v, 2, size(v) - 1), named_struct('l', v[0], 't', v[1] - v[0], 'sse', 0D), (s, x) -> named_struct('l', alpha * x + (1 - alpha) * (s.l + s.t), 't', beta * ((alpha * x + (1 - alpha) * (s.l + s.t)) - s.l) + (1 - beta) * s.t, 'sse', s.sse + (x - (s.l + s.t)) * (x - (s.l + s.t))))"


def holt_fit(dense: DataFrame, series: str, least: int = 3) -> DataFrame:
    """(series, alpha, beta, level, trend, sse, n): the grid's first least sum of squared one-step errors.

    ``least``: weeks that a series must have, 3 for a model to be kept and 2 for a forecast of the moment."""
    arrays = dense.groupBy(series).agg(F.transform(F.sort_array(F.collect_list(F.struct("week", "case_count"))), lambda x: x["case_count"].cast("double")).alias("v")).where(F.size("v") >= least)
    grid = F.array(*(F.struct(F.lit(i * len(BETAS) + j).alias("g"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for i, a in enumerate(ALPHAS) for j, b in enumerate(BETAS)))
    tried = arrays.withColumn("p", F.explode(grid)).select(series, "v", "p.*").withColumn("f", F.expr(_FOLD))
    best = tried.groupBy(series).agg(F.min_by(F.struct("alpha", "beta", "f", F.size("v").alias("n")), F.struct(F.col("f.sse").alias("e"), "g")).alias("b"))
    return best.select(series, "b.alpha", "b.beta", F.col("b.f.l").alias("level"), F.col("b.f.t").alias("trend"), F.col("b.f.sse").alias("sse"), "b.n")


def holt_forecast(fitted: DataFrame, series: str) -> DataFrame:
    """(series, horizon_days, predicted, low, high): whole weeks and a fraction of the next, with 95 % bounds, none below 0.

    The prediction sums weeks as they are; the bounds sum weeks rounded to three digits."""
    at = lambda h: F.greatest(F.lit(0.0), F.col("level") + h * F.col("trend"))
    spread = lambda h: 1.96 * F.sqrt(F.col("sse") / F.greatest(F.col("n") - 1, F.lit(1))) * F.sqrt(F.lit(float(h)))
    week = {h: {"predicted": at(h), "low": half_up(F.greatest(F.lit(0.0), at(h) - spread(h)), 3), "high": half_up(at(h) + spread(h), 3)} for h in range(1, 6)}

    def over(weeks: float, what: str):
        whole = int(weeks)
        total = sum((week[h][what] for h in range(2, whole + 1)), week[1][what])
        return half_up(total + (weeks - whole) * week[whole + 1][what] if weeks > whole else total, 3)

    rows = F.array(*(F.struct(F.lit(d).alias("horizon_days"), *(over(w, x).alias(x) for x in ("predicted", "low", "high"))) for d, w in HORIZONS.items()))
    return fitted.select(series, F.explode(rows).alias("r")).select(series, "r.*")


def errors(pairs: DataFrame, by: str) -> DataFrame:
    """MAE, RMSE and MAPE (over actual counts that aren't 0) of (actual, predicted)."""
    e = F.col("actual") - F.col("predicted")
    return pairs.groupBy(by).agg(half_up(F.avg(F.abs(e)), 3).alias("mae"), half_up(F.sqrt(F.avg(e * e)), 3).alias("rmse"), half_up(F.avg(F.when(F.col("actual") != 0, F.abs(e / F.col("actual")))) * 100, 3).alias("mape"))


def register_model(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new active models; earlier active ones of their types are superseded."""
    types = new.select(F.col("model_type").alias("t")).distinct()
    old = registry.join(types, registry["model_type"] == types["t"], "left")
    old = old.withColumn("status", F.when(F.col("t").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))).drop("t")
    return old.unionByName(new.withColumn("status", F.lit("active")))


def newest_active(registry: DataFrame) -> DataFrame:
    live = registry.where(F.col("status") == "active")
    return live.groupBy("model_type").agg(F.max_by("model_version", F.struct("created_at", "model_version")).alias("model_version"))
