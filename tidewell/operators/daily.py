"""Daily points, the two tiers, and series built on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import correlation, mean_over, rounded
from ..functions.time import local_day
from ..schema import MAX_DAYS


def daily_points(samples: DataFrame, tz="UTC") -> DataFrame:
    """One row per user, metric, local day and unit; null values are left out."""
    return (
        samples.where("value is not null")
        .groupBy("user_id", "metric_type", local_day(F.col("started_at"), tz).alias("date"), F.coalesce("unit", F.lit("")).alias("unit"))
        .agg(rounded(F.avg("value"), 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), rounded(F.sum("value"), 4).alias("sum_value"), F.count("value").alias("sample_count"))
    )


def with_zones(samples: DataFrame, zones: DataFrame, default: str = "UTC") -> DataFrame:
    """Samples with `time_zone`, their user's zone of the settings table (user_id, time_zone; unique by user), or the default.

    daily_points and the other functions take F.col("time_zone") as their zone.
    """
    return samples.join(zones.select("user_id", "time_zone"), "user_id", "left").withColumn("time_zone", F.coalesce("time_zone", F.lit(default)))


def tiered_daily(samples: DataFrame, summaries: DataFrame, tz="UTC") -> DataFrame:
    """Summaries where a day has any, else points from raw samples; a day never comes from both (whatever its units)."""
    points = ["user_id", "metric_type", "date", "unit", "avg_value", "min_value", "max_value", "sum_value", "sample_count"]
    done = summaries.withColumnRenamed("summary_date", "date")
    raw = daily_points(samples, tz).join(done.select("user_id", "metric_type", "date"), ["user_id", "metric_type", "date"], "left_anti")
    return done.select(*points, F.lit("summary").alias("tier")).unionByName(raw.select(*points, F.lit("raw").alias("tier")))


def unit_votes(points: DataFrame) -> DataFrame:
    """Per user and metric the unit with most points (ties: first by name), and the points of other units."""
    n = points.groupBy("user_id", "metric_type", "unit").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id", "metric_type")
    ranked = n.withColumn("rn", F.row_number().over(w.orderBy(F.col("n").desc(), "unit"))).withColumn("total", F.sum("n").over(w))
    return ranked.where("rn = 1").select("user_id", "metric_type", "unit", F.col("n").alias("points"), (F.col("total") - F.col("n")).alias("other_points"))


def single_unit(points: DataFrame) -> DataFrame:
    """Points of each user's and metric's majority unit: as unit_votes chooses, with one shuffle of the points and no second scan."""
    own = points.repartition("user_id", "metric_type").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "metric_type", "unit")))
    best = F.min(F.struct(-F.col("_n"), F.col("unit"))).over(Window.partitionBy("user_id", "metric_type"))
    return own.withColumn("_best", best).where(F.col("_best.unit") == F.col("unit")).drop("_n", "_best")


def tier_status(points: DataFrame) -> DataFrame:
    return points.groupBy("user_id", "metric_type").agg(F.count_if(F.col("tier") == "summary").alias("summary_points"), F.count_if(F.col("tier") == "raw").alias("raw_points"))


def weighted_mean(decimals: int = 2) -> Column:
    """Mean of samples over daily points."""
    return rounded(F.sum("sum_value") / F.nullif(F.sum("sample_count"), F.lit(0)), decimals)


def daily_value(points: DataFrame, cumulative: tuple[str, ...]) -> DataFrame:
    """A day's value: its total for cumulative metrics, else its mean."""
    return points.withColumn("day_value", F.when(F.col("metric_type").isin(*cumulative), F.col("sum_value")).otherwise(F.col("avg_value")))


def metric_stats(points: DataFrame) -> DataFrame:
    """Personal baselines over daily values: moments and exact percentiles."""
    p = F.percentile("day_value", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = points.groupBy("user_id", "metric_type").agg(
        F.count("day_value").alias("n"), rounded(F.min("day_value"), 2).alias("min"), rounded(F.max("day_value"), 2).alias("max"),
        rounded(F.avg("day_value"), 2).alias("mean"), rounded(F.stddev_pop("day_value"), 2).alias("std"), p.alias("p"),
    )
    return out.select("user_id", "metric_type", "n", "min", "max", "mean", "std", *[rounded(F.col("p")[i], 2).alias(f"p{n}") for i, n in enumerate((10, 25, 50, 75, 90))])


def trend_halves(points: DataFrame, k: int = 7) -> DataFrame:
    """Newest k daily points against the k before them: each day's mean to one decimal, and the difference of the means of these, to one; null with fewer than 2k points.

    recent and prior are those means to two decimals.
    """
    w = Window.partitionBy("user_id", "metric_type").orderBy(F.col("date").desc(), "unit")
    r = points.where("avg_value is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2 * k)
    of = lambda when: F.avg(F.when(when, rounded("avg_value", 1)))
    g = r.groupBy("user_id", "metric_type").agg(F.count(F.lit(1)).alias("points"), of(F.col("rn") <= k).alias("_recent"), of(F.col("rn") > k).alias("_prior"))
    d = F.when(F.col("points") >= 2 * k, rounded(F.col("_recent") - F.col("_prior"), 1))
    told = g.select("user_id", "metric_type", "points", rounded("_recent", 2).alias("recent"), rounded("_prior", 2).alias("prior"), d.alias("delta"))
    return told.withColumn("trend", F.when(F.col("delta") > 0, "improving").when(F.col("delta") < 0, "declining").when(F.col("delta") == 0, "stable"))


def trend_answer(points: DataFrame, since: Column | None = None, k: int = 7) -> DataFrame:
    """The whole trend of every user's metric, of daily points of one unit from the day `since` on: days_with_data, avg (mean over samples), latest (newest day's mean, one decimal), unit, points by tier, delta and trend of trend_halves."""
    here = points if since is None else points.where(F.col("date") >= since)
    told = here.groupBy("user_id", "metric_type").agg(
        F.count("avg_value").alias("days_with_data"), weighted_mean().alias("avg"), rounded(F.max_by("avg_value", F.when(F.col("avg_value").isNotNull(), F.col("date"))), 1).alias("latest"), F.min("unit").alias("unit"),
        F.count_if(F.col("tier") == "summary").alias("summary_points"), F.count_if(F.col("tier") == "raw").alias("raw_points"),
    )
    return told.join(trend_halves(here, k).select("user_id", "metric_type", "delta", "trend"), ["user_id", "metric_type"], "left")


def checked_periods(periods: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """Two periods by label, labels cut to 32 characters; ValueError unless dates are YYYY-MM-DD, in order, and no further apart than MAX_DAYS."""
    out = {}
    for label, dates in periods.items():
        first, last = (datetime.strptime(d, "%Y-%m-%d") for d in dates)
        if first > last:
            raise ValueError("a period ends before it begins")
        if (last - first).days > MAX_DAYS:
            raise ValueError(f"a period is longer than {MAX_DAYS} days")
        out[str(label)[:32]] = (f"{first:%Y-%m-%d}", f"{last:%Y-%m-%d}")
    if len(out) != 2:
        raise ValueError("two periods with labels of their own are needed")
    return out


def compare_periods(points: DataFrame, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """Two named date ranges (inclusive) side by side: n, mean, change and percent change of the rounded difference."""
    (a, (a0, a1)), (b, (b0, b1)) = checked_periods(periods).items()
    v, d = F.col("day_value"), F.col("date")
    ina, inb = d.between(F.lit(a0).cast("date"), F.lit(a1).cast("date")), d.between(F.lit(b0).cast("date"), F.lit(b1).cast("date"))
    out = points.where(ina | inb).groupBy("user_id", "metric_type").agg(
        F.count(F.when(ina, v)).alias(f"{a}_n"), rounded(F.avg(F.when(ina, v)), 2).alias(f"{a}_avg"), F.count(F.when(inb, v)).alias(f"{b}_n"), rounded(F.avg(F.when(inb, v)), 2).alias(f"{b}_avg")
    )
    delta = rounded(F.col(f"{b}_avg") - F.col(f"{a}_avg"), 2)
    return out.withColumn("delta", delta).withColumn("pct_change", rounded(100 * delta / F.nullif(F.col(f"{a}_avg"), F.lit(0.0)), 1))


def threshold_days(points: DataFrame, low: float | None = None, high: float | None = None, limit: int = 100) -> DataFrame:
    """Days whose value lies in [low, high], highest first; ties keep the earlier day."""
    v = F.col("day_value")
    ok = v.isNotNull() & (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high)
    w = Window.partitionBy("user_id", "metric_type").orderBy(v.desc(), "date")
    return points.where(ok).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def period_rollup(points: DataFrame, grain: str = "month") -> DataFrame:
    """Plain mean of daily values per month, week, year or season."""
    if grain == "season":
        m = F.month("date")
        bucket = F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")
    else:
        bucket = F.date_trunc(grain, "date").cast("date").cast("string")
    return points.groupBy("user_id", "metric_type", bucket.alias("bucket")).agg(rounded(F.avg("day_value"), 2).alias("mean"), F.count_distinct("date").alias("days"))


def runs(points: DataFrame, condition: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive days on which the condition holds: first day, last day, length."""
    days = points.where(condition).select("user_id", "metric_type", "date").distinct()
    w = Window.partitionBy("user_id", "metric_type").orderBy("date")
    island = days.withColumn("island", F.date_sub("date", F.row_number().over(w)))
    return island.groupBy("user_id", "metric_type", "island").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("days")).where(F.col("days") >= least).drop("island")


def lagged(points: DataFrame, first: str, second: str, lag_days: int = 1) -> DataFrame:
    """Pairs (a, b) of a metric's day and another one's lag_days later, under the later date."""
    own = lambda m, c: points.where(F.col("metric_type") == m).groupBy("user_id", "date").agg(F.avg("day_value").alias(c))
    a = own(first, "a").withColumn("date", F.date_add("date", lag_days))
    return a.join(own(second, "b"), ["user_id", "date"])


def lagged_pair(points: DataFrame, first: str, second: str, lag_days: int = 1) -> DataFrame:
    """A metric and another one lag_days later, by day: number of pairs, both means and their correlation."""
    pairs = lagged(points, first, second, lag_days)
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg("a"), 2).alias("first_mean"), rounded(F.avg("b"), 2).alias("second_mean"), correlation("a", "b").alias("corr"))


def below_average_days(points: DataFrame, share: float = 0.2) -> DataFrame:
    """Days more than `share` below the user's own mean; a day right at the bound does not change sides with the order of rows."""
    w = Window.partitionBy("user_id", "metric_type")
    return points.withColumn("own_mean", mean_over("day_value", w)).where(F.col("day_value") < (1 - share) * F.col("own_mean")).withColumn("own_mean", rounded("own_mean", 2))
