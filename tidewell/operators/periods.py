"""Any number of periods of any users against daily points: a range join by prefix sums and power-of-two blocks.

Points and the bounds of the periods stand in one order by day per user, metric and unit. Running sums at a period's two
bounds give its sums and counts by subtraction; so overlapping and repeated periods cost two rows each, whatever their
length. Extremes come from two blocks of 2^j points that cover the period, looked up by place. No pair of a point and a
period is ever made, and the shuffles are on (user, metric, unit) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..schema import MAX_DAYS

_SERIES = ("user_id", "metric_type", "unit")
#: Blocks of up to 2^LEVELS points; a period has at most MAX_DAYS + 1 days and a series one point a day.
LEVELS = MAX_DAYS.bit_length() - 1
_MONEY = "decimal(28,4)"  # daily points have four decimals, so running sums in it are exact


def checked(periods: DataFrame) -> DataFrame:
    """Periods (period_id, user_id, first_day, last_day; days as dates or texts) with dates and reject_reason, null for good ones."""
    date = lambda c: F.expr(f"try_cast({c} AS date)")
    strict = lambda c: F.col(c).isNull() | F.col(c).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$")
    out = periods.withColumns({"_ok": strict("first_day") & strict("last_day"), "first_day": date("first_day"), "last_day": date("last_day")})
    reason = F.when(F.col("user_id").isNull(), "no user").when(F.col("first_day").isNull() | F.col("last_day").isNull() | ~F.col("_ok"), "bad date")
    reason = reason.when(F.col("first_day") > F.col("last_day"), "ends before it begins").when(F.date_diff("last_day", "first_day") > MAX_DAYS, f"longer than {MAX_DAYS} days")
    return out.withColumn("reject_reason", reason).drop("_ok")


def _marks(points: DataFrame, good: DataFrame) -> DataFrame:
    """Points (kind 1) with the first (0) and last (2) bounds of the periods of their users, in every series of the user."""
    series = points.select(*_SERIES).distinct()
    bounds = good.join(series, "user_id").select(*_SERIES, "period_id", F.inline(F.array(F.struct(F.col("first_day").alias("date"), F.lit(0).alias("kind")), F.struct(F.col("last_day").alias("date"), F.lit(2).alias("kind")))))
    values = {"n": "day_value is not null", "days": "true"}
    own = points.select(
        *_SERIES, F.lit(None).cast(dict(good.dtypes)["period_id"]).alias("period_id"), "date", F.lit(1).alias("kind"), *[F.expr(v).cast("long").alias(c) for c, v in values.items()],
        F.col("day_value").cast(_MONEY).alias("day_sum"), F.col("sum_value").cast(_MONEY).alias("total"), F.col("sample_count").cast("long").alias("samples"), (F.col("tier") == "summary").cast("long").alias("summary"),
    )
    return own.unionByName(bounds, allowMissingColumns=True)


def _blocks(points: DataFrame) -> DataFrame:
    """For each point of a series its place (from 1) and the extremes of the 2^j points from it on, for j from 0 to LEVELS."""
    w = Window.partitionBy(*_SERIES).orderBy("date")
    out = points.select(*_SERIES, "date", "day_value").withColumn("place", F.row_number().over(w)).withColumns({"low0": F.col("day_value"), "high0": F.col("day_value")})
    for j in range(LEVELS):
        far = lambda c: F.lead(f"{c}{j}", 1 << j).over(w)  # noqa: E731, B023
        out = out.withColumns({f"low{j + 1}": F.least(f"low{j}", far("low")), f"high{j + 1}": F.greatest(f"high{j}", far("high"))})
    return out.select(*_SERIES, "place", F.array(*[f"low{j}" for j in range(LEVELS + 1)]).alias("lows"), F.array(*[f"high{j}" for j in range(LEVELS + 1)]).alias("highs"))


def period_stats(points: DataFrame, periods: DataFrame, cumulative: tuple[str, ...]) -> DataFrame:
    """One row for each period and metric of its user, and one for each rejected period (with metric_type null).

    points: daily points of one or both tiers with day_value, one a day and unit. periods: as for `checked`, unique by
    period_id, any number, overlapping or not. Columns: period_id, user_id, first_day, last_day, reject_reason, metric_type,
    unit (that of most points in the period; ties first by name), n (days with a value), avg (mean daily total of cumulative
    metrics, else mean over samples), min, max, summary_points, raw_points. A metric that the user has at other times only
    has n = 0 and nulls. A user without any points gives one row with metric_type null and no reason.
    """
    told = checked(periods)
    good = told.where("reject_reason is null")
    w = Window.partitionBy(*_SERIES).orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ("n", "days", "day_sum", "total", "samples", "summary")
    marks = _marks(points, good).withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).where("kind <> 1")
    side = lambda c: (F.max(F.when(F.col("kind") == 2, F.col(c))) - F.max(F.when(F.col("kind") == 0, F.col(c)))).alias(c)
    spans = marks.groupBy(*_SERIES, "period_id").agg(*[side(c) for c in sums], F.max(F.when(F.col("kind") == 0, F.col("days"))).alias("before"))
    best = spans.groupBy("period_id", "user_id", "metric_type").agg(F.min_by(F.struct("unit", *sums, "before"), F.struct(-F.col("days"), F.col("unit"))).alias("s")).select("period_id", "user_id", "metric_type", "s.*")
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col("days").cast("double") + 0.5))).cast("int")
    spot = best.withColumns({"level": level, "left": (F.col("before") + 1).cast("int")}).withColumn("right", (F.col("before") + F.col("days") + 1 - F.call_function("shiftleft", F.lit(1), F.col("level"))).cast("int"))
    blocks = _blocks(points)
    at = lambda end: blocks.select(*_SERIES, F.col("place").alias(end), F.col("lows").alias(f"{end}_lows"), F.col("highs").alias(f"{end}_highs"))
    some = spot.where("days > 0").join(at("left"), [*_SERIES, "left"]).join(at("right"), [*_SERIES, "right"])
    ends = some.select("period_id", "metric_type", *[rounded(f(F.get(f"left_{c}", F.col("level")), F.get(f"right_{c}", F.col("level"))), 2).alias(n) for n, c, f in (("min", "lows", F.least), ("max", "highs", F.greatest))])
    mean = F.when(F.col("metric_type").isin(*cumulative), rounded(F.try_divide(F.col("total").cast("double"), F.col("days")), 1)).otherwise(rounded(F.try_divide(F.col("total").cast("double"), F.col("samples")), 2))
    out = spot.join(ends, ["period_id", "metric_type"], "left").select(
        "period_id", "metric_type", F.when(F.col("days") > 0, F.col("unit")).alias("unit"), "n", F.when(F.col("days") > 0, mean).alias("avg"), "min", "max", F.col("summary").alias("summary_points"), (F.col("days") - F.col("summary")).alias("raw_points")
    )
    return told.join(out, "period_id", "left").select("period_id", "user_id", "first_day", "last_day", "reject_reason", "metric_type", "unit", "n", "avg", "min", "max", "summary_points", "raw_points")


def period_changes(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of periods (a, b; ids) side by side for each metric that both have: both n and avg, delta, percent change of the rounded delta, verdict."""
    own = lambda p: stats.where("metric_type is not null").select(F.col("period_id").alias(p), "metric_type", F.col("user_id").alias(f"{p}_user"), F.col("n").alias(f"{p}_n"), F.col("avg").alias(f"{p}_avg"))
    delta: Column = rounded(F.col("b_avg") - F.col("a_avg"), 2)
    verdict = F.when(delta > 0, "higher").when(delta < 0, "lower").when(delta == 0, "the same").otherwise("insufficient data")
    return pairs.select("a", "b").join(own("a"), "a").join(own("b"), ["b", "metric_type"]).withColumn("delta", delta).withColumns({"pct_change": rounded(100 * F.col("delta") / F.nullif(F.col("a_avg"), F.lit(0.0)), 1), "verdict": verdict})
